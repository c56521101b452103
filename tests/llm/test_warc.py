"""Archives, capture index and records against plain versions."""

import base64
import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tristage.llm import warc
from tristage.llm.queries import op12_warc

SF = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(pages, least=0):
    """The contract's rows from (page_id, html)."""
    payloads = [(i, (h or "").encode()) for i, h in pages]
    first = {}
    for i, p in payloads:
        if len(p) >= least and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        of = first.get(p) if first.get(p) != i else None
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "response" if of is None else "revisit", of))
    return Counter(out)


def read_all(spark, pages, tmp_path, least=0, block=3, shard=7, archive=4000):
    captures = warc.write_archives(pages, f"file://{tmp_path}/a", least_bytes=least, archive_bytes=archive)
    index = warc.build_index(captures, str(tmp_path / "i"), block_lines=block, shard_lines=shard)
    return captures, index, warc.read_records(warc.look_up(index, pages), with_payload=True)


@pytest.fixture(scope="module")
def odd_pages(spark):
    rng = random.Random(2)
    htmls = ["<p>a</p>", "<p>b</p>", "", None, "\r\n\r\nWARC/1.1\r\n\r\n", "é" * 900, "x" * 50_000, "\x00\n"]
    urls = [None, "", "http://a.example.com/x", "https://A.example.com:443/x#y", "http://b.example.org:8080?q=1 2\r\n", "no url", "//u:p@c.example.net"]
    rows = [(rng.choice([*range(-5, 60), None]), rng.choice(urls), rng.choice(htmls), k, "f", 1) for k in range(200)]
    rows += [(1000 + i, f"http://host{i % 7}.example.com/{i}", f"<p>{i % 40}</p>", i, "f", 1) for i in range(150)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key long, file string, first int").repartition(5)


@pytest.mark.parametrize("least", [0, 6, 1 << 20])
def test_all_pages_come_back(spark, odd_pages, tmp_path, least):
    _, index, records = read_all(spark, odd_pages, tmp_path, least)
    assert len(index.shards) > 3
    got = Counter(tuple(r[c] for c in COLUMNS) for r in records.collect())
    assert got == expected([(r["page_id"], r["html"]) for r in odd_pages.collect()], least)
    kept = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload").alias("p")).collect()
    assert {bytes(r["p"]) for r in kept} == {(r["html"] or "").encode() for r in odd_pages.collect()}


def test_archives_are_plain_gzip_members(spark, odd_pages, tmp_path):
    captures, _, _ = read_all(spark, odd_pages, tmp_path)
    files = list((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 5  # rolled by size
    for file in files:
        data = file.read_bytes()
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        own = captures.where(F.col("file").endswith(file.name)).orderBy("offset").collect()
        assert own[-1]["offset"] + own[-1]["length"] == len(data)
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(own, own[1:]))


def test_look_up_finds_exactly_the_captures_of_a_key(spark, odd_pages, tmp_path):
    captures, index, _ = read_all(spark, odd_pages, tmp_path)
    rows = captures.collect()
    asked = ["http://a.example.com/x", "HTTP://A.EXAMPLE.COM/x#z", "http://host3.example.com/3", "http://zzz.example.com/", "http://aaa.example.com/", None]
    got = warc.look_up(index, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    keys = {"com,example,a)/x", "com,example,host3)/3", "-"}
    assert Counter(map(tuple, got)) == Counter(tuple(r) for r in rows if r["key"] in keys)
    # One key's captures go on over several shards.
    assert sum(s[0] <= "-" <= s[1] for s in index.shards) > 1


def test_a_search_reads_the_directory_and_few_blocks(tmp_path, monkeypatch):
    out = warc._Writer(str(tmp_path), ".blocks.gz")
    lines = [[f"k{i:05d}", "response", "f", i, 1] for i in range(5000)]
    directory = []
    for a in range(0, 5000, 10):
        block = "\n".join(map(warc.json.dumps, lines[a : a + 10]))
        directory.append((lines[a][0], *out.add(warc._packed(block.encode()))))
    place = out.add(warc._packed(warc.json.dumps(directory).encode()))
    out.stream.close()
    shard, read = warc._Shard(out.name, *place), []
    block = shard._block
    monkeypatch.setattr(shard, "_block", lambda n: (read.append(n), block(n)))
    for i in (0, 9, 10, 2505, 4999):
        assert list(shard.captures(f"k{i:05d}")) == [lines[i]]
    assert len(read) <= 7 and not list(shard.captures("a")) and not list(shard.captures("z"))


def test_keys_reverse_the_host(spark):
    urls = {
        "http://www.Example.com/a?b=C#d": "com,example,www)/a?b=C", "https://example.com": "com,example)/", "http://example.com:80/": "com,example)/",
        "http://example.com:81/": "com,example:81)/", "http://u:p@example.com/@x": "com,example)/@x", "": "-", None: "-", "mailto:x": "mailto:x",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("key", warc.url_key(F.col("url")))
    assert {r["url"]: r["key"] for r in df.collect()} == urls


def test_damage_is_an_error():
    good = warc.record(1, "http://a/", b"payload")
    assert warc.parsed(good)["payload"] == b"payload" and warc.parsed(warc.record("a b>", None, b"p", 7))["refers_to"] == "7"
    assert warc.parsed(warc.record("a b>", None, b""))["page"] == "a b>"
    for bad in (good.replace(b"payload", b"payl0ad"), good[:-1], b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_rare_payloads_are_joined_without_a_broadcast(spark, odd_pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_ROWS", 0)
    monkeypatch.setattr(warc, "HOT_SHARES", 8)
    _, _, records = read_all(spark, odd_pages, tmp_path)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in records.collect())
    assert got == expected([(r["page_id"], r["html"]) for r in odd_pages.collect()])


def test_no_pages(spark, odd_pages, tmp_path):
    _, index, records = read_all(spark, odd_pages.limit(0), tmp_path)
    assert index.shards == [] and records.count() == 0


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = Counter(tuple(r[c] for c in COLUMNS) for r in op12_warc(spark, SF).collect())
    assert got == expected([tuple(p) for p in pages])
    assert Path(SF).exists()
