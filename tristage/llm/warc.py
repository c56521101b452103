"""WARC archives and their two-level capture index.

``write_archives`` writes one record per page, each its own gzip member. Of pages with equal payloads of
at least ``least_bytes``, the one with the smallest id is a response and all others are revisits of it;
payloads are told apart by their SHA-256. A page whose id equals the smallest (repeated rows) is a
response as well; a null id sorts behind all others. A null url has the key ``-``, null html an empty payload.

``build_index`` sorts the captures by key, the host's labels reversed and then the path, and cuts them
into shards by range. A shard's file holds compressed blocks of captures and, behind them, a sparse
directory with the first key and the place of every block. ``look_up`` deals the keys to the shards that
may hold them; a task reads the shard's directory, finds a key's first block by binary search, and reads
ranges of the file for as long as blocks may hold the key. ``read_records`` then reads the captures'
ranges of the archives, neighbouring ones together.

Tasks write files of their own, with names that no other attempt has, and give back rows that name them.
Only the rows of attempts that succeed become part of a table, so a file left by a lost executor is
never referred to. All files live in a folder that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from tristage.llm.columns import slices
from tristage.session import cut

DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 3000
SHARD_LINES = 1_000_000
READ_BYTES = 8 << 20
SPAN_BYTES = 64 << 20  # of an archive, read by one task
SMALL_ROWS = 200_000  # rows of (digest, id) that may be broadcast once counted
HOT_SHARES = 1000
CAPTURE = "key string, kind string, file string, offset long, length long"
CAPTURE_NAMES = [part.split(" ")[0] for part in CAPTURE.split(", ")]


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: lower-case host labels reversed, no scheme, user or fragment."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    port = F.regexp_replace(F.regexp_extract(url, parts, 2), "^:(80|443)$", "")
    path = F.regexp_extract(url, parts, 3)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(url.isNull() | (url == ""), "-").when(host == "", F.regexp_replace(url, "#.*$", "")).otherwise(key)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class _Writer:
    """A new file below a folder that counts its bytes; the folder is made where there are folders."""

    def __init__(self, folder: str, ending: str):
        system, path = _place(folder)
        system.create_dir(path, recursive=True)
        self.name, self.size = f"{folder}/{uuid.uuid4().hex}{ending}", 0
        self.stream = system.open_output_stream(f"{path}/{self.name.rsplit('/', 1)[1]}", compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        """(offset, length) of what was written."""
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)


def _packed(data: bytes, level: int = 6) -> bytes:
    squeezer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeezer.compress(data) + squeezer.flush()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: object) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _page(urn: str) -> str | None:
    return None if urn == "<urn:page>" else unquote(urn[len("<urn:page:") : -1])


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response, or a revisit of ``refers_to`` with the header of its payload only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    target = quote(url, safe="".join(chr(c) for c in range(0x21, 0x7F))) if url else "urn:unknown"
    headers = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        headers += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if revisit else http + payload
    head = "\r\n".join(["WARC/1.1", *headers, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's page, type, digest, payload length and payload (None for a revisit)."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} has another length than it says")
    http, payload = rest[:size].split(b"\r\n\r\n", 1)
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"], "digest": digest,
        "length": length, "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def with_first(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """``pages`` as (row, first): the smallest id of those with an equal payload, where there are several.

    Only payloads that repeat are looked up. Those in more than 1/``HOT_SHARES`` of all rows are fewer
    than ``HOT_SHARES`` and are broadcast; so are the others if counted to be few, else they are joined.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    digest = F.sha2(payload, 256)
    narrow = pages.select(F.col(id_col).alias("id"), digest.alias("digest")).where(F.octet_length(payload) >= least_bytes)
    groups = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = cut(groups.where("n > 1"))
    n, total = repeated.agg(F.count("*"), F.sum("n")).first()
    hot = F.col("n") * HOT_SHARES > (total or 0)
    rows = pages.select(F.struct("*").alias("row"), digest.alias("digest"))
    if n <= SMALL_ROWS:
        return rows.join(F.broadcast(repeated), "digest", "left").select("row", "first")
    often = repeated.where(hot).select("digest", F.col("first").alias("often"))
    seldom = repeated.where(~hot).select(F.col("digest").alias("own"), F.col("first").alias("seldom"))
    rows = rows.join(F.broadcast(often), "digest", "left")
    # Rows of a hot payload are done; their keys spread them over all tasks.
    own = F.when(F.col("often").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64(f"row.{id_col}").cast("string")))
    return rows.withColumn("own", own).join(seldom, "own", "left").select("row", F.coalesce("often", "seldom").alias("first"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write all pages below ``folder``; the table of captures (key, kind, file, offset, length)."""
    needed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    marked = with_first(needed, "id", "html", least_bytes).select("row.*", "first").withColumn("key", url_key(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        try:
            for whole in batches:
                for batch in slices(whole, "html"):
                    rows = []
                    for page, url, html, first, key in zip(*[batch.column(c).to_pylist() for c in ("id", "url", "html", "first", "key")]):
                        if out is None or out.size >= archive_bytes:
                            if out is not None:
                                out.stream.close()
                            out = _Writer(folder, ".warc.gz")
                            info = b"software: tristage\r\nformat: WARC File Format 1.1\r\n"
                            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\n"
                            head += f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                            out.add(_packed(head.encode() + info + b"\r\n\r\n"))
                        of = None if first == page else first
                        offset, length = out.add(_packed(record(page, url, (html or "").encode(), of)))
                        rows.append((key, "response" if of is None else "revisit", out.name, offset, length))
                    yield _captures(rows)
        finally:
            if out is not None:
                out.stream.close()

    return cut(marked.mapInArrow(run, CAPTURE))


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], CAPTURE_NAMES)


@dataclass(frozen=True)
class Index:
    """The shards of an index in the order of their keys: (first key, last key, file, directory's offset, its length)."""

    shards: list[tuple[str, str, str, int, int]]


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES) -> Index:
    """Write the sorted blocks and their directories below ``folder``.

    What comes to the driver is one row per shard of up to ``shard_lines`` captures, or one per task slot.
    Keys with very many captures go on over several blocks and shards.
    """
    slots = captures.sparkSession.sparkContext.defaultParallelism
    n = captures.count()
    lines = min(shard_lines, max(block_lines, -(-n // slots)))
    sorted_captures = captures.repartitionByRange(max(1, -(-n // lines)), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, block, last = None, [], [], None

        def close_block() -> None:
            directory.append((block[0][0], *out.add(_packed("\n".join(map(json.dumps, block)).encode()))))
            block.clear()

        try:
            for batch in batches:
                for line in zip(*[c.to_pylist() for c in batch.columns]):
                    out = out or _Writer(folder, ".blocks.gz")
                    block.append(line)
                    last = line[0]
                    if len(block) == block_lines:
                        close_block()
            if out is not None:
                if block:
                    close_block()
                row = (directory[0][0], last, out.name, *out.add(_packed(json.dumps(directory).encode())))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], SHARD_NAMES)
        finally:
            if out is not None:
                out.stream.close()

    shards = cut(sorted_captures.mapInArrow(run, SHARD))
    return Index(sorted(tuple(r) for r in shards.collect()))


SHARD = "first string, last string, file string, offset long, length long"
SHARD_NAMES = [part.split(" ")[0] for part in SHARD.split(", ")]


class _Shard:
    """A shard's directory, and the block read last."""

    def __init__(self, file: str, offset: int, length: int):
        system, path = _place(file)
        self.stream = system.open_input_file(path)
        directory = json.loads(zlib.decompress(self.stream.read_at(length, offset), 31))
        self.firsts, self.places = [d[0] for d in directory], [d[1:] for d in directory]
        self.number, self.keys, self.lines = None, [], []

    def _block(self, number: int) -> None:
        if number != self.number:
            offset, length = self.places[number]
            data = zlib.decompress(self.stream.read_at(length, offset), 31)
            self.lines = [json.loads(line) for line in data.decode().split("\n")]
            self.keys, self.number = [line[0] for line in self.lines], number

    def captures(self, key: str) -> Iterator[list]:
        # A key may begin at the end of the block before the first one that starts with it.
        number = max(bisect_left(self.firsts, key) - 1, 0)
        while number < len(self.firsts) and self.firsts[number] <= key:
            self._block(number)
            yield from self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]
            number += 1


def look_up(index: Index, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """All captures of the urls' keys, by binary search and range reads; every key is looked up once."""
    spark = urls.sparkSession
    if not index.shards:
        return spark.createDataFrame([], CAPTURE)
    known = spark.sparkContext.broadcast(index.shards)
    keys = urls.select(url_key(F.col(url_col).cast("string")).alias("key")).distinct()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [s[0] for s in known.value], [s[1] for s in known.value]
        for batch in batches:
            rows = [(s, k) for k in batch.column("key").to_pylist() for s in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], ["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, rows = None, None, []
        for batch in batches:
            for own, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist()):
                if own != number:
                    number, shard = own, _Shard(*known.value[own][2:])
                for line in shard.captures(key):
                    rows.append(line)
                    if len(rows) == BLOCK_LINES:
                        yield _captures(rows)
                        rows = []
        yield _captures(rows)

    dealt = keys.mapInArrow(deal, "shard int, key string")
    # A number of its own, so that small rows that stand for long reads are not put together.
    return dealt.repartition(len(index.shards), "shard").sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, from, to, [(offset, length)]): neighbouring ranges together, up to ``READ_BYTES``."""
    own: list[tuple[int, int]] = []
    file, start, end = None, 0, 0
    for name, offset, length in rows:
        if own and (name != file or offset != end or end + length - start > READ_BYTES):
            yield file, start, end, own
            own = []
        if not own:
            file, start = name, offset
        own.append((offset, length))
        end = offset + length
    if own:
        yield file, start, end, own


def read_records(captures: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]) of captures.

    The payload of a response is checked against its digest and length; a damaged record is an error.
    The length and digest of a revisit are those of the payload that it leaves out.
    """
    slots = captures.sparkSession.sparkContext.defaultParallelism
    total = captures.agg(F.sum("length")).first()[0] or 0
    span = F.floor(F.col("offset") / max(1, min(SPAN_BYTES, total // (2 * slots) + 1)))
    spread = captures.select("file", "offset", "length", span.alias("span")).repartition(2 * slots + total // SPAN_BYTES, "file", "span")
    names = ["page", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *(["payload"] if with_payload else [])]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()][: 1 + with_payload]

    def rows(found: list[dict]) -> pa.RecordBatch:
        fields = ["page", "url", "type", "refers_to", "digest", "length", *(["payload"] if with_payload else [])]
        return pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], k) for x, k in zip(fields, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            places = list(zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")]))
            for file, start, end, own in _ranges(places):
                if file != name:
                    system, path = _place(file)
                    name, stream = file, system.open_input_file(path)
                data = stream.read_at(end - start, start)
                yield rows([parsed(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in own])

    shape = ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if n == 'payload_bytes' else 'string'}" for n in names)
    records = spread.sortWithinPartitions("file", "offset").mapInArrow(run, shape)
    back = [F.col("page").cast(id_type).alias("page_id"), "url", "record_type", F.col("refers_to").cast(id_type).alias("refers_to")]
    return records.select(*back, *names[4:])
