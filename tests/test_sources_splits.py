import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tristage.functions import text as X
from tristage.operators import quality as Q
from tristage.operators import splits as P
from tristage.schema import STATUS_RULES
from tristage.sources import provenance as V
from tristage.sources import readers as R
from tristage.sources import sinks as K

XML = """<targets><target id="T1"><dateCreated>2001-01-01</dateCreated><targetSequenceList>
<targetSequence><sequenceChemicalType>dna</sequenceChemicalType><oneLetterCode>{dna}</oneLetterCode></targetSequence>
<targetSequence><sequenceChemicalType>protein</sequenceChemicalType><oneLetterCode>MKV LLA
GHH</oneLetterCode></targetSequence></targetSequenceList><trialList>
<trial id="1"><status>work stopped</status><statusHistoryList>
<statusHistory><status>cloned</status><dateComplete>2003-02-02</dateComplete></statusHistory>
<statusHistory><status>in PDB</status><dateComplete>2004-02-02</dateComplete></statusHistory></statusHistoryList></trial>
<trial id="2"><status>cloned</status><trialSequenceList><trialSequence><oneLetterCode>{dna}</oneLetterCode></trialSequence>
<trialSequence><oneLetterCode>MAAA</oneLetterCode></trialSequence></trialSequenceList></trial></trialList></target></targets>"""


def test_trial_xml(spark, tmp_path):
    for name in ("LAB1.xml.gz", "._LAB1.xml.gz"):
        (tmp_path / name).write_bytes(gzip.compress(XML.format(dna="ACGT" * 10).encode()))
    rows = R.trial_reached(R.trials(R.read_targets_xml(spark, str(tmp_path))), STATUS_RULES).orderBy("trial_id").collect()
    assert [(r["center"], r["target_id"], r["sequence"], r["reached"], r["year"], r["year_first"]) for r in rows] == [
        ("LAB1", "T1", "MKVLLAGHH", 4, 2004, 2003), ("LAB1", "T1", "MAAA", 0, 2001, -1)
    ]


def test_a_broken_target_takes_no_other_with_it(spark, tmp_path):
    trial = "<trialList><trial id='1'><status>{}</status><trialSequenceList><trialSequence><oneLetterCode>MAAAK</oneLetterCode></trialSequence></trialSequenceList></trial></trialList>"
    body = [
        f"<target id='a'>{trial.format('cloned')}</target>", f"<target id='torn'>{trial.format('R&D &amp; x &#38;')}</target>",
        "<target id='self'/>", "<target id='lost'><trialList><trial></trialList></target>", "<target\nid='b'><targetId>9</targetId></target>",
        f"<target id='c'>{trial.format(chr(7) + 'cloned')}</target>", "<target id='cut off'><trialList>",
    ]
    (tmp_path / "LAB1.xml.gz").write_bytes(gzip.compress(("<targets>" + "".join(body)).encode()))
    targets = R.read_targets_xml(spark, str(tmp_path))
    rows = {r["trial_id"] + r["target_id"]: r["status"] for r in R.trials(targets).collect()}
    assert rows == {"1a": "cloned", "1torn": "R&D & x &", "1c": "cloned"}
    lost = sorted(r["corrupt"][:16] for r in targets.where("corrupt is not null").collect())
    assert lost == ["<target id='cut ", "<target id='lost"]
    assert R.parse_counts(targets).first().asDict() == {
        "center": "LAB1", "targets": 6, "recovered_targets": 2, "broken_targets": 2, "targets_no_trial": 1, "trials": 3, "trials_no_protein_sequence": 0,
    }


def test_files_over_the_binary_limit_are_streamed(spark, tmp_path, monkeypatch):
    for i in range(1, 4):
        (tmp_path / f"f {i}.bin").write_bytes(b"x" * (i * 1000))
    (tmp_path / "old.zip").write_bytes(b"old")
    want = {p.name: hashlib.md5(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    monkeypatch.setattr(R, "LARGEST_BINARY", 1500)
    assert {r["file"]: r["hash"] for r in R.file_hashes(spark, str(tmp_path)).collect()} == want
    sha = {r["file"]: r["sha256"] for r in V.fingerprint(spark, str(tmp_path)).collect()}
    assert sha["f 3.bin"] == hashlib.sha256(b"x" * 3000).hexdigest()
    expected = spark.createDataFrame([("f 2.bin", want["f 2.bin"]), ("f 3.bin", "0"), ("f 9.bin", "0")], "file string, md5 string")
    old = spark.createDataFrame([("old.zip", "use f 3"), ("older.zip", "gone")], "file string, reason string")
    got = {r["file"]: (r["state"], r["reason"]) for r in R.verify_files(spark, str(tmp_path), expected, superseded=old).collect()}
    assert got == {"f 2.bin": ("ok", None), "f 3.bin": ("mismatch", None), "f 9.bin": ("missing", None), "old.zip": ("superseded", "use f 3")}


def test_stray_folders_of_a_path_with_marks(spark, tmp_path):
    own = tmp_path / "raw (1)+x" / "src" / "download" / "unpacked"
    own.mkdir(parents=True)
    (own / "a.txt").write_text("a")
    assert [r["folder"] for r in R.stray_folders(spark, str(tmp_path / "raw (1)+x")).collect()] == ["src/download"]


def test_fasta_duplicates_and_lines(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nmk\nVL\n>y\nAAA\n>x one\nGGG\n")
    assert {r["header"]: r["sequence"] for r in R.read_fasta(spark, str(tmp_path)).collect()} == {"x one": "GGG", "y": "AAA"}


def test_fasta_marks_within_headers(spark, tmp_path):
    (tmp_path / "b.fa").write_text(">p1 5'->3' exo\r\nACG\r\n>p2 a>b\nTT\nGG\n")
    got = {r["header"]: r["sequence"] for r in R.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"p1 5'->3' exo": "ACG", "p2 a>b": "TTGG"}


def test_folds_keep_rows_without_a_group(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", 7), (4, "b", 8)], "id bigint, batch string, grp bigint")
    folds = spark.createDataFrame([("a", 0), ("b", 1)], "batch string, fold int")
    got = {(r["id"], r["fold"]): r["side"] for r in P.fold_train_test(rows, folds, "batch", "grp", 2).collect()}
    assert got == {
        (1, 0): "test", (1, 1): "dropped", (2, 0): "dropped", (2, 1): "test",
        (3, 0): "test", (3, 1): "train", (4, 0): "train", (4, 1): "test",
    }


def test_score_json(spark, tmp_path):
    docs = {"j1": {"chain_iptm": [0.7, 0.2], "iptm": 0.9}, "j2": {"iptm": 0.4}, "j3": {"other": 1}, "j4": {"chain_iptm": []}}
    for job, d in docs.items():
        (tmp_path / job).mkdir()
        (tmp_path / job / "s.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "j5").mkdir()
    (tmp_path / "j5" / "s.json").write_text("{broken")
    assert {r["job"]: r["score"] for r in R.read_score_json(spark, str(tmp_path)).collect()} == {"j1": 0.2, "j2": 0.4}


def test_verify_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"a")
    (tmp_path / "b.bin").write_bytes(b"b")
    reg = spark.createDataFrame(
        [("a.bin", hashlib.md5(b"a").hexdigest()), ("b.bin", "0"), ("c.bin", "1")], "file string, md5 string"
    )
    got = {r["file"]: r["state"] for r in R.verify_files(spark, str(tmp_path), reg).collect()}
    assert got == {"a.bin": "ok", "b.bin": "mismatch", "c.bin": "missing"}


def test_provenance(spark, tmp_path):
    a, b, store = (str(tmp_path / n) for n in ("in", "out", "stamps"))
    spark.range(5).write.parquet(a)
    spark.range(3).write.parquet(b)
    with pytest.raises(V.StaleArtifact, match="no stamp"):
        V.require(spark, store, [b])
    V.require(spark, store, [b], strict=False)
    V.stamp(spark, store, b, [a], "test")
    V.require(spark, store, [b])
    spark.range(6).write.mode("overwrite").parquet(a)
    with pytest.raises(V.StaleArtifact, match="input"):
        V.require(spark, store, [b])
    spark.range(4).write.mode("overwrite").parquet(b)
    with pytest.raises(V.StaleArtifact, match="changed since"):
        V.require(spark, store, [b, str(tmp_path / "gone")])


def test_run_log_and_variants(spark, tmp_path):
    path = str(tmp_path / "runs")
    split = spark.range(4).withColumn("split", F.lit("train"))
    for _ in range(2):
        K.append_run(spark, path, "r", ["b", "a"], {"s": split}, {"k": 1}, seed=3, restricted="a")
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and rows[0]["contains_restricted"] and rows[0]["sources"] == ["a", "b"]
    assert K.variant(split, False, True, False).first()["variant"] == "ablation_keeptags"


def test_strip_patterns(spark):
    seqs = ["MHHHHHHSSGLVPRGSHMKVLLAAGGRRTTEEKKLLDD", "GSMKVLLAAGGRRTTEEKKLLDDAA", "MHHHHHHAA", ""]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = [r[0] for r in df.select(X.strip_patterns(F.col("s"))).collect()]
    assert got == ["MSSGHMKVLLAAGGRRTTEEKKLLDD", "MKVLLAAGGRRTTEEKKLLDDAA", "MHHHHHHAA", ""]
    with pytest.raises(ValueError):
        X.scan_alternation(None)
    assert "localhost" in X.scan_alternation([])


def test_rows_without_a_group_are_one_group(spark):
    df = spark.createDataFrame([(1, None, True), (2, None, True), (3, "a", False), (4, "b", True), (5, "b", False)], "id int, g string, late boolean")
    got = {r["id"]: r["split"] for r in P.group_split(df, F.col("late"), "g").collect()}
    assert got == {1: "test", 2: "test", 3: "train", 4: "dropped", 5: "dropped"}
    sides = {r["id"]: r["split"] for r in P.hash_split(df, "g", 1, pin_above=0.3, unit="id").collect()}
    assert len(sides) == 5 and sides[1] == sides[2] == sides[4] == "train"
    plain = {r["id"]: r["split"] for r in P.hash_split(df, "g", 1).collect()}
    assert plain[1] == plain[2] and None not in plain.values()


def test_greedy_folds_of_many_batches_in_one_pass(spark):
    n, k = 200_000, 5
    sizes = spark.range(n).select(F.concat(F.lit("b"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), (F.col("id") * 7919 % 997).alias("size"))
    folds = dict(P.greedy_folds(sizes.repartition(6), "name", "size", k).select("name", "fold").toPandas().itertuples(index=False))
    load = [0] * k
    for i in sorted(range(n), key=lambda i: (-(i * 7919 % 997), i)):
        fold = load.index(min(load))
        assert folds[f"b{i:06d}"] == fold
        load[fold] += i * 7919 % 997


def test_greedy_folds_and_masks(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 8), ("c", 8), ("d", 3), ("e", 1)], "center string, n bigint")
    folds = {r["center"]: r["fold"] for r in P.greedy_folds(sizes, "center", "n", 2, 2).collect()}
    assert folds == {"a": 0, "b": 1, "c": 1, "d": 0, "e": -1}
    rec = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "b", 2), (4, "e", 3), (5, "c", 4)], "id int, center string, grp int")
    fold_df = spark.createDataFrame(list(folds.items()), "center string, fold int")
    sides = {(r["fold"], r["id"]): r["side"] for r in P.fold_train_test(rec, fold_df, "center", "grp", 2).collect()}
    assert [sides[0, i] for i in range(1, 6)] == ["test", "dropped", "train", "train", "train"]
    assert [sides[1, i] for i in range(1, 6)] == ["dropped", "test", "test", "train", "test"]


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 400).alias("grp"))
    one = P.hash_split(df, "grp", 1).orderBy("id").collect()
    two = P.hash_split(df.repartition(13), "grp", 1).orderBy("id").collect()
    assert one == two
    share = sum(r["split"] == "train" for r in one) / len(one)
    assert 0.72 < share < 0.88
    u = int.from_bytes(hashlib.sha256(b"1:7").digest()[:8], "big") / 2**64
    assert [r["split"] for r in one if r["grp"] == 7][0] == ("train" if u < 0.8 else "val" if u < 0.9 else "test")


def test_cross_check(spark):
    a = spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "k string, n bigint, m bigint")
    Q.require_equal(a, a, ["k"])
    with pytest.raises(ValueError):
        Q.require_equal(a, a.where("k = 'x'"), ["k"])


def test_merge_write(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("fold", F.col("id") % 3)
    K.merge_write(df, path, ["fold"])
    K.merge_write(df.where("fold = 1 and id < 2"), path, ["fold"])
    got = {r["fold"]: r["count"] for r in spark.read.parquet(path).groupBy("fold").count().collect()}
    assert got == {0: 4, 1: 1, 2: 3}
