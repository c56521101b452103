"""Readers and writers on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import labels as L
from tristage.operators import labels as O
from tristage.plans.bindings import HISTORY_SQL
from tristage.plans.label_queries import _SIX_SPEC, _trial_sql
from tristage.plans.registry import query
from tristage.schema import STATUS_RULES
from tristage.session import scratch_path
from tristage.sources import readers as R
from tristage.sources import sinks as K
from tristage.sources.provenance import other_order, table_hash

_HEX, _AMINO, _BASES = "0123456789abcdef", "ACDEFGHIKLMNPQRS", "ACGTACGTACGTACGT"


def _tag(name, col):
    return F.concat(F.lit(f"<{name}>"), col.cast("string"), F.lit(f"</{name}>"))


def write_trial_xml(t, damaged: bool = False) -> str:
    """Trials as one gzip XML document per batch: DNA before protein, as such logs have them."""
    h = t.history()
    step = F.concat(
        F.lit("<statusHistory>"), _tag("status", F.col("x.status")), _tag("dateComplete", F.col("x.day")),
        F.lit("</statusHistory>"),
    )
    last = F.max_by(F.struct("status", "stop_status"), F.struct("ts", "event_id"))
    per_trial = h.withColumn("x", F.struct("ts", "event_id", "status", "day")).groupBy("target", "day").agg(
        F.array_sort(F.collect_list("x")).alias("xs"), last.alias("last")
    )
    protein = F.translate(F.md5(F.concat("target", F.lit("/"), "day")), _HEX, _AMINO)
    dna = F.translate(F.md5(F.col("target").cast("string")), _HEX, _BASES)
    own = F.when(F.substring("day", 10, 1).isin("1", "3", "5", "7", "9"), F.concat(
        F.lit("<trialSequence>"), _tag("oneLetterCode", protein), F.lit("</trialSequence>")
    )).otherwise("")
    steps = F.array_join(
        F.transform("xs", lambda x: F.concat(
            F.lit("<statusHistory>"), _tag("status", x["status"]), _tag("dateComplete", x["day"]),
            F.lit("</statusHistory>"))), "")
    trial = F.concat(
        F.lit('<trial id="'), F.col("day"), F.lit('">'), _tag("status", F.col("last.status")),
        F.lit("<stopDetails>"), _tag("stopStatus", F.col("last.stop_status")), F.lit("</stopDetails>"),
        F.lit("<trialSequenceList><trialSequence>"), _tag("oneLetterCode", dna), F.lit("</trialSequence>"), own,
        F.lit("</trialSequenceList><statusHistoryList>"), steps, F.lit("</statusHistoryList></trial>"),
    )
    targets = per_trial.select("target", trial.alias("trial")).groupBy("target").agg(
        F.array_join(F.array_sort(F.collect_list("trial")), "").alias("trials")
    )
    wild = F.translate(F.md5(F.col("target").cast("string")), _HEX, _AMINO)
    entry = F.concat(
        F.lit('<target id="'), F.col("target").cast("string"), F.lit('"><dateCreated>1999-05-05</dateCreated>'),
        F.lit("<targetProteinType>De Novo design</targetProteinType><targetSequenceList><targetSequence>"),
        F.lit("<sequenceChemicalType>dna</sequenceChemicalType>"),
        _tag("oneLetterCode", F.translate(wild, "DEFHIKLMNPQRS", "ACGTACGTACGTA")),
        F.lit("</targetSequence><targetSequence><sequenceChemicalType>Protein</sequenceChemicalType>"),
        _tag("oneLetterCode", wild),
        F.lit("<sourceOrganism><scientificName>E. coli</scientificName></sourceOrganism></targetSequence>"),
        F.lit("</targetSequenceList><trialList>"), F.col("trials"), F.lit("</trialList></target>"),
    )
    path = scratch_path(t.spark, "trials-xml")
    rows = targets.select(
        F.concat(F.lit("lab"), F.col("target") % 5).alias("center"), F.lit(1).alias("part"), entry.alias("value")
    )
    if damaged:
        torn = '<target id="torn"><trialList><trial id="1"><status>cloned & expressed</status></trial></trialList></target>'
        bad = F.explode(F.array(F.lit(torn), F.lit('<target id="lost"><trialList><trial></trialList></target>'), F.lit('<target id="bare"></target>')))
        rows = rows.unionByName(rows.select("center").distinct().select("center", F.lit(1).alias("part"), bad.alias("value")))
    # One well-formed document per batch, but for damage: the root element around its targets.
    ends = rows.select("center").distinct().select(
        "center", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("<targets>").alias("value")),
                                    F.struct(F.lit(2).alias("part"), F.lit("</targets>").alias("value")))).alias("e"),
    ).select("center", "e.part", "e.value")
    (
        rows.unionByName(ends).repartition("center").sortWithinPartitions("center", "part")
        .select("value", "center").write.partitionBy("center").option("compression", "gzip").text(path)
    )
    return path


@query(
    f"center:s target:i day:s sequence:s is_designed:b organism:s year:i reached:i {_SIX_SPEC} evidence_tier:s exclusion_reason:s conflict:b",
    f"""SELECT *, 'lab' || target % 5 AS center, CASE WHEN substr(day, 10, 1) IN ('1', '3', '5', '7', '9')
        THEN translate(md5(target || '/' || day), '{_HEX}', '{_AMINO}') ELSE translate(md5(target::VARCHAR), '{_HEX}', '{_AMINO}') END AS sequence,
      true AS is_designed, 'E. coli' AS organism, substr(day, 1, 4)::INT AS year FROM ({_trial_sql('keep_unobserved')})
    WHERE target % 5 <> 3""",
)
def trials_from_xml(t):
    """The whole path from nested gzip XML to labelled trials, for a subset of the batches."""
    targets = R.read_targets_xml(
        t.spark, write_trial_xml(t), r"center=([^/]+)/", only=["lab0", "lab1", "lab2", "lab4"]
    )
    trials = R.trial_reached(R.trials(targets), STATUS_RULES)
    out = O.outcome_from_history(trials)
    return out.select(
        "*", F.col("target_id").alias("target"), F.col("trial_id").alias("day"), *L.as_columns(F.col("label"))
    )


@query(
    "center:s targets:i recovered_targets:i broken_targets:i targets_no_trial:i trials:i trials_no_protein_sequence:i",
    f"""WITH {HISTORY_SQL} SELECT 'lab' || target % 5 AS center, count(DISTINCT target) + 3 AS targets, 1 AS recovered_targets, 1 AS broken_targets,
      1 AS targets_no_trial, count(DISTINCT target || '/' || day) + 1 AS trials, 1 AS trials_no_protein_sequence FROM hist GROUP BY 1""",
)
def xml_parse_counts(t):
    """Files with a bare ampersand, an element that never ends, and a target without trials in each."""
    return R.parse_counts(R.read_targets_xml(t.spark, write_trial_xml(t, damaged=True), r"center=([^/]+)/"))


@query(
    "header:s sequence:s",
    f"SELECT doc_id || ' 5''->3'' exo' AS header, upper(translate(md5(text) || md5(text || '2'), '{_HEX}', '{_AMINO}')) AS sequence FROM documents",
)
def fasta_round_trip(t):
    """Multi-line records, with the record mark inside their headers, written sorted and read back."""
    fold = F.concat(F.md5("text"), F.lit("\n"), F.md5(F.concat("text", F.lit("2"))))
    header = F.concat(F.col("doc_id").cast("string"), F.lit(" 5'->3' exo"))
    seqs = t("documents").select(header.alias("doc_id"), F.translate(fold, _HEX, _AMINO).alias("seq"))
    path = scratch_path(t.spark, "fasta")
    K.write_fasta(seqs, "doc_id", "seq", path)
    return R.read_fasta(t.spark, path)


@query(
    "job:s n:i first_header:s",
    f"""WITH s AS (SELECT source AS job, doc_id::VARCHAR AS header, CASE WHEN doc_id % 10 = 0 THEN repeat('G', 40)
        WHEN doc_id % 10 = 1 THEN 'GXB' || md5(text) ELSE translate(md5(text), '{_HEX}', '{_AMINO}') END AS s FROM documents),
    f AS (SELECT s, min((job, header)) AS m FROM s WHERE regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]+') AND NOT regexp_full_match(s, 'G+') GROUP BY s)
    SELECT m[1] AS job, count(*) AS n, min(m[2]) AS first_header FROM f GROUP BY 1""",
)
def designed_sequences(t):
    """Distinct valid designs of many FASTA files with the job from the path."""
    code = (
        F.when(F.col("doc_id") % 10 == 0, F.repeat(F.lit("G"), F.lit(40)))
        .when(F.col("doc_id") % 10 == 1, F.concat(F.lit("GXB"), F.md5("text")))
        .otherwise(F.translate(F.md5("text"), _HEX, _AMINO))
    )
    path = scratch_path(t.spark, "designs")
    (
        t("documents").select(
            F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), code).alias("value"),
            F.col("source").alias("job"),
        ).write.partitionBy("job").text(path)
    )
    found = R.read_designs(t.spark, path, r"job=([^/]+)/")
    return found.groupBy("job").agg(F.count("*").alias("n"), F.min("header").alias("first_header"))


@query(
    "job:s n:i weakest:d total:d",
    """WITH s AS (SELECT label::VARCHAR AS job, CASE WHEN vec_id % 3 = 0 THEN list_min(embedding[1:3])::DOUBLE
        WHEN vec_id % 3 = 1 THEN embedding[1]::DOUBLE END AS s FROM embeddings)
    SELECT job, count(*) AS n, min(s) AS weakest, sum(s) AS total FROM s WHERE s IS NOT NULL GROUP BY job""",
)
def confidence_scores(t):
    """Weakest chain score, else the overall one, per job, read back from nested JSON folders."""
    v = t("embeddings")
    doubles = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    path = scratch_path(t.spark, "scores")
    (
        v.select(
            F.col("label").alias("job"), F.when(F.col("vec_id") % 3 == 0, doubles).alias("chain_iptm"),
            F.when(F.col("vec_id") % 3 == 1, F.col("embedding")[0].cast("double")).alias("iptm"),
        ).write.partitionBy("job").json(path)
    )
    scores = R.read_score_json(t.spark, path, multi_line=False, job_pattern=r"job=([^/]+)/")
    return scores.groupBy("job").agg(
        F.count("*").alias("n"), F.min("score").alias("weakest"), F.sum("score").alias("total")
    )


@query(
    "status:s tool:s n:i",
    f"""WITH {HISTORY_SQL} SELECT status, tool, count(*) AS n FROM (SELECT CASE WHEN value > 80 THEN '?' ELSE status END AS status,
      CASE WHEN value < 20 THEN '?' ELSE event_type END AS tool FROM hist) GROUP BY GROUPING SETS ((status), (status, tool))""",
)
def task_status_counts(t):
    tasks = t.history().select(
        F.when(F.col("value") <= 80, F.col("status")).alias("status"),
        F.when(F.col("value") >= 20, F.col("event_type")).alias("tool"),
    )
    return R.task_counts(tasks)


@query(
    "stage:s n:i quantity:i",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'bind' ELSE 'express' END AS stage, count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""",
)
def files_by_manifest(t):
    """CSV files named by a metadata table, one per selected assay."""
    path = scratch_path(t.spark, "assays")
    line = t("lineitem").select("l_orderkey", "l_quantity", F.col("l_returnflag").alias("flag"))
    line.repartitionByRange(16, "flag").write.option("header", "true").csv(path)
    schema = "l_orderkey bigint, l_quantity double, flag string"
    written = t.spark.read.schema(schema).option("header", "true").csv(path)
    files = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("flag").alias("assay"))
    meta = files.where("assay <> 'N'").select(
        "file", F.when(F.col("assay") == "A", "bind").otherwise("express").alias("stage")
    )
    rows = R.read_by_manifest(t.spark, path, meta, "file", schema)
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "member:i rep:i",
    "SELECT o_orderkey AS member, o_custkey AS rep FROM orders",
)
def cluster_file(t):
    """A two-column file without header, typed on reading."""
    path = scratch_path(t.spark, "clusters")
    t("orders").select("o_custkey", "o_orderkey").write.option("sep", "\t").csv(path)
    return R.read_table(t.spark, path, "rep bigint, member bigint", sep="\t", header=False)


@query(
    "state:s n:i",
    """WITH f AS (SELECT (count(*) + 99) // 100 AS n FROM documents)
    SELECT 'ok' AS state, n - 1 AS n FROM f WHERE n > 1
    UNION ALL SELECT s, 1 FROM (VALUES ('mismatch'), ('missing'), ('superseded')) AS v(s)""",
)
def file_integrity(t):
    """Every written file against a registry in which one hash is wrong, one file is missing and one is superseded."""
    path = scratch_path(t.spark, "raw")
    docs = t("documents").select("text")
    docs.repartition(max(1, -(-docs.count() // 100))).write.text(path)
    known = t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.md5("content").alias("md5")
    )
    wrong = F.col("file").startswith("part-00000")
    registry = known.withColumn("md5", F.when(wrong, "0").otherwise(F.col("md5"))).unionByName(
        t("documents").agg(F.lit("lost.tar").alias("file"), F.max(F.md5("text")).alias("md5"))
    )
    old = known.where(wrong).select("file", F.lit("an older download").alias("reason"))
    return R.verify_files(t.spark, path, registry, "part-*", old).groupBy("state").agg(F.count("*").alias("n"))


@query("folder:s", "SELECT DISTINCT 'lang=' || lang || '/source=' || source AS folder FROM documents WHERE doc_id % 2 = 1")
def stray_folders(t):
    """Folders that an unpacked archive left below a source's own."""
    path = scratch_path(t.spark, "raw")
    docs = t("documents").select("text", "lang", "source", (F.col("doc_id") % 2).alias("half"))
    docs.where("half = 0").drop("half").write.partitionBy("lang", "source").text(path)
    docs.where("half = 1").write.mode("append").partitionBy("lang", "source", "half").text(path)
    return R.stray_folders(t.spark, path)


@query(
    "year:i n:i total:d",
    """SELECT year(o_orderdate) AS year, count(*) AS n, sum(CASE WHEN year(o_orderdate) = 2000 THEN 0 ELSE o_totalprice END) AS total
    FROM orders WHERE year(o_orderdate) <> 2000 OR o_orderstatus = 'F' GROUP BY 1""",
)
def merge_written_partitions(t):
    """A second write replaces its own partition and leaves the others."""
    path = scratch_path(t.spark, "merged")
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("year"))
    K.write_parts(o, path, "year")
    K.merge_write(
        o.where("year = 2000 and o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), path, ["year"]
    )
    back = t.spark.read.parquet(path)
    return back.groupBy("year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


_HASHED = ["orders", "lineitem", "documents", "events"]


@query(
    "name:s n_rows:i stable:b",
    " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows, true AS stable FROM {n}" for n in _HASHED),
)
def table_fingerprints(t):
    """Content hashes do not depend on how the rows are partitioned or ordered."""
    out = None
    for name in _HASHED:
        df = t(name)
        again = table_hash(other_order(df)).select(F.col("table_hash").alias("_again"))
        one = table_hash(df).join(F.broadcast(again)).select(
            F.lit(name).alias("name"), "n_rows", (F.col("table_hash") == F.col("_again")).alias("stable")
        )
        out = one if out is None else out.unionByName(one)
    return out
