"""Readers for nested trial XML, delimited files, FASTA, score files and raw-file checks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tristage.functions.text import (
    RESIDUES20,
    first_clean,
    first_typed_clean,
)
from tristage.functions import labels as L
from tristage.operators.labels import fail_on
from tristage.operators.ordering import join_groups
from tristage.session import file_system, with_package

# A schema is always given: inference would read ids as timestamps.
TRIAL_SCHEMA = """
  _id string, targetId string, dateCreated string, targetProteinType array<string>,
  targetSequenceList struct<targetSequence: array<struct<
      sequenceChemicalType: string, oneLetterCode: string, sequenceConstructType: string,
      sourceOrganism: struct<scientificName: string>>>>,
  trialList struct<trial: array<struct<
      _id: string, status: string, stopDetails: struct<stopStatus: string>,
      trialSequenceList: struct<trialSequence: array<struct<oneLetterCode: string>>>,
      statusHistoryList: struct<statusHistory: array<struct<
          status: string, dateComplete: string>>>>>>
"""


def read_targets_xml(
    spark: SparkSession,
    path: str,
    center_pattern: str = r"([^/]+)\.xml(?:\.gz)?$",
    only: list[str] | None = None,
    schema: str = TRIAL_SCHEMA,
    row_tag: str = "target",
) -> DataFrame:
    """One row per target with the batch (center) taken from the file path, never from the content.

    Hidden ``._*`` companions are skipped. A gzip file is one task, so the rows are meant to be
    split right after: ``trials`` explodes them. Files are cut at the closing tags and every target is
    parsed by itself, so that a broken one takes no other with it. A target that is no well-formed XML is
    mended: bare ampersands are escaped and control characters dropped (``recovered``). What cannot be
    read even then stays as a row with nothing but its text, in ``corrupt``; ``parse_counts`` counts both.
    """
    shape = T.StructType.fromDDL(schema).add("corrupt", "string")
    lines = spark.read.option("lineSep", f"</{row_tag}>").option("pathGlobFilter", "[!._]*").text(path)
    # The last opening tag that does not close itself, up to the closing tag cut off.
    opened = rf"(?s)^.*(<{row_tag}(?:\s[^>]*)?(?<!/)>.*)$"
    target = F.regexp_extract("value", opened, 1)
    df = lines.select(
        F.concat(target, F.lit(f"</{row_tag}>")).alias("text"), F.regexp_extract("_metadata.file_path", center_pattern, 1).alias("center")
    ).where(F.col("text") != f"</{row_tag}>")
    df = df.where(F.col("center").isin(only)) if only else df
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    clean = F.regexp_replace(clean, "&(?!(?:#[0-9]+|#x[0-9A-Fa-f]+|amp|lt|gt|quot|apos);)", "&amp;")
    read = df.select("center", "text", F.from_xml("text", shape, options).alias("t"))
    read = read.withColumn("mended", F.when(F.col("t.corrupt").isNotNull(), F.from_xml(clean, shape, options)))
    broken = F.col("t.corrupt").isNotNull()
    recovered = broken & F.col("mended.corrupt").isNull()
    # Half-read fields of a lost target are worth nothing.
    kept = F.when(~broken, F.col("t")).when(recovered, F.col("mended"))
    both = read.select(kept.alias("t"), "center", recovered.alias("recovered"), F.when(broken & ~recovered, F.col("text")).alias("corrupt"))
    return both.select(*[F.col(f"t.{c}").alias(c) for c in shape.names if c != "corrupt"], "center", "recovered", "corrupt")


def parse_counts(targets: DataFrame) -> DataFrame:
    """Per batch: targets, those mended, lost and without trials, trials, and those without a protein."""
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0))

    rows = targets.select("center", "recovered", F.col("corrupt").isNotNull().alias("lost"), F.coalesce(F.size("trialList.trial"), F.lit(0)).alias("n"))
    n = F.greatest(F.col("n"), F.lit(0))  # the size of a missing array may be -1
    read = rows.groupBy("center").agg(
        F.count("*").alias("targets"), F.count_if("recovered").alias("recovered_targets"), F.count_if("lost").alias("broken_targets"),
        F.count_if((n == 0) & ~F.col("lost")).alias("targets_no_trial"), total(n).alias("trials"),
    )
    kept = trials(targets).groupBy("center").agg(F.count("*").alias("_kept"))
    joined = join_groups(read, kept, ["center"], "left")
    return joined.withColumn("trials_no_protein_sequence", F.col("trials") - F.coalesce("_kept", F.lit(0))).drop("_kept")


def _text(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit(""))


def trials(targets: DataFrame) -> DataFrame:
    """One row per trial with its best protein sequence and status history; none without sequence."""
    t = targets.select(
        "center",
        F.coalesce("_id", _text(F.col("targetId"))).alias("target_id"),
        _text(F.col("dateCreated")).alias("date_created"),
        F.col("targetProteinType").alias("_types"),
        F.coalesce("targetSequenceList.targetSequence", F.array()).alias("_entries"),
        F.explode("trialList.trial").alias("trial"),
    )
    de_novo = F.coalesce(F.exists("_types", lambda x: F.lower(x).contains("de novo")), F.lit(False)) | (
        F.coalesce(
            F.exists("_entries", lambda e: F.lower(e["sequenceConstructType"]).contains("de novo")),
            F.lit(False),
        )
    )
    own = F.coalesce(
        F.col("trial.trialSequenceList.trialSequence.oneLetterCode"), F.array().cast("array<string>")
    )
    history = F.coalesce(F.col("trial.statusHistoryList.statusHistory"), F.array())
    organisms = F.transform("_entries", lambda e: _text(e["sourceOrganism"]["scientificName"]))
    organism = F.get(F.filter(organisms, lambda o: o != ""), F.lit(0))
    out = t.select(
        "center", "target_id", "date_created",
        F.coalesce(F.col("trial._id"), F.lit("")).alias("trial_id"),
        de_novo.alias("is_designed"),
        F.coalesce(organism, F.lit("")).alias("organism"),
        _text(F.col("trial.status")).alias("status"),
        _text(F.col("trial.stopDetails.stopStatus")).alias("stop_status"),
        history.alias("history"),
        F.coalesce(
            F.nullif(first_clean(own), F.lit("")),
            first_typed_clean(F.col("_entries"), "sequenceChemicalType", "oneLetterCode"),
        ).alias("sequence"),
    )
    dates = F.filter(
        F.transform("history", lambda h: _text(h["dateComplete"])), lambda d: d != ""
    )
    return out.where("sequence <> ''").select(
        "*",
        L.year_of_record(dates, F.col("date_created")).alias("year"),
        L.first_year(dates).alias("year_first"),
        F.size("history").alias("n_steps"),
    )


def trial_reached(df: DataFrame, rules: dict[str, str | None]) -> DataFrame:
    """Add ``reached``: the furthest stage of the nested history and the current status."""
    def steps(h):
        return F.coalesce(L.stage_index(_text(h["status"]), rules), F.lit(-1))

    past = F.coalesce(F.array_max(F.transform("history", steps)), F.lit(-1))
    now = F.coalesce(L.stage_index(F.col("status"), rules), F.lit(-1))
    return df.withColumn("reached", F.greatest(past, now))


def read_table(
    spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True
) -> DataFrame:
    """Delimited file with a given schema; unread columns are pruned by ``select``."""
    return (
        spark.read.schema(schema).option("sep", sep).option("header", str(header).lower())
        .option("enforceSchema", str(not header).lower()).csv(path)
    )


def read_by_manifest(
    spark: SparkSession, folder: str, meta: DataFrame, file_col: str, schema: str
) -> DataFrame:
    """Rows of the files a metadata table names, with its columns; a missing file is an error.

    The folder is one scan; the metadata (one row per file) joins on the file name.
    """
    rows = (
        spark.read.schema(schema).option("header", "true").option("enforceSchema", "true")
        .csv(folder).select("*", F.col("_metadata.file_name").alias(file_col))
    )
    files = (
        spark.read.format("binaryFile").load(folder)
        .select(F.regexp_extract("path", r"([^/]+)$", 1).alias(file_col))
    )
    fail_on(meta.select(file_col).join(files, file_col, "left_anti"), "files named in the metadata are missing", 5)
    return rows.join(meta, file_col)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence, file) per record; of repeated headers in a file the last one counts.

    Records are split by the text source where a line starts with ``>``, so files of any number of
    records stay splittable and a ``>`` within a header belongs to it. The order of repeats is the
    scan position within the file.
    """
    raw = (
        spark.read.option("lineSep", "\n>").text(path)
        .select(
            "value", F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
        .where("value <> ''")
    )
    # Only the first record of a file still has its own mark; what stands before it is no record.
    start = F.col("_block") == 0
    parts = F.split(F.when(start & F.col("value").startswith(">"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")), "\r?\n", 2)
    parsed = raw.select(
        F.trim(parts[0]).alias("header"),
        F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "")).alias("sequence"),
        "file", F.struct("_block", "_row").alias("_at"),
    ).where("header <> '' and sequence <> ''")
    last = F.max(F.struct("_at", "sequence"))
    return parsed.groupBy("file", "header").agg(last.alias("m")).select(
        "header", F.col("m.sequence").alias("sequence"), "file"
    )


def read_designs(spark: SparkSession, path: str, job_pattern: str = r"([^/]+)/[^/]+/[^/]+/[^/]+$") -> DataFrame:
    """Distinct designed sequences of many small FASTA files, each with its job (a path component).

    Sequences outside the 20 letters or with at most two different letters are placeholders. Of
    equal sequences the one with the smallest (job, header) stays.
    """
    fasta = read_fasta(spark, path).withColumn("job", F.regexp_extract("file", job_pattern, 1))
    letters = F.size(F.array_distinct(F.split("sequence", "")))
    valid = fasta.where(F.col("sequence").rlike(f"^[{RESIDUES20}]+$") & (letters > 2))
    first = F.min(F.struct("job", "header"))
    return valid.groupBy("sequence").agg(first.alias("m")).select("m.job", "m.header", "sequence")


def read_score_json(
    spark: SparkSession, path: str, multi_line: bool = True, job_pattern: str = r"([^/]+)/[^/]+$"
) -> DataFrame:
    """(job, score) per confidence file: the weakest chain score, else the overall one, else none."""
    schema = "chain_iptm array<double>, iptm double"
    df = (
        spark.read.schema(schema).option("multiLine", str(multi_line).lower())
        .option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path)
    )
    whole = F.when(
        (F.size("chain_iptm") > 0) & ~F.exists("chain_iptm", lambda x: x.isNull()),
        F.array_min("chain_iptm"),
    )
    score = F.coalesce(whole, F.col("iptm"))
    job = F.regexp_extract("_metadata.file_path", job_pattern, 1)
    return df.select(job.alias("job"), score.alias("score")).where("score is not null")


def score_summary(scores: DataFrame, cutoffs: tuple[float, ...] = (0.15, 0.5)) -> DataFrame:
    """Count, median and share at or above each cut-off."""
    return scores.agg(
        F.count("*").alias("n_scores"), F.median("score").alias("median_score"),
        *[
            F.avg((F.col("score") >= c).cast("int")).alias(f"frac_ge_{int(c * 100)}")
            for c in cutoffs
        ],
    )


def task_counts(tasks: DataFrame, tool: str = "tool", status: str = "status") -> DataFrame:
    """Counts per status (tool NULL) and per tool and status; missing values count as ``?``."""
    filled = tasks.select(
        F.coalesce(status, F.lit("?")).alias("status"), F.coalesce(tool, F.lit("?")).alias("tool")
    )
    return filled.rollup("status", "tool").agg(F.count("*").alias("n")).where("status is not null")


LARGEST_BINARY = 2**31 - 1024


def _stream_hash(files: DataFrame, algorithm: str) -> DataFrame:
    """(path, hash) of files of any size, each read by one task in pieces."""
    with_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = file_system(path)
                digest = hashlib.new(algorithm)
                with system.open_input_stream(place, compression=None) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "hash"])

    slots = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(4 * slots, "path").mapInArrow(run, "path string, hash string")


def file_hashes(spark: SparkSession, folder: str, algorithm: str = "md5", glob: str = "*") -> DataFrame:
    """(file, size, hash) of all files below a folder, ``md5`` or ``sha256``.

    Empty files are not listed: the source leaves them out. Files within the binary source's limit of 2 GB are hashed where Spark reads them; larger ones are
    streamed by a task each.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(folder)
    )
    one = F.md5("content") if algorithm == "md5" else F.sha2("content", 256)
    # The source reads no content of files that this filter leaves out.
    small = files.where(F.col("length") <= LARGEST_BINARY).select("path", F.col("length").alias("size"), one.alias("hash"))
    large = files.where(F.col("length") > LARGEST_BINARY).select("path", F.col("length").alias("size"))
    streamed = large.join(_stream_hash(large, algorithm), "path")
    return small.unionByName(streamed).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size", "hash")


def verify_files(
    spark: SparkSession, folder: str, expected: DataFrame, glob: str = "*", superseded: DataFrame | None = None
) -> DataFrame:
    """State of every registered file (path, md5): ok, mismatch or missing.

    Files of ``superseded`` (file, reason) that are still there are reported as well, with their reason:
    they are kept, and not to be used.
    """
    found = file_hashes(spark, folder, "md5", glob).select("file", F.col("hash").alias("found_md5"))
    state = (
        F.when(F.col("found_md5").isNull(), "missing").when(F.col("found_md5") == F.col("md5"), "ok").otherwise("mismatch")
    )
    none = F.lit(None).cast("string")
    out = found.join(expected, "file", "right").select("file", "md5", "found_md5", state.alias("state"), none.alias("reason"))
    if superseded is None:
        return out.drop("reason")
    old = found.join(superseded, "file").select("file", none.alias("md5"), "found_md5", F.lit("superseded").alias("state"), "reason")
    return out.unionByName(old)


def stray_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Folders below a raw source's own folder: unpacked archives that belong elsewhere."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # Paths come back with a scheme that the given folder may lack; the rest is compared as it is.
    own = re.sub("^[A-Za-z0-9]+:/*", "", folder).strip("/") + "/"
    rest = F.substr(F.col("path"), F.locate(own, "path") + F.lit(len(own)))
    depth = F.size(F.split(rest, "/"))
    return files.select(rest.alias("p"), depth.alias("d")).where("d > 3").select(
        F.regexp_extract("p", r"^([^/]+/[^/]+)/", 1).alias("folder")
    ).distinct()
