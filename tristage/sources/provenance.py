"""Fingerprints: stamp what an artifact was made from, refuse to read it when anything changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tristage.sources.readers import file_hashes


class StaleArtifact(RuntimeError):
    """At least one artifact or input is missing, unstamped or changed; all problems are listed."""


def table_hash(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and order-insensitive content hash of a table of any size."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("table_hash")
    )


def other_order(df: DataFrame) -> DataFrame:
    """The same rows dealt anew by their first column, in tasks of about the advisory size, however many rows
    there are or share a value."""
    return df.hint("rebalance", F.col(df.columns[0]))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) per file of any size below ``path``."""
    return file_hashes(spark, path, "sha256", "[!._]*").withColumnRenamed("hash", "sha256")


def artifact_print(spark: SparkSession, path: str) -> dict:
    """One value for a file or a folder of part files; empty when it does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return {}
    files = fingerprint(spark, path).agg(
        F.sum("size").alias("size"), F.count("*").alias("files"),
        # One line per part file: bounded by the number of files, which the driver lists anyway.
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"),
    ).first()
    return {"path": path, "size": files["size"] or 0, "files": files["files"], "sha256": files["sha256"]}


STAMP_SCHEMA = """
  artifact struct<path:string,size:bigint,files:bigint,sha256:string>, produced_by string,
  inputs array<struct<path:string,size:bigint,files:bigint,sha256:string>>,
  extra map<string,string>
"""


def stamp(
    spark: SparkSession, store: str, artifact: str, inputs: list[str], by: str,
    extra: dict[str, str] | None = None,
) -> None:
    """Append the fingerprints of an artifact and of its inputs to the stamp table."""
    def as_row(p):
        d = artifact_print(spark, p)
        if not d:
            raise FileNotFoundError(p)
        return (d["path"], d["size"], d["files"], d["sha256"])

    row = (as_row(artifact), by, [as_row(i) for i in inputs], extra or {})
    df = spark.createDataFrame([row], STAMP_SCHEMA).withColumn("stamped_at", F.current_timestamp())
    df.write.mode("append").parquet(store)


def require(spark: SparkSession, store: str, artifacts: list[str], strict: bool = True) -> None:
    """Fail unless every artifact and all inputs it was stamped with are present and unchanged.

    ``strict=False`` lets an artifact without a stamp pass. All problems are reported together.
    """
    problems = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(store)
    stamps = {}
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        latest = (
            spark.read.parquet(store).where(F.col("artifact.path").isin(artifacts))
            .groupBy("artifact.path")
            .agg(F.max_by(F.struct("artifact", "inputs"), "stamped_at").alias("s"))
        )
        stamps = {r["path"]: r["s"] for r in latest.collect()}  # one row per requested artifact
    for a in artifacts:
        now = artifact_print(spark, a)
        if not now:
            problems.append(f"{a}: missing")
            continue
        if a not in stamps:
            if strict:
                problems.append(f"{a}: no stamp")
            continue
        if now["sha256"] != stamps[a]["artifact"]["sha256"]:
            problems.append(f"{a}: changed since it was stamped")
        for i in stamps[a]["inputs"]:
            cur = artifact_print(spark, i["path"])
            if not cur:
                problems.append(f"{a}: input {i['path']} is missing")
            elif cur["sha256"] != i["sha256"]:
                problems.append(f"{a}: input {i['path']} changed")
    if problems:
        raise StaleArtifact("; ".join(problems))
