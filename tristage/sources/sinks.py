"""Writers: FASTA, merge-writes, run log, split manifests and output namespaces."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tristage.operators.splits import side_counts
from tristage.sources.provenance import table_hash


def write_fasta(df: DataFrame, id_col: str, seq_col: str, path: str) -> None:
    """One record per distinct id, globally sorted by id over the part files."""
    records = df.select(id_col, seq_col).groupBy(id_col).agg(F.min(seq_col).alias(seq_col))
    records.orderBy(id_col).select(
        F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq_col))
    ).write.mode("overwrite").text(path)


def write_parts(df: DataFrame, path: str, *cols: str) -> None:
    """One folder per batch, e.g. per center."""
    df.write.mode("overwrite").partitionBy(*cols).parquet(path)


def merge_write(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Replace only the partitions present in ``df``; all others stay as they are."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols).parquet(path)
    )


def variant(df: DataFrame, strip_tags: bool, use_length: bool, default: bool) -> DataFrame:
    """Tag results with their preprocessing variant; write them partitioned by these columns."""
    name = "default" if default else (
        f"ablation_{'striptags' if strip_tags else 'keeptags'}{'' if use_length else '_nolength'}"
    )
    return df.withColumns(
        {
            "variant": F.lit(name), "strip_tags": F.lit(strip_tags), "use_length": F.lit(use_length),
        }
    )


RUN_SCHEMA = """
  run_name string, ts string, seed bigint, sources array<string>, contains_restricted boolean,
  splits_used array<string>, split_hashes map<string,string>, config string, env map<string,string>,
  results string, notes string
"""


def append_run(
    spark: SparkSession, path: str, run_name: str, sources: list[str], splits: dict[str, DataFrame],
    config: dict, seed: int | None = None, results: dict | None = None, notes: str = "",
    restricted: str = "",
) -> None:
    """Append one run: inputs by name and hash, whether a restricted source took part, settings."""
    hashes = {k: str(table_hash(v).first()["table_hash"]) for k, v in splits.items()}
    row = (
        run_name, datetime.now(timezone.utc).isoformat(), seed, sorted(sources),
        restricted in sources, sorted(splits), hashes, json.dumps(config, sort_keys=True),
        {"spark": spark.version}, json.dumps(results or {}, sort_keys=True), notes,
    )
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(path)


def manifest(df: DataFrame, cluster: str, stages: list[str], side: str = "split") -> DataFrame:
    """Per side: records, clusters, stage counts, and the hash that freezes the split."""
    per_cluster = df.groupBy(side, cluster).agg(F.count("*").alias("n"))
    sizes = per_cluster.groupBy(side).agg(
        F.sum("n").alias("n_records"), F.count("*").alias("n_clusters")
    )
    counts = side_counts(df, cluster, stages, side)
    hashes = table_hash(df, [side])
    return counts.join(sizes, side).join(hashes.select(side, "table_hash"), side)
