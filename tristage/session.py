"""Session helpers: a local session for tests and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, app: str = "tristage") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_package(spark: SparkSession) -> SparkSession:
    """The session; Python workers it starts find this package, where its folder is there for them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, for Python workers, and the path in it."""
    if path.startswith("file:"):
        path = "/" + unquote(path[len("file:") :]).lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster. Only a local session, where every task shares
    this machine's disk, falls back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from it.

    Cuts the lineage, survives lost executors, computes the plan once, and gives later joins the
    table's real size.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
