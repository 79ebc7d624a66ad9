"""Session creation and the few settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_session(app: str = "opinio", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC dates and adaptive execution; cluster settings are left to the submitter."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Only a local master, where one machine does everything, may go without; a temporary folder is set then.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="opinio-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[str] = []  # folders of the tables that this driver stored and has not removed


def stored_tables() -> list[str]:
    return list(_STORED)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Removes stored tables through the file system that holds them. Only for tables that no plan in use reads, not
    even to recompute what a lost executor held: their readers' results are written."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _STORED:
            _STORED.remove(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a compressed table in the shared folder, and read back.

    Like a checkpoint it cuts the lineage and survives lost executors; unlike one it is columnar, so later
    readers take only the columns they need and Spark knows its size when it picks a join.
    """
    path = f"{shared_folder(df.sparkSession)}/opinio-{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_up_to(df: DataFrame, limit: int) -> int:
    """Row count that stops at ``limit + 1``: a size check that never scans more than it needs."""
    return df.limit(limit + 1).count()


def broadcast_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a side of at most ``limit`` narrow rows; a larger one keeps Spark's shuffle join."""
    return F.broadcast(df) if count_up_to(df, limit) <= limit else df


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be model-sized; refuses, rather than truncates, beyond ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too large to hold as a parameter")
    return rows
