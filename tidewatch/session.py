"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "tidewatch", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # wide rule expressions are built from many small calls; call-site capture would dominate their build time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; fall back to a local one only where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="tidewatch-ckpt-")
    sc.setCheckpointDir(named)
    return named


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder, for stream checkpoints and written intermediates."""
    import uuid

    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_scopes: list[list[str]] = []


@contextmanager
def working_tables(spark: SparkSession):
    """Tables that `materialise` writes inside the block are removed at its end, but for those given to the yielded `keep`
    (as `materialise` returned them).

    For a stage whose result is written: its steps' tables are no longer read then.
    """
    mine, kept = [], set()
    _scopes.append(mine)

    def keep(df):
        kept.add(df.table_path)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for path in mine:
            if path in kept:
                if _scopes:
                    _scopes[-1].append(path)
            else:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df):
    """Cut lineage by writing the rows to a table in the shared checkpoint folder and reading it back.

    For a wide row stage that several branches read: it is computed once, each branch scans only its own columns, and a
    lost executor costs a re-read, not a recompute. (A plain checkpoint would run the stage twice and keep all columns.)
    """
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def side_by_side(spark, fit: Callable, values: list, parallelism: int = 4) -> list:
    """fit(value) for each of a few values, several at a time: small fits leave most of a cluster idle between their jobs."""
    with ThreadPool(min(parallelism, max(1, len(values)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), values)
