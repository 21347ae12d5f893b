"""Shared pieces of the training-data operators: tables, staging, tokenizer files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the
    session has none a temporary folder is set once, but on one machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = option.get() if option.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="polystrand-"))
    return named.rstrip("/")


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends
    there, and a lost executor costs no recomputation of what lies before. The shuffle files
    of the write go with its end: nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of staged frames that nothing reads any more."""
    for df in frames:
        if hasattr(df, "staged_path"):
            remove(df.sparkSession, df.staged_path)


def settled(spark: SparkSession) -> None:
    """Collects garbage in the driver: plans, broadcasts and results of queries that have ended
    go, and its heap shrinks. Spark's own cleaner waits for that too."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that stays distributed. Spark sizes a table by its compressed
    files, and an exploded one as before the explode, so a threshold for broadcasts does not
    bound what the driver must hold; tables that grow with the input are joined by sorting."""
    return df.hint("merge")


def quoted(name: str) -> str:
    """A column name with any characters, as a reference to that column."""
    return f"`{name.replace('`', '``')}`"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(f"{name}{k}" for k in itertools.count() if f"{name}{k}" not in taken)


#: Rows and bytes of an Arrow batch where the session sets neither: texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session that has no bounds of its own."""
    own = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in own:
            spark.conf.set(key, value)


def released(table: pa.Table) -> pa.Table:
    """The same table; memory that groups before it have left goes back to the system."""
    pa.default_memory_pool().release_unused()
    return table


def trimmed(batches: Iterator) -> Iterator:
    """The same batches; at the end of a task the worker gives free memory back."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not the GNU library
            ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
