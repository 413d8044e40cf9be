"""Shared-folder tables: cut lineage in a way that outlives a lost executor.

Everything an operator writes between two of its steps goes below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors).  Only when that setting is
absent, as in unit tests on one machine, a folder below the system's temp folder is used.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI that every executor can open."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.gettempdir() + "/veldspar-shared"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/veldspar/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table (lineage ends here)."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldspar_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` once no later step reads them."""
    for t in tables:
        path = getattr(t, "_veldspar_path", None)
        if path:
            spark = t.sparkSession
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add under these names, as ``withColumn`` replaces them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers see at most ``rows`` records at once: texts are long, workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; at its end the worker gives freed memory back to the system.

    Workers are used again by later stages, and what the allocator keeps of each would add up.
    """

    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return outer
