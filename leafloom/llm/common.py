"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Python workers started from now on find this package, wherever the driver was started."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset and all runs on one machine (``local`` masters: tests), a temporary folder is set once per session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        held = context.getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafloom-"))
            held = context.getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


_made: dict[str, list[str]] = {}  # by application: the tables that were written


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder. It goes by ``release``, or when the driver ends, whether or not the session was stopped before: until then lazy results may read it."""
    path = f"{shared_dir(spark)}/leafloom-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def kept_until_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes what is at the path when the driver's JVM ends."""
    files, where = _store(spark, path)
    files.deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    files, where = _store(spark, path)
    files.delete(where, True)


def release(spark: SparkSession) -> int:
    """Delete all tables that operators of this application have written so far, and tell how many: for long sessions, once results are stored."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` in the shared folder and read it again: lineage is cut, and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    kept_until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(left: DataFrame, right: DataFrame, key: str, hot: int = 10_000) -> DataFrame:
    """Left join with a table of one row a key. Keys of more than ``hot`` rows, or a 100,000th of all, don't go through the shuffle: their rows of ``right`` (100,000 at most) are broadcast."""
    counts = left.groupBy(key).count()
    rows = counts.agg(F.sum("count")).first()[0] or 0
    keys = counts.where(F.col("count") > max(hot, rows // 100_000)).select(key)
    few = F.broadcast(right.join(F.broadcast(keys), key, "left_semi"))
    return left.join(F.broadcast(keys), key, "left_semi").join(few, key, "left").unionByName(left.join(F.broadcast(keys), key, "left_anti").join(right, key, "left"))


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of ``rows`` rows and ``most`` bytes in a text column at most, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    a = 0
    while a < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[a : a + rows]), most, "right")))
        yield batch.slice(a, n)
        a += n


def texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones; extra columns never reach a worker."""
    reachable(df.sparkSession)
    return df.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias(text_column))
