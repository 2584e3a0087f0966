"""Queries and the SQL that tells the same."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name."""

        def held(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return held


def reachable(spark: SparkSession) -> None:
    """Python workers started from now on find this package, wherever the driver was started."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where each takes long: a small file is else read, and all that is made of it worked out, in one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def once(f: Callable) -> Callable:
    """A fixture's frames, made once for each session and data: for those that are stored, and that several queries read."""
    made: dict[tuple[str, str], object] = {}

    def held(spark: SparkSession, sf_dir: str):
        key = spark.sparkContext.applicationId, sf_dir
        if key not in made:
            made[key] = f(spark, sf_dir)
        return made[key]

    return held


def dealt(spark: SparkSession, sf_dir: str, rows: list, kind: str) -> DataFrame:
    """doc and the columns of ``kind``: each part's key has the row of its remainder."""
    from pyspark.sql import functions as F

    held = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"variant long, {kind}")
    parts = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_partkey") % len(rows)).alias("variant")))
    return parts.join(F.broadcast(held), "variant").drop("variant")


def values(rows: list) -> str:
    """SQL rows of Python values."""

    def shown(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x).lower() if isinstance(x, bool) else str(x)

    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
