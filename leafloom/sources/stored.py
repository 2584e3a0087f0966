"""Tables that several frames use, stored once in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all runs on one machine, a temporary one for the session."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafloom-"))


def stored(df: DataFrame) -> DataFrame:
    """df, computed and written once; what is made of it neither computes nor plans it again."""
    ready(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df, stored, and joined by sorting: Spark takes it for as small as the files that it was made of, and would broadcast what grew out of them."""
    return stored(df).hint("merge")
