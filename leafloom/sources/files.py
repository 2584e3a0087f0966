"""Files as sources of documents: their bytes, names and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file that a path or glob names, wherever Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sources(files: DataFrame) -> DataFrame:
    """path, name, bytes, sha256, problem: what each file is named and holds; an empty one can't be a source. files: path, content (a name and its bytes, from ``load`` or any table)."""
    size = F.octet_length("content")
    problem = F.when(F.col("content").isNull(), "no bytes").when(size == 0, "empty").when(~F.startswith("content", F.lit(b"%PDF-")), "not a PDF")
    return files.select("path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), problem.alias("problem"))
