"""Documents as they arrive. Each is whole in its file, so a micro-batch is read like a batch: no state, no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leafloom.operators import prose
from leafloom.sources import typeset


def blocks_of(documents: DataFrame) -> DataFrame:
    words = typeset.prose_words(documents)
    return prose.blocks(typeset.prose_lines(words), words)


def ingest(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Typed blocks of every Parquet file that comes into ``folder``, one folder of results a batch; a batch that is run again overwrites its own."""

    def batch(documents: DataFrame, number: int) -> None:
        blocks_of(documents).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
