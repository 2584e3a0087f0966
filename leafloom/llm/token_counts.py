"""Token counts through a digest cache.

Content is normalised in a way that cannot change its count, and its digest, together with a digest of the tokenizer's
file and kind, is the key of a stored table of counts. Documents are joined with that table; only the distinct contents
that miss are encoded, and their counts are appended. A second call over the same or overlapping data encodes nothing
that was counted before; a changed tokenizer file has another digest and never meets old counts.

The cache is a Parquet folder in shared storage, parted by tokenizer digest, so that other versions' counts aren't read. A
reader beside an append may miss its counts, and encodes these contents again; a row that was appended twice is the same row,
so readers take one per key. A content that very many rows have is no key of the last join: its count is broadcast.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); equal contents share one count; rows with a null
or repeated id are each answered; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.bpe import codec
from leafloom.llm.common import beside, kept_until_exit, scratch, slices, written

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("content", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Single characters that fold to a blank where a tokenizer drops white space; changing one for another changes no count.
BLANKS = "\t\n\r\x0b\x0c"


def drops_white_space(path: str) -> bool:
    """Whether the file's own normaliser folds white space and its splitter drops it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    return any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps) and bool((spec["model"] or {}).get("end_of_word_suffix"))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens added|1").hexdigest()


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to counts as the file's library gives them; loaded once per worker."""
    if path not in _counters:
        if drops_white_space(path):
            bpe = codec(path)
            _counters[path] = lambda texts: [len(bpe.encode_packed(t)) // 4 for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            held = Tokenizer.from_file(path)
            held.no_truncation()
            held.no_padding()
            _counters[path] = lambda texts: [len(held.encode(t, add_special_tokens=False).ids) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts: [len(pieces.encode(t)) for t in texts]
        else:
            raise ValueError(f"{path}: not a .json or .model tokenizer")
    return _counters[path]


def count_tokens(df: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit). ``cache``: the stored counts' folder; None starts an empty one."""
    spark = df.sparkSession
    own, cache = cache is None, cache or scratch(spark, "token-counts")
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_column), F.lit(""))
    content = F.translate(text, BLANKS, " " * len(BLANKS)) if drops_white_space(tokenizer) else text
    keyed = df.select(F.col(id_column).alias("id"), content.alias("text"), F.sha2(content, 256).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))

    def stored() -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], CACHE)
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), part.column(0), pa.array(n, pa.int64())], ["tokenizer", "content", "n_tokens"])

    facts = written(keyed.drop("text"), "contents")
    misses = keyed.select("content", "text").join(stored().select("content"), "content", "left_anti").dropDuplicates(["content"])
    misses.mapInArrow(encode, CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    if own:
        kept_until_exit(spark, cache)
    return beside(facts, stored(), "content").select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
