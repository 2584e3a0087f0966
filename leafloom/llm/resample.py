"""Importance resampling towards a target distribution of hashed n-grams.

A ring of running zlib states is kept over a document's words: the states of the last ``n`` starts. A word extends each of
them by a space and itself and begins one of its own, so that a single scan emits the bucket of every run of 1 to ``n``
words. Counts of the buckets over all documents and over the target texts (``buckets`` numbers each) give every bucket a
gain, and a second scan sums the gains of a document's features. With a Gumbel number made from the document's id added,
the highest scores are a sample without replacement in proportion to the exponent of the weights.

Ranks are made without gathering rows: scores are parted by ranges, what lies in the ranges before is counted, and only the
ranges that hold drawn rows are numbered. ``draw`` passes the lowest drawn score over the documents and keeps all columns.

Defined results: a null or empty text, and one without words, has no features and weight 0; texts are read in pieces that
end between words, so their length doesn't matter; a null id counts as empty in the hash; ties go to the smaller id (null
first), and rows of one id and score are numbered in any order; ``draw`` keeps or drops such rows together; repeated rows
are documents of their own; an empty table gives no rows, an empty target gains that follow the documents alone; other
columns are ignored by ``resample`` and kept by ``draw``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import reachable, texts, written

PIECE = 1 << 18  # bytes of a text whose words are held at once
#: Bytes of words: A-Z becomes a-z, digits, a-z and all bytes from 0x80 on stay, the rest parts words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Sampling:
    n: int = 3
    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: int = 42


def pieces(data: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``most`` bytes."""
    a = 0
    while a < len(data):
        b = a + most
        while b < len(data) and WORDS[data[b]] != 32:
            b += 1
        yield data[a:b].translate(WORDS).split()
        a = b


def ring(data: bytes, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Piece by piece: its number of words, and the CRC of every run of 1 to ``n`` words that ends in it.

    ``held[k]`` is the running state of the start k words before the next word; a piece's words extend all starts of one age
    in one go.
    """
    held: list[int] = []
    for words in pieces(data):
        later = [b" " + word for word in words]
        found = [list(map(crc32, words))]
        for k in range(1, n):
            # the states that each word extends: those of the same starts, one word younger
            younger = found[-1][:-1]
            if k <= len(held):
                found.append(list(map(crc32, later, [held[k - 1], *younger])))
            else:  # the text begins in this piece: its first words have no start of this age
                found.append(list(map(crc32, later[k - len(held) :], younger)))
        if words:
            held = [states[-1] for states in found[: n - 1] if states]
        yield len(words), np.concatenate([np.array(states, np.uint32) for states in found])


def bucket_counts(df: DataFrame, sampling: Sampling, text_column: str = "text") -> np.ndarray:
    """How many features of all texts each bucket has. A task tells ``buckets`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(sampling.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for _, found in ring(text.as_py(), sampling.n):
                    counts += np.bincount(found % sampling.buckets, minlength=sampling.buckets)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there])], ["bucket", "n"])

    reachable(df.sparkSession)
    told = df.select(F.coalesce(F.col(text_column), F.lit(""))).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(sampling.buckets, np.int64)
    for r in told.collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of its smoothed share of the target by that of the source, rounded down."""
    s, t, more = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + more) / ((a + 1.0) * (t + more)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, key: object) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(data: bytes, gain: np.ndarray, n: int) -> tuple[int, int, int]:
    """Words, features and weight of a text."""
    words = features = weight = 0
    for count, found in ring(data, n):
        words += count
        features += len(found)
        weight += int(gain[found % len(gain)].sum())
    return words, features, weight


def score(documents: DataFrame, gain: np.ndarray, sampling: Sampling, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_features, weight and score of every row."""
    names = [id_column, "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [weigh(text.as_py(), gain, sampling.n) for text in batch.column(1).cast(pa.binary())]
            scores = [w[2] + gumbel(sampling.seed, i) for i, w in zip(ids, found, strict=True)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (*columns, scores))], names)

    out = T.StructType([T.StructField(id_column, documents.schema[id_column].dataType), *(T.StructField(c, T.LongType()) for c in names[1:])])
    return texts(documents, id_column, text_column).mapInArrow(run, out)


def ranked(scored: DataFrame, sampling: Sampling, id_column: str = "doc_id") -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the drawn rows, null for others."""
    may = F.col("n_words") >= sampling.least_words
    held = scored.withColumn("spot", F.monotonically_increasing_id())
    order = (~may, F.desc("score"), F.col(id_column), F.col("spot"))
    parted = written(written(held, "scores").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "score-ranges")
    before, begins = 0, {}
    for r in parted.where(may).groupBy("part").count().orderBy("part").collect():  # as many rows as there are partitions
        begins[r.part] = before
        before += r["count"]
    drawn = sampling.percent * before // 100
    begins = {k: v for k, v in begins.items() if v < drawn}
    rest = parted.where(~F.col("part").isin(list(begins)) if begins else F.lit(True)).withColumn("rank", F.lit(None).cast("long"))
    if not begins:
        return rest.drop("spot", "part")
    start = parted.sparkSession.createDataFrame(list(begins.items()), "part int, start long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("start")
    numbered = parted.join(F.broadcast(start), "part").withColumn("rank", place).withColumn("rank", F.when(may & (F.col("rank") <= drawn), F.col("rank")))
    return numbered.drop("start").unionByName(rest).drop("spot", "part")


def resample(documents: DataFrame, target: DataFrame, sampling: Sampling | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document."""
    s = sampling or Sampling()
    gain = gains(bucket_counts(documents, s), bucket_counts(target, s))
    return ranked(score(documents, gain, s), s)


def draw(documents: DataFrame, target: DataFrame, sampling: Sampling | None = None) -> DataFrame:
    """The drawn documents with all their columns; rows of the last drawn score and id stay together. No row is shuffled for it."""
    s = sampling or Sampling()
    gain = gains(bucket_counts(documents, s), bucket_counts(target, s))
    last = ranked(score(documents, gain, s), s).where("rank is not null").orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return documents.limit(0)
    at, by = documents.columns.index("text"), documents.columns.index("doc_id")
    # ids in the order of ties: null first
    cut = (-last.score, last.doc_id is not None, last.doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for key, text in zip(batch.column(by).to_pylist(), batch.column(at), strict=True):
                words, _, weight = weigh((text.as_py() or "").encode(), gain, s.n)
                mine = (-(weight + gumbel(s.seed, key)), key is not None, key)
                kept.append(words >= s.least_words and (mine[:2] < cut[:2] or mine[:2] == cut[:2] and (key is None or key <= cut[2])))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
