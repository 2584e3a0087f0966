"""Language identification by a string kernel.

The kernel of two texts counts the n-grams of 1 to ``spectrum`` letters that both have (presence, not frequency), over
the square root of the product of their own counts. Letters are lower case, everything else parts words, and n-grams are
those of a vocabulary: the ones that most windows of the learned texts hold. One-versus-rest kernel ridge regression is
solved in the Nyström form, on the kernels of all learned windows with some of them, the landmarks. As the kernel is an
inner product of presence vectors, landmarks and coefficients fold into one matrix of n-grams by languages: a block of
windows is scored by a single product of matrices.

A whole text is read, in windows of about ``window`` letters, whose scores are averaged by their lengths; so long texts don't
come to hold every n-gram, and memory is bounded by the windows of a block.

What is learned from is bounded by the fields of ``Training`` (texts of a language, windows of a text, languages); texts
are chosen by their hash, equal ones once, so that a hot group of copies counts once. Languages, sources and ids are no inputs of a score.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing was
learned; a text whose letters are all unknown gets the language of the most learned texts, with score 0; repeated rows are
answered alike; a null id isn't learned from and isn't held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import slices, texts

UNKNOWN = "und"
#: Symbols of characters: one that ends all n-grams, one for all that are no letters; the alphabet's letters follow.
BREAK, GAP, FIRST = 0, 1, 2
PART = 4 << 20  # bytes of text, and windows, that are scored at once
BLOCK = 512


@dataclass(frozen=True)
class Training:
    texts: int = 1_500  # of a language, at most
    windows: int = 2  # of a text
    languages: int = 64  # the most frequent ones
    window: int = 1_024  # letters
    alphabet: int = 254  # letters, the most frequent ones
    spectrum: int = 3
    features: int = 8_192  # n-grams, those of most windows
    landmarks: int = 400
    ridge: float = 1e-4


@functools.cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@dataclass
class Model:
    names: list[str]
    usual: str  # of the most learned texts
    alphabet: str
    codes: list[np.ndarray]  # of each length, the n-grams of the vocabulary as numbers, in the order of the columns
    weights: np.ndarray  # n-grams by languages
    window: int

    def scorer(self) -> Scorer:
        return Scorer(self)


class Symbols:
    """Characters as small numbers, and the n-grams of them as numbers."""

    def __init__(self, alphabet: str):
        self.bits = max(2, int(np.ceil(np.log2(len(alphabet) + FIRST))))
        self.of = np.where(letters(), BREAK, GAP).astype(np.uint8)
        for k, c in enumerate(alphabet):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.of[ord(form)] = FIRST + k

    def read(self, text: str) -> np.ndarray:
        parts = [np.frombuffer(text[a : a + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4") for a in range(0, len(text), 1 << 20)]
        return np.concatenate([self.of[p] for p in parts]) if parts else np.zeros(0, np.uint8)

    def grams(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """Of the n-gram that begins at each place but the last n - 1; 0 if it holds a break."""
        size = len(symbols) - n + 1
        out = np.zeros(max(0, size), np.int32)
        whole = np.ones(max(0, size), bool)
        for k in range(n):
            part = symbols[k : k + size]
            out = (out << self.bits) | part
            whole &= part != BREAK
        return np.where(whole, out, 0)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.symbols = model, Symbols(model.alphabet)
        self.columns, at = [], 0
        self.size = sum(map(len, model.codes))
        for n, codes in enumerate(model.codes, 1):
            column = np.full(1 << (n * self.symbols.bits), self.size, np.int32)  # what is outside the vocabulary goes to a column of its own
            column[codes] = np.arange(at, at + len(codes))
            self.columns.append(column)
            at += len(codes)

    def presence(self, symbols: np.ndarray, window: np.ndarray, count: int) -> np.ndarray:
        """Windows by n-grams. window: that of each place; symbols goes on for spectrum - 1 places."""
        held = np.zeros((count, self.size + 1), np.uint8)
        for n, column in enumerate(self.columns, 1):
            held[window, column[self.symbols.grams(symbols, n)[: len(window)]]] = 1
        return held[:, : self.size]

    def score(self, found: list[str | None]) -> tuple[list[str], list[float]]:
        m, more = self.model, len(self.columns) - 1
        parts, sizes, spoken = [], [], []
        for text in found:
            body = self.symbols.read(text or "")
            spoken.append(bool((body != GAP).any()))
            parts.append(np.concatenate([[GAP], body, [GAP], [BREAK] * more]).astype(np.uint8))
            sizes.append(len(parts[-1]))
        sizes = np.array(sizes)
        counts = np.maximum(1, sizes // m.window)  # windows of a text, alike in length
        first = np.cumsum(counts) - counts
        ends = np.cumsum(sizes)
        # where windows begin, over all texts
        of = np.repeat(np.arange(len(found)), counts)
        begin = (ends - sizes)[of] + (np.arange(len(of)) - first[of]) * sizes[of] // counts[of]
        length = np.diff(np.append(begin, ends[-1] if len(ends) else 0))
        symbols = np.concatenate([*parts, np.zeros(more, np.uint8)])
        total = np.zeros((len(found), len(m.names)))
        for a in range(0, len(of), BLOCK):
            b = min(len(of), a + BLOCK)
            window = np.repeat(np.arange(b - a), length[a:b])
            held = self.presence(symbols[begin[a] : begin[a] + len(window) + more], window, b - a).astype(np.float32)
            values = held @ m.weights / np.sqrt(np.maximum(1.0, held.sum(1)))[:, None]
            np.add.at(total, of[a:b], values * length[a:b, None])
        total /= sizes[:, None]
        names, scores = [], []
        for row, heard in zip(np.maximum(total, 0.0), spoken, strict=True):
            best, every = int(row.argmax()), float(row.sum())
            names.append(UNKNOWN if not heard else m.names[best] if every > 0 else m.usual)
            scores.append(float(row[best]) / every if heard and every > 0 else 0.0)
        return names, scores


def held_out(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def sample(documents: DataFrame, t: Training, language_column: str = "lang", text_column: str = "text") -> list[tuple[str, str]]:
    """Language and windows of the learned texts. Only windows are shuffled, and of a frequent language only about as many as are kept."""
    lang, text, h = F.col(language_column), F.col(text_column), F.xxhash64(text_column)
    rows = documents.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), h.alias("h"))
    there = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(t.languages)
    there = F.broadcast(there)  # t.languages rows
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.join(there, "lang").where(draw < 2.0 * t.texts / F.col("n"))
    room = F.greatest(F.char_length("text") - t.window + 1, F.lit(1))
    cut = F.array_distinct(F.array(*(F.substr(F.col("text"), (F.pmod(F.xxhash64("h", F.lit(k)), room) + 1).cast("int"), F.lit(t.window)) for k in range(t.windows))))
    once = near.select("lang", "h", cut.alias("windows")).groupBy("lang", "h").agg(F.min("windows").alias("windows"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")
    kept = once.withColumn("k", F.row_number().over(order)).where(F.col("k") <= t.texts)
    return [(r.lang, w) for r in kept.orderBy("k", "lang").select("lang", "windows").collect() for w in r.windows]  # texts x languages x windows, bounded by t


def fitted(learned: list[tuple[str, str]], t: Training) -> Model | None:
    """Kernel ridge regression on the landmarks. Each language weighs alike."""
    if not learned:
        return None
    count = Counter(name for name, _ in learned)
    names = sorted(count)
    usual = min(names, key=lambda x: (-count[x], x))
    seen = Counter(c for _, w in learned for c in set(w.lower()) if c.isalpha())
    alphabet = "".join(sorted(sorted(seen, key=lambda c: (-seen[c], c))[: t.alphabet]))
    symbols = Symbols(alphabet)
    read = [np.concatenate([[GAP], symbols.read(w), [GAP]]).astype(np.uint8) for _, w in learned]
    frequent = []
    for n in range(1, t.spectrum + 1):
        held = np.zeros(1 << (n * symbols.bits), np.int32)
        for s in read:
            held[np.unique(symbols.grams(s, n))] += 1
        held[[0, sum(GAP << (k * symbols.bits) for k in range(n))]] = 0  # breaks, and gaps alone
        codes = np.flatnonzero(held)
        frequent += [(-int(held[c]), n, int(c)) for c in codes]
    frequent = sorted(frequent)[: t.features]
    codes = [np.array(sorted(c for _, m, c in frequent if m == n), np.int64) for n in range(1, t.spectrum + 1)]
    model = Model(names, usual, alphabet, codes, np.zeros((len(frequent), len(names)), np.float32), t.window)
    scorer = model.scorer()

    def kernels(part: list[np.ndarray]) -> np.ndarray:
        """Presence vectors over their lengths, so that products are kernels."""
        size = np.array([len(s) for s in part])
        more = t.spectrum - 1
        joined = np.concatenate([np.concatenate([s, np.zeros(more, np.uint8)]) for s in part])
        held = scorer.presence(np.append(joined, np.zeros(more, np.uint8)), np.repeat(np.arange(len(part)), size + more), len(part)).astype(np.float32)
        return held / np.sqrt(np.maximum(1.0, held.sum(1)))[:, None]

    step = max(1, -(-len(read) // t.landmarks))
    landmarks = kernels(read[::step])
    m = len(landmarks)
    left, right = np.zeros((m, m)), np.zeros((m, len(names)))
    at = {name: k for k, name in enumerate(names)}
    for a in range(0, len(read), BLOCK):
        k = (kernels(read[a : a + BLOCK]) @ landmarks.T).astype(float)
        kinds = [name for name, _ in learned[a : a + BLOCK]]
        weigh = np.array([1.0 / (len(names) * count[name]) for name in kinds])
        wanted = np.zeros((len(k), len(names)))
        wanted[np.arange(len(k)), [at[name] for name in kinds]] = 1.0
        left += (k * weigh[:, None]).T @ k
        right += (k * weigh[:, None]).T @ wanted
    own = (landmarks @ landmarks.T).astype(float)
    solved = np.linalg.solve(left + t.ridge * own + 1e-9 * np.eye(m), right)
    model.weights = (landmarks.T.astype(float) @ solved).astype(np.float32)
    return model


def learn(documents: DataFrame, training: Training | None = None) -> Model | None:
    t = training or Training()
    return fitted(sample(documents, t), t)


def predict(documents: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer() if model else None
        for batch in batches:
            for part in slices(batch, 1, 512, PART):
                names, scores = scorer.score(part.column(1).to_pylist()) if scorer else ([UNKNOWN] * part.num_rows, [0.0] * part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_column, "lang_pred", "score"])

    out = T.StructType([T.StructField(id_column, documents.schema[id_column].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return texts(documents, id_column, text_column).mapInArrow(run, out)


def languages(documents: DataFrame, training: Training | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Texts and languages of held-out rows are never learned from."""
    model = learn(documents.where(~held_out()), training)
    return predict(documents, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
