"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters of other scripts, digits and signs that stand for letters inside words).
An Aho-Corasick automaton finds the lexicon's words, its stems at word beginnings, and exception phrases, which undo what
they cover. The weights found are summed and normalised by the text's length in words; a logistic curve turns that into a
score from 0 to 1.

The lexicon, its exceptions and the curve are learned from labelled rows: a sample of at most ``Training.rows`` of them,
chosen by a hash of the id (that bound is a parameter, as are the other fields of ``Training``). Entries are whole words, and
stems of at least five letters where these tell more of the label than any longer entry does: shorter beginnings are those of
ordinary words, too. Exceptions are words that begin with a stem, and phrases of an entry and the word before or after it,
that clean rows have as often as toxic ones. Labels, languages, sources and ids are no inputs of a score.

Defined results: a null or empty text has no hits and gets the curve's lowest score, which is under 0.5; repeated rows score
alike; rows with null labels or ids aren't learned from; with no toxic or no clean labelled row every score is the base rate
(0 if none); other columns of the input are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import slices, texts, written

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("авеёкмнорстухіјѕԁӏԛԝһαβεικνορτυχγωϲ", "abeekmhopctyxijsdlqwhabeiknoptuxywc", strict=True))
#: Digits and signs that stand for letters inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FOLD = str.maketrans(HOMOGLYPHS | {"​": None, "‌": None, "‍": None, "\xad": None, "⁠": None, "﻿": None})
LEET_TABLE = str.maketrans(LEET)
#: A run of such signs between letters, or of digits and @ before letters.
IN_WORD = regex.compile(r"(?<=\p{L})[013457@$!]+(?=\p{L})|(?<![\p{L}\p{N}@$!])[013457@]+(?=\p{L})")
OTHER_SCRIPT = regex.compile("[" + "".join(HOMOGLYPHS) + "]")
LATIN = regex.compile("[a-z]")
WORD = regex.compile(r"\p{L}+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if OTHER_SCRIPT.search(text):
            # a word is folded only if it mixes scripts, or stands in a text that also has Latin letters
            text = text.translate(FOLD) if LATIN.search(text) else text
        elif not text.isprintable():
            text = text.translate(FOLD)
    return IN_WORD.sub(lambda m: m[0].translate(LEET_TABLE), text)


HELD = 50_000  # strings that a worker counts at once


@dataclass
class Training:
    rows: int = 12_000  # labelled rows that are learned from, at most
    candidates: int = 20_000  # entries that are counted in clean rows, the most frequent in toxic ones
    entries: int = 400  # of the lexicon, at most, the most telling
    shortest: int = 5  # letters of a stem, and of a word 3
    longest: int = 12
    ratio: float = 4.0  # how much more frequent in toxic text
    seen: int = 5  # toxic rows that have the entry, at least
    clean: int = 4  # clean rows that have an exception, at least


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # stems at word beginnings; whole words end with a blank
    exceptions: list[str] = field(default_factory=list)  # phrases, from a word beginning to a word end, with single blanks
    slope: float = 0.0
    bias: float = -20.0
    words_added: float = 8.0  # so that one hit in a few words isn't all

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        held: dict[str, list] = {}  # string: its weight as a stem, as a word, and whether it is an exception
        for entry, w in lexicon.weights.items():
            held.setdefault(entry.rstrip(" "), [0.0, 0.0, False])[entry.endswith(" ")] = w
        for phrase in lexicon.exceptions:
            if phrase:
                held.setdefault(phrase, [0.0, 0.0, False])[2] = True
        self.automaton = ahocorasick.Automaton()
        for x, (stem, word, exception) in held.items():
            self.automaton.add_word(x, (len(x), stem, word, exception))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, s: str) -> dict[int, tuple[int, float]]:
        """Of a folded text: by place, the end and weight of the strongest entry that no exception covers."""
        if not len(self.automaton):
            return {}
        found: list[tuple[int, int, float]] = []
        undone: list[tuple[int, int]] = []
        for last, (size, stem, word, exception) in self.automaton.iter(s):
            begin, end = last - size + 1, last + 1
            if begin and s[begin - 1].isalpha():
                continue
            whole = end == len(s) or not s[end].isalpha()
            if exception and whole:
                undone.append((begin, end))
            if w := max(stem, word if whole else 0.0):
                found.append((begin, end, w))
        out: dict[int, tuple[int, float]] = {}
        undone.sort()
        far, k = -1, 0  # the farthest end of an exception that begins here or before
        for begin, end, w in sorted(found):
            while k < len(undone) and undone[k][0] <= begin:
                far = max(far, undone[k][1])
                k += 1
            if end > far and w > out.get(begin, (0, 0.0))[1]:
                out[begin] = end, w
        return out

    def density(self, text: str) -> float:
        """Weights of what is found, per 100 words."""
        if not len(self.automaton) or not text:
            return 0.0
        words = fold(text).split()
        return 100.0 * sum(w for _, w in self.hits(" ".join(words)).values()) / (len(words) + self.lexicon.words_added)

    def score(self, text: str) -> float:
        x = self.lexicon.slope * self.density(text) + self.lexicon.bias
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def entries(text: str, t: Training) -> set[str]:
    """What may become an entry: a folded text's words, each with a blank, and their beginnings."""
    words = set(WORD.findall(fold(text)))
    return {f"{w} " for w in words if len(w) >= 3} | {w[:k] for w in words for k in range(t.shortest, min(t.longest, len(w)) + 1)}


def phrases(text: str, matcher: Matcher) -> set[str]:
    """What may become an exception: the words that hits begin, and phrases of such a word and the one before or after."""
    s = " ".join(fold(text).split())
    out = set()
    for begin in matcher.hits(s):
        end = begin
        while end < len(s) and s[end].isalpha():
            end += 1
        out.add(s[begin:end])
        after = WORD.match(s, end + 1) if s[end : end + 1] == " " else None
        if after:
            out.add(s[begin : after.end()])
        k = begin - 1
        if k > 0 and s[k] == " " and s[k - 1].isalpha():
            k -= 1
            while k >= 0 and s[k].isalpha():
                k -= 1
            out.add(s[k + 1 : end])
    return out


def learn(documents: DataFrame, labels: DataFrame, training: Training | None = None, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled rows. ``exceptions``: phrases that never count, besides those learned."""
    t = training or Training()
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.rows)  # bounded by t.rows, so it may be broadcast
    sample = written(texts(documents).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")

    def counts(rows: DataFrame, of, name: str = "n") -> DataFrame:
        """x, n: of the strings that ``of(text)`` gives, the rows that have them. A worker holds ``HELD`` of them at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter = Counter()
            told = of()

            def out() -> pa.RecordBatch:
                found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["x", "n"])
                held.clear()
                return found

            for b in batches:
                for text in b.column(0):
                    held.update(told(text.as_py()))
                    if len(held) > HELD:
                        yield out()
            yield out()

        return rows.select("text").mapInArrow(run, "x string, n long").groupBy("x").agg(F.sum("n").alias(name))

    found = counts(sample.where("toxic = 1"), lambda: lambda text: entries(text, t)).where(F.col("n") >= t.seen)
    toxic = {r.x: r.n for r in found.orderBy(F.desc("n"), "x").limit(t.candidates).collect()}
    rows = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = rows.get(1, 0), sum(n for k, n in rows.items() if k != 1)
    if not n1 or not n0:
        base = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Lexicon(bias=math.log((base + 1e-9) / (1 - base + 1e-9)))
    held = counts(sample.where("toxic <> 1"), lambda: lambda text: entries(text, t) & toxic.keys())
    clean = {r.x: r.n for r in held.collect()}  # at most t.candidates rows
    lexicon = Lexicon(chosen_entries(toxic, clean, n1, n0, t))

    def may_be() -> Callable[[str], set[str]]:
        m = lexicon.matcher()
        return lambda text: phrases(text, m)

    told = counts(sample.where("toxic <> 1"), may_be, "n0").where(F.col("n0") >= t.clean).join(counts(sample.where("toxic = 1"), may_be, "n1"), "x", "left").where(F.col("n0") * n1 >= F.coalesce("n1", F.lit(0)) * n0)
    lexicon.exceptions = sorted({r.x for r in told.collect()} | {" ".join(fold(x).split()) for x in exceptions})  # fewer than there are hits in t.rows rows

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([m.density(text) for text in b.column(0).to_pylist()], pa.float64()), b.column(1)], ["x", "y"])

    fitted = sample.mapInArrow(densities, "x double, y int").toPandas()  # at most t.rows rows
    lexicon.slope, lexicon.bias = logistic(fitted.x.to_numpy(), (fitted.y == 1).to_numpy(float))
    return lexicon


def chosen_entries(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int, t: Training) -> dict[str, float]:
    """Entries by how much they tell of the label; of those that begin alike the most telling one, and of equally telling ones the longest."""

    def log_ratio(s: str) -> float:
        return math.log((toxic[s] + 0.5) / (n1 + 1)) - math.log((clean.get(s, 0) + 0.5) / (n0 + 1))

    def told(s: str) -> float:
        a, b = toxic[s], clean.get(s, 0)
        both = (a + b) / (n1 + n0)
        return 2 * sum(x * math.log(x / e) for x, e in ((a, n1 * both), (b, n0 * both)) if x)

    least = 4 + 2 * math.log(max(1, len(toxic)))  # more than chance gives the best of so many
    good = {s: told(s) for s in toxic if log_ratio(s) >= math.log(t.ratio)}
    kept: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (-round(good[s], 6), -len(s), s)):
        if len(kept) >= t.entries or good[s] < least:
            break
        if not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept[s] = log_ratio(s)
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, most: float = -0.5) -> tuple[float, float]:
    """Slope and bias by Newton steps; rows of either label weigh alike, and the bias is ``most`` at most, so that no hit is never toxic."""
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.array([0.0, most])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w * [0.01, 0.0]
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge * 0.01, 1e-9])
        if w[1] >= most and g[1] < 0:  # at its bound and drawn beyond it: the slope alone moves
            step = np.array([g[0] / h[0, 0], 0.0])
        else:
            step = np.linalg.solve(h, g)
        step = np.clip(step, -5, 5)
        new = np.array([w[0] - step[0], min(most, w[1] - step[1])])
        done = np.abs(new - w).max() < 1e-8
        w = new
        if done:
            break
    return float(max(0.0, w[0]) / scale), float(w[1])


def score_documents(df: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.score(x) for x in part.column(1).to_pylist()], pa.float64())], [id_column, "score"])

    out = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("score", T.DoubleType())])
    return texts(df, id_column, text_column).mapInArrow(run, out)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def toxic_scores(documents: DataFrame, labels: DataFrame, training: Training | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of held-out rows are never read."""
    lexicon = learn(documents, labels.where(~held_out()), training)
    scored = score_documents(documents, lexicon)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows whose texts score under 0.5, with all their columns."""
    m_kind = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                yield part.filter(pa.array([m.score(x or "") < 0.5 for x in part.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, m_kind)
