"""Mixing to target weights with soft membership.

A classifier, trained on the labelled table, gives each document a posterior over domains. Nonnegative rates of the
documents are then fitted by projected gradient steps, so that the expected domain token totals (rate x tokens x
posterior, summed over all documents) match their targets in the (weighted) least-squares sense; a weak pull towards rate 1 makes the
rates unique. A step needs the totals alone: they are summed over the cluster, and each document's rate follows from its own
posteriors and the few numbers of the steps so far, so that nothing but those numbers passes through the driver. Every
``STEPS_HELD`` steps the rates are written in the shared folder. ``mix`` makes each row's rate from its own text and the
steps: no row is shuffled. The domain shares aimed at and reached are returned beside the rates; the fit ends when each total
is within ``CLOSE`` of its target, when totals no longer move, or after ``STEPS`` steps.

The classifier is a softmax regression on byte frequencies and a few figures of the text, fitted on at most ``SAMPLE``
labelled rows, chosen by a hash of the id (that bound is a parameter).

Defined results: a null or empty text has no tokens and posteriors of the prior kind, and moves no total; repeated rows are
documents of their own; labelled rows with null labels or ids aren't learned from; without labelled rows all domains are
alike; a domain that no document can belong to keeps its total of 0; an empty table gives no rows; other columns are kept
by ``mix`` and ignored by ``rates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import slices, texts, written

SAMPLE = 12_000
STEPS = 100
STEPS_HELD = 15
PULL = 1e-5
CLOSE = 1e-4  # largest miss of a target that ends the fit, in parts of the total; five steps that move no total further do, too

#: Domains of the labelled table: documents of high quality, of low quality, and toxic ones.
DOMAINS = ("high", "low", "toxic")


def domain_of() -> F.Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


def figures(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    words = text.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = max(1, len(data))
    lines = text.split("\n")
    more = [
        np.log1p(len(words)),
        len(set(words)) / max(1, len(words)),
        len("".join(words)) / max(1, len(words)) / 10,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        counts[48:58].sum() / n * 5,
        counts[65:91].sum() / n * 5,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n * 5,
        len(words[0]) / 10 if words else 0.0,
        1.0,
    ]
    return np.concatenate([np.sqrt(counts / n), more])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, kinds: int, steps: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Softmax regression by accelerated gradient steps."""
    w = v = np.zeros((x.shape[1], kinds))
    one = np.eye(kinds)[y]
    rate = 2.0 / max(1e-9, np.linalg.norm(x, 2) ** 2 / len(x))
    for t in range(steps):
        g = x.T @ (softmax(x @ v) - one) / len(x) + ridge * v
        new = v - rate * g
        v, w = new + t / (t + 3) * (new - w), new
    return w


def learn(documents: DataFrame, labels: DataFrame, kinds: int, domain: F.Column, sample: int = SAMPLE) -> np.ndarray | None:
    known = labels.select("doc_id", domain.cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0, 512):
                rows = [figures(t).astype(np.float32).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column(1)], ["x", "y"])

    table = texts(documents).join(F.broadcast(chosen), "doc_id").select("text", "y").mapInArrow(run, "x binary, y int").toArrow()  # sample rows of 1 KB at most
    if not table.num_rows:
        return None
    x = np.stack([np.frombuffer(v.as_py(), np.float32) for v in table["x"]]).astype(float)
    y = table["y"].to_numpy()
    order = np.lexsort((*x.T[:8], y))  # whatever order the rows came in
    return fitted(x[order], y[order], kinds)


def posteriors(documents: DataFrame, weights: np.ndarray | None, kinds: int, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens (words parted by white space), p (one number for each domain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 512):
                found = part.column(1).to_pylist()
                p = softmax(np.stack([figures(t) for t in found]) @ weights) if weights is not None else np.full((len(found), kinds), 1 / kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.split()) for t in found], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], [id_column, "n_tokens", "p"])

    kind = documents.schema[id_column].dataType.simpleString()
    return texts(documents, id_column).mapInArrow(run, f"{id_column} {kind}, n_tokens long, p array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Steps:
    """Accelerated projected gradient steps of all documents' rates: what each step was moved by. ``since``: the steps that written rates don't have yet."""

    def __init__(self, size: float, pull: float, most: float | None):
        self.size, self.pull, self.most = size, pull, most
        self.moves: list[tuple[np.ndarray, float]] = []
        self.since = 0

    def run(self, p: np.ndarray, r: np.ndarray, v: np.ndarray, since: int) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and the point from which the next step is made."""
        for g, momentum in self.moves[since:]:
            new = np.maximum(0.0, v - self.size * (p @ g + self.pull * (v - 1.0)))
            if self.most is not None:
                new = np.minimum(new, self.most)
            v, r = new + momentum * (new - r), new
        return r, v

    def rates(self, p: np.ndarray) -> np.ndarray:
        one = np.ones(len(p))
        return self.run(p, one, one, 0)[0]


@dataclass
class Fit:
    rates: DataFrame  # the posteriors with rate
    steps: Steps
    target: list[float]  # shares of the domains
    reached: list[float]


def fit_rates(featured: DataFrame, shares: tuple[float, ...], most: float | None = None, tokens: float | None = None, least: float = 0.0) -> Fit:
    """featured: written posteriors. shares: target weights of the domains; most: upper bound of a rate; tokens: the total aimed at.

    Without ``tokens``, the total is that of all documents, or with ``most`` the largest that the expected domain totals
    allow, so that the weights are met, but no less than the part ``least`` of all: with that floor a scarce domain falls
    short of its target.
    """
    kinds = len(shares)
    names = [f"a{d}" for d in range(kinds)]
    facts = featured.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col("p")[d]).alias(n) for d, n in enumerate(names)), *(F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(kinds) for j in range(kinds))).first()
    n = float(facts.n or 0)
    steps = Steps(1.0 / (1.0 + PULL), PULL, most)
    if not n:
        return Fit(featured.withColumn("rate", F.lit(1.0)), steps, list(shares), [0.0] * kinds)
    there = np.array([facts[x] for x in names])
    moment = np.array([[facts[f"m{i}_{j}"] for j in range(kinds)] for i in range(kinds)]) / n
    share = np.where(there > 1e-9 * n, np.array(shares, float), 0.0)
    share = share / share.sum() if share.sum() > 0 else there / n
    if tokens is None:
        on = share > 0
        tokens = n if most is None else max(least * n, min(n * most, float((there[on] * most / share[on]).min())))
    target = share * tokens
    # residuals are weighed by the inverse of the posteriors' moments, so that steps of size 1 suit all directions
    weigh = np.linalg.inv(moment + 1e-6 * np.trace(moment) * np.eye(kinds))
    state = featured.select("*", F.lit(1.0).alias("rate"), F.lit(1.0).alias("next"))
    kind = ", ".join(f"{c} double" for c in [*(f"r{d}" for d in range(kinds)), *(f"v{d}" for d in range(kinds))])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * kinds)
        for b in batches:
            if b.num_rows:
                p, t = _matrix(b.column(1)), b.column(0).to_numpy().astype(float)
                r, v = steps.run(p, b.column(2).to_numpy(), b.column(3).to_numpy(), steps.since)
                out += np.concatenate([(t * r) @ p, (t * v) @ p])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], kind.replace(" double", "").split(", "))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, v = b.column(3), b.column(4)
            if b.num_rows:
                r, v = map(pa.array, steps.run(_matrix(b.column(2)), r.to_numpy(), v.to_numpy(), steps.since))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), r, v], b.schema.names)

    before, still = np.full(kinds, np.inf), 0
    for t in range(STEPS + 1):
        if len(steps.moves) - steps.since == STEPS_HELD:
            state = written(state.mapInArrow(moved, state.schema), "rates")
            steps.since = len(steps.moves)
        row = state.select("n_tokens", "p", "rate", "next").mapInArrow(totals, kind).agg(*(F.sum(c).alias(c) for c in kind.replace(" double", "").split(", "))).first()
        at, ahead = np.array(row[:kinds]), np.array(row[kinds:])
        still = still + 1 if np.abs(at - before).max() <= CLOSE * tokens else 0
        before = at
        if t == STEPS or still == 5 or np.abs(at - target).max() <= CLOSE * tokens:
            break
        # gradient at the point ahead, in the metric in which a document weighs as many as its tokens
        steps.moves.append((weigh @ (ahead - target) / n, t / (t + 3.0)))
    return Fit(state.mapInArrow(moved, state.schema).drop("next"), steps, share.tolist(), (at / max(1e-300, at.sum())).tolist())


def rates(featured: DataFrame, shares: tuple[float, ...], most: float | None = None, tokens: float | None = None, least: float = 0.0) -> DataFrame:
    """featured with rate."""
    return fit_rates(featured, shares, most, tokens, least).rates


def fit(documents: DataFrame, labels: DataFrame, shares: tuple[float, ...], domain: F.Column | None = None, most: float | None = None, least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, p, rate for every document; target and reached: the domains' shares, alike in all rows."""
    weights = learn(documents, labels, len(shares), domain_of() if domain is None else domain)
    found = fit_rates(written(posteriors(documents, weights, len(shares)), "posteriors"), shares, most, least=least)
    return found.rates.select("*", *(F.array(*(F.lit(x) for x in held)).alias(name) for name, held in (("target", found.target), ("reached", found.reached))))


def mix(documents: DataFrame, labels: DataFrame, shares: tuple[float, ...], domain: F.Column, least: float = 0.0) -> DataFrame:
    """The documents that are drawn, each with its rate (1 at most) as probability, by a hash of id and text; all columns. Rows equal in both stay or go together."""
    weights = learn(documents, labels, len(shares), domain)
    steps = fit_rates(written(posteriors(documents, weights, len(shares)), "posteriors"), shares, most=1.0, least=least).steps
    spare = "draw"
    while spare in documents.columns:
        spare += "_"
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at, 512):
                if weights is not None:
                    rate = steps.rates(softmax(np.stack([figures(t or "") for t in part.column(at).to_pylist()]) @ weights))
                else:
                    rate = steps.rates(np.full((part.num_rows, len(shares)), 1 / len(shares)))
                kept = part.filter(pa.array(part.column(part.num_columns - 1).to_numpy() < rate))
                yield kept.select(list(range(part.num_columns - 1)))

    return documents.withColumn(spare, draw).mapInArrow(run, documents.schema)
