"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected to a few dimensions with Gaussian (2-stable) weights. A squared projected distance, divided by the
squared true distance, then has a chi-square distribution of as many degrees of freedom. A kd-tree over the projections
yields a query's neighbours in order of projected distance, leaf by leaf; each is verified on the original vectors, until
the test holds: were a closer neighbour still to come, its projected distance would have been smaller than the next one's
with probability ``SURE``.

Largest inner product becomes smallest distance by one more component that brings all vectors to the largest norm.

Over the cluster the tree's upper levels, fitted on at most ``SAMPLE`` projections, part all rows into cells, and cells
into blocks of about ``BLOCK`` rows by a hash; the lower levels are built in each block. A query first searches a block of
its own cell, which gives an upper bound of its 20th distance; then all blocks of the cells that the chi-square test can't
rule out. Both turns' finds count. A block goes once to each group of ``QUERIES`` queries that are aimed at it, so that what
is shuffled grows with the rows and with the pairs of queries and blocks that the test leaves, and a task holds a block and
a group at most. On vectors that spread evenly in many dimensions the test rules out little (README has figures).

Of equal vectors only the 21 smallest ids can ever be among a query's 20 nearest, so the others aren't searched; equal
queries are searched once.

Defined results: vectors that are null, zero, hold nulls or non-finite components, or have another length than most take
no part, as queries or candidates; rows with a null id neither; of rows with one id only the one whose vector has the
smallest digest counts; vectors that tie for the last place are all compared, however many; fewer candidates than asked for
give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import written

DIMENSIONS = 8
SURE = 0.96
SAMPLE = 50_000
BLOCK = 8_192
LEAF = 128
CELLS = 4_096  # at most; larger cells have more blocks
QUERIES = 4_096  # that meet a block at once
BLOCKS_HELD = 1_000_000  # blocks whose numbers of groups may be broadcast, 24 bytes each


def chi_square_quantile(p: float, m: int) -> float:
    """Of even degrees of freedom m, by bisection of the closed form."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def weights(length: int, dimensions: int = DIMENSIONS, seed: int = 20_14) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length + 1, dimensions))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that brings them to ``norm``."""
    rest = np.sqrt(np.maximum(0.0, norm * norm - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], 1)


def split_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(axis, cut) of a full kd-tree's inner nodes, in heap order: medians along the widest axis."""
    out: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for p in level:
            if len(p):
                axis = int(np.argmax(p.max(0) - p.min(0)))
                cut = float(np.median(p[:, axis]))
            else:
                axis, cut = 0, 0.0
            out.append((axis, cut))
            right = p[:, axis] >= cut
            below += [p[~right], p[right]]
        level = below
    return out


def cell_of(points: np.ndarray, tree: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axes, cuts = (np.array(x) for x in zip(*tree, strict=True)) if tree else (np.zeros(0, int), np.zeros(0))
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] >= cuts[at])
    return at - (2**depth - 1)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of a kd-tree's leaves."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        p = points[rows]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argpartition(p[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    gap = np.maximum(0.0, np.maximum(low[None] - q[:, None], q[:, None] - high[None]))
    return np.einsum("ijk,ijk->ij", gap, gap)


def reach(bound: np.ndarray, norm: float, quantile: float) -> np.ndarray:
    """The squared projected distance up to which the test can't rule out a larger inner product than ``bound``, or an equal one."""
    return np.maximum(0.0, 2 * norm * norm - 2 * bound) * quantile + 1e-9 * norm * norm


def search(qx: np.ndarray, qp: np.ndarray, bound: np.ndarray, x: np.ndarray, p: np.ndarray, k: int, norm: float, quantile: float, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of queries (vectors brought to ``norm``, projections, least inner product worth finding): (query number, candidate row, score).

    Incremental search of one block: each query takes the leaves in order of projected distance, verifies their vectors, and
    stops by the chi-square test. ``seen`` takes the leaves visited and the leaves there were.
    """
    groups = leaves(p)
    low, high = np.stack([p[g].min(0) for g in groups]), np.stack([p[g].max(0) for g in groups])
    for a in range(0, len(qx), 256):
        q, best = qx[a : a + 256], bound[a : a + 256].copy()
        near = box_distance(qp[a : a + 256], low, high)
        order = np.argsort(near, 1)
        top = np.full((len(q), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.arange(len(q))
        if seen is not None:
            seen[1] += near.size
        for step in range(len(groups)):
            leaf = order[live, step]
            on = near[live, leaf] <= reach(best[live], norm, quantile)
            live, leaf = live[on], leaf[on]
            if not len(live):
                break
            if seen is not None:
                seen[0] += len(live)
            for g in np.unique(leaf):
                who, rows = live[leaf == g], groups[g]
                score = q[who] @ x[rows].T
                merged = np.concatenate([top[who], score], 1)
                top[who] = np.partition(merged, merged.shape[1] - k, 1)[:, -k:]
                best[who] = np.maximum(best[who], top[who].min(1))
                i, j = np.nonzero(score >= (best[who] - 1e-9 * norm * norm)[:, None])
                found.append((who[i], rows[j], score[i, j]))
        if found:
            who, rows, score = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = score >= best[who] - 1e-9 * norm * norm
            yield who[keep] + a, rows[keep], score[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k rows of largest inner product found."""
    spark = df.sparkSession
    v = F.col(vector_column)
    sound = F.col(id_column).isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    rows = df.where(sound).select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("x"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    length = length.n
    rows = rows.where(F.size("x") == length).withColumn("same", F.sha2(F.col("x").cast("string"), 256))
    rows = rows.groupBy("id").agg(F.min(F.struct("same", "x")).alias("r")).select("id", "r.same", "r.x")  # one row an id
    # of equal vectors the k + 1 smallest ids suffice
    order = Window.partitionBy("same").orderBy("id")
    kept = written(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), "ann-rows")
    asked = written(rows.where(F.col("id") % every == 0).select("id", "same"), "ann-queries")
    asked_vectors = kept.dropDuplicates(["same"]).join(asked.select("same").distinct(), "same", "left_semi").select(F.col("same").alias("query"), "x")

    facts = kept.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))).alias("norm")).first()
    n, norm = facts.n, facts.norm
    project = weights(length)
    quantile = chi_square_quantile(SURE, DIMENSIONS)
    depth = max(0, min(CELLS, math.ceil(n / BLOCK)) - 1).bit_length()
    sampled = kept.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x") if depth else None
    tree: list[tuple[int, float]] = []
    if depth:

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y = lifted(_matrix(b.column(0)), norm) @ project
                    yield pa.RecordBatch.from_arrays([_lists(y)], ["p"])

        points = sampled.mapInArrow(projected, "p array<double>").toArrow()  # SAMPLE rows of DIMENSIONS numbers at most
        tree = split_tree(_matrix(points.column(0)), depth)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                y = lifted(_matrix(part.column(1)), norm) @ project
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(y), pa.array(cell_of(y, tree, depth))], ["id", "x", "p", "cell"])

    index = written(kept.select("id", "x").mapInArrow(celled, "id long, x array<double>, p array<double>, cell long"), "ann-index")
    boxes = index.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("p")[i]).alias(f"{name}{i}") for i in range(DIMENSIONS) for name, f in (("low", F.min), ("high", F.max)))).collect()  # CELLS rows at most
    boxes.sort(key=lambda r: r.cell)
    cells = np.array([r.cell for r in boxes])
    parts = np.array([math.ceil(r.n / BLOCK) for r in boxes])
    low, high = (np.array([[r[f"{name}{i}"] for i in range(DIMENSIONS)] for r in boxes]) for name in ("low", "high"))
    sizes = spark.createDataFrame([(int(c), int(m)) for c, m in zip(cells, parts, strict=True)], "cell long, parts long")  # CELLS rows at most
    dealt = index.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")

    def aimed(first: bool):
        """Queries to blocks: the first of the own cell, or all that the test can't rule out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 64):
                    part = b.slice(s, 64)
                    x = _matrix(part.column(1))
                    x *= (norm / np.sqrt(np.einsum("ij,ij->i", x, x)))[:, None]
                    y = np.concatenate([x, np.zeros((len(x), 1))], 1) @ project
                    near = box_distance(y, low, high)
                    if first:
                        i = np.arange(len(x))
                        j, bound = near.argmin(1), np.full(len(x), -norm * norm)
                    else:
                        bound = part.column(2).to_numpy(zero_copy_only=False)
                        i, j = np.nonzero(near <= reach(bound, norm, quantile)[:, None])
                    for at in range(0, len(i), 256):
                        qi, qj = i[at : at + 256], j[at : at + 256]
                        n_parts = np.ones(len(qj), np.int64) if first else parts[qj]
                        block = np.arange(n_parts.sum()) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                        qi, qj = np.repeat(qi, n_parts), np.repeat(qj, n_parts)
                        for k in range(0, len(qi), 4096):
                            q, c = qi[k : k + 4096], qj[k : k + 4096]
                            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), _lists(x[q]), _lists(y[q]), pa.array(bound[q]), pa.array(cells[c]), pa.array(block[k : k + 4096])], ["query", "x", "p", "bound", "cell", "part"])

        return run

    kind = "query string, x array<double>, p array<double>, bound double, cell long, part long"

    def meet(queries: DataFrame, name: str) -> DataFrame:
        queries = written(queries.mapInArrow(aimed(name == "first"), kind), f"ann-aimed-{name}")
        shares = queries.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("shares"))  # as many rows as there are blocks
        many = parts.sum() > BLOCKS_HELD
        q = queries.join(shares if many else F.broadcast(shares), ["cell", "part"]).withColumn("share", F.pmod(F.xxhash64("query"), F.col("shares"))).drop("shares")
        c = dealt.join(shares if many else F.broadcast(shares), ["cell", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return out([], [], [])
            x, ids = _matrix(right["x"]), right["id"].to_numpy()
            got = list(search(_matrix(left["x"]), _matrix(left["p"]), left["bound"].to_numpy(), x, _matrix(right["p"]), k + 1, norm, quantile))
            if not got:
                return out([], [], [])
            who, rows, score = (np.concatenate(g) for g in zip(*got, strict=True))
            o = np.lexsort((ids[rows], -score, who))
            who, rows, score = who[o], rows[o], score[o]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            # ties within rounding of the last score stay, so that ids decide later
            last = np.full(left.num_rows, -np.inf)
            np.maximum.at(last, who[rank == k], score[rank == k])
            keep = score >= last[who] - 1e-9 * norm * norm
            return out(left["query"].combine_chunks().take(pa.array(who[keep])), ids[rows[keep]], score[keep])

        def out(query, ids, score) -> pa.Table:
            return pa.table({"query": pa.array(query, pa.string()), "id": pa.array(ids, pa.int64()), "near": pa.array(score, pa.float64())})

        keys = ("cell", "part", "share")
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(block, "query string, id long, near double")

    def foremost(found: DataFrame) -> DataFrame:
        """Each query's k + 1 best, and all that tie with the last of them within rounding; ``last`` is that one's score."""
        each = Window.partitionBy("query")
        numbered = found.withColumn("n", F.row_number().over(each.orderBy(F.desc("near"), "id")))
        held = numbered.withColumn("last", F.max(F.when(F.col("n") == k + 1, F.col("near"))).over(each))
        return held.where((F.col("n") <= k + 1) | (F.col("near") >= F.col("last") - F.lit(1e-9 * norm * norm))).drop("n")

    ranked = written(foremost(meet(asked_vectors, "first")), "ann-first")
    bounds = ranked.groupBy("query").agg(F.max("last").alias("bound"))
    again = asked_vectors.join(bounds, "query", "left").select("query", "x", F.coalesce("bound", F.lit(-norm * norm)).alias("bound"))
    both = meet(again, "second").union(ranked.drop("last")).groupBy("query", "id").agg(F.max("near").alias("near"))  # what the first turn found stays
    nearby = foremost(both).select("query", "id")
    # scores come from the original vectors, component by component in order, so that equal pairs have equal scores
    vectors = kept.select("id", F.col("x").alias("y"))
    exact = (
        nearby.join(vectors, "id")
        .join(asked_vectors, "query")
        .select("query", "id", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c).alias("score"))
    )
    answers = asked.withColumnRenamed("id", "query_id").join(exact, F.col("same") == F.col("query")).where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")

