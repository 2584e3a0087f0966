"""N-gram Jaccard join by vertical partitioning.

1. Every text's set of shingle hashes is made; equal sets are one class, of which only one text goes on.
2. What can't link goes: a set of which less than the threshold's share of shingles occurs anywhere else links with nothing.
   Occurrences are counted by hash range over all texts; a range's shingles travel as packed 32-bit remainders, and only
   counts for each text travel back. (Remainders that coincide by chance only keep a text that could have gone.)
3. All shingles of what is left have a global order, rare ones first. It is cut into fragments, each handled apart: within
   a fragment, sets that share a shingle of their prefixes are candidate pairs.
4. The sets are cut vertically, too, to count overlaps: each fragment counts the partial overlaps of the candidate pairs, and
   these are summed for each pair and compared with the threshold, in whole numbers.
5. Links are made in two turns, so that a group of thousands of near copies isn't expanded into all its pairs. First each
   set is compared with its neighbours in the lists only; then only pairs of sets of different components are, all of them.
   Links that the second turn leaves out lie within one component already.

Defined results: a null text counts as an empty one; texts without words have an empty set, link with nothing, and are
their own component; 64-bit hashes stand for shingles, and 128-bit digests for sets; rows with a null id take no part and have no component; rows that repeat an id are each answered; ties
don't occur, as links are symmetric; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import beside, texts, written
from leafloom.llm.components import components
from leafloom.llm.shingles import mixed, sets

RANGE = 2_000_000  # shingles in a hash range
ENTRIES = 250_000  # of prefixes in a fragment
BLOCK = 512  # texts in a block
LEVELS = 32  # of frequency
HELD_CODES, COMPARED = 1_000_000, 100_000  # pairs of places that a task holds before it counts them, and pairs whose levels are compared at once
PAIRS = 500_000  # candidate pairs that are counted together
FRAGMENTS = 4  # in which their overlaps are counted
BROADCAST = 1_000_000  # ids that may be broadcast, 8 bytes each


def digests(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """A set's class and a second digest that tells apart sets of one class. Empty sets have 0."""
    found = blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest() if len(s) else bytes(16)
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def class_of(s: np.ndarray, salt: int = 0) -> int:
    """An id for a set: equal sets, equal ids. Empty sets have 0."""
    return digests(s, salt)[0]


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", salt: int = 0) -> DataFrame:
    """doc_id, n (set size), cls, more (second digest) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, more = [], [], []
            for s in sets(b.column(1)):
                n.append(len(s))
                for held, x in zip((cls, more), digests(s, salt), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(more, pa.int64())], ["doc_id", "n", "cls", "more"])

    kind = documents.schema[id_column].dataType.simpleString()
    return texts(documents, id_column, text_column).withColumnRenamed(id_column, "doc_id").mapInArrow(run, f"doc_id {kind}, n long, cls long, more long")


def _ranges(h: np.ndarray, count: int) -> np.ndarray:
    """The hash range of each hash: ranges cut the hashes' order evenly."""
    return ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts of one piece in as few bytes each as hold the largest: their width is told by the number of them."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _counts(data: bytes, n: int) -> np.ndarray:
    """n packed counts."""
    return np.frombuffer(data, f"u{max(1, len(data) // max(1, n))}").astype(np.int64)


def promising(documents: DataFrame, total: int, share: int, text_column: str = "text", salt: int = 0) -> DataFrame:
    """cls of the sets of which ``share`` hundredths of the shingles occur in another row's set, too.

    A block of sets sends a piece to each range that it has shingles in: fewer pieces than shingles, whatever the sizes. The more
    ranges, the fewer of a set's shingles lie in one, so that places of sets (two bytes, as a block has 4,096 at most) and their
    counts (mostly one byte) come to stand beside each shingle.
    """
    parts = max(8, math.ceil(total / RANGE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, k = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            sizes = np.array([len(s) for s in held], np.int64)
            names = np.array([class_of(s, salt) for s in held], np.int64)
            place, doc = _ranges(every, parts), np.repeat(np.arange(len(held)), sizes)
            o = np.argsort(place, kind="stable")  # sets follow one another within a range
            place, doc, low = place[o], doc[o], every.astype(np.uint32)[o]
            runs = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
            counts = np.diff(np.concatenate([runs, [len(place)]])).astype(np.uint32)
            docs, of_run = doc[runs].astype(np.uint16), place[runs]
            piece = np.flatnonzero(np.concatenate([[True], of_run[1:] != of_run[:-1]]))
            ends = np.concatenate([piece[1:], [len(runs)]])
            at = np.concatenate([runs, [len(place)]])
            block = number << 32 | k
            held.clear()
            for x in range(0, len(piece), 10_000):
                p, e = piece[x : x + 10_000].tolist(), ends[x : x + 10_000].tolist()
                first = [x == 0 and i == 0 for i in range(len(p))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of_run[p]),
                        pa.array(np.full(len(p), block)),
                        pa.array([docs[i:j].tobytes() for i, j in zip(p, e, strict=True)], pa.binary()),
                        pa.array([_packed(counts[i:j]) for i, j in zip(p, e, strict=True)], pa.binary()),
                        pa.array([low[at[i] : at[j]].tobytes() for i, j in zip(p, e, strict=True)], pa.binary()),
                        pa.array([names.tobytes() if f else None for f in first], pa.binary()),
                        pa.array([sizes.tobytes() if f else None for f in first], pa.binary()),
                    ],
                    ["part", "block", "docs", "counts", "low", "names", "sizes"],
                )

        size = 0
        for b in batches:
            for s in sets(b.column(0)):
                if len(s):
                    held.append(s)
                    size += len(s)
                if len(held) >= 8 * BLOCK or size > RANGE:
                    yield from out()
                    k, size = k + 1, 0
        if held:
            yield from out()

    def shared(rows: pa.Table) -> pa.Table:
        low = [np.frombuffer(x.as_py(), np.uint32) for x in rows["low"]]
        every = np.concatenate(low)
        order = np.argsort(every, kind="stable")
        found = every[order]
        again = np.zeros(len(every), bool)
        same = found[1:] == found[:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out, at = [], 0
        for docs, counts in zip(rows["docs"], rows["counts"], strict=True):
            c = _counts(counts.as_py(), len(docs.as_py()) // 2)
            total = np.concatenate([[0], np.cumsum(again[at : at + c.sum()])])
            ends = np.cumsum(c)
            out.append(_packed(total[ends] - total[ends - c]))
            at += int(c.sum())
        return pa.table({"block": rows["block"], "docs": rows["docs"], "shared": pa.array(out, pa.binary()), "names": rows["names"], "sizes": rows["sizes"]})

    def summed(rows: pa.Table) -> pa.Table:
        at = next(i for i, x in enumerate(rows["names"]) if x.is_valid)
        names, sizes = np.frombuffer(rows["names"][at].as_py(), np.int64), np.frombuffer(rows["sizes"][at].as_py(), np.int64)
        n = np.zeros(len(names), np.int64)
        for docs, x in zip(rows["docs"], rows["shared"], strict=True):
            places = np.frombuffer(docs.as_py(), np.uint16)
            n[places] += _counts(x.as_py(), len(places))
        return pa.table({"cls": pa.array(np.unique(names[100 * n >= share * sizes]), pa.int64())})

    cuts = texts(documents.withColumn("_", F.lit(0)), "_", text_column).select(text_column).mapInArrow(cut, "part long, block long, docs binary, counts binary, low binary, names binary, sizes binary")
    counted = cuts.groupBy("part").applyInArrow(shared, "block long, docs binary, shared binary, names binary, sizes binary")
    return counted.groupBy("block").applyInArrow(summed, "cls long").distinct()


def block_sets(documents: DataFrame, chosen: DataFrame, n_chosen: int, salt: int = 0) -> DataFrame:
    """block, names, sizes, hashes: the sets of the chosen rows (doc_id, cls), packed in blocks."""
    docs = texts(documents).where("doc_id is not null")
    kept = docs.join(F.broadcast(chosen) if n_chosen <= BROADCAST else chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, k = TaskContext.get().partitionId(), 0
        names: list[int] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in held], np.int64)
            row = [number << 32 | k, np.array(names, np.int64).tobytes(), sizes.tobytes(), np.concatenate(held).tobytes()]
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "names", "sizes", "hashes"])

        size = 0
        for b in batches:
            for cls, s in zip(b.column(1).to_pylist(), sets(b.column(0)), strict=True):
                if class_of(s, salt) == cls:  # rows may repeat an id with another text
                    names.append(cls)
                    held.append(s)
                    size += len(s)
                if len(held) >= BLOCK or size > RANGE:
                    yield out()
                    k, size = k + 1, 0
        if held:
            yield out()

    return kept.select("text", "cls").mapInArrow(run, "block long, names binary, sizes binary, hashes binary")


def prefixes(blocks: DataFrame, total: int, share: int) -> DataFrame:
    """cls, n, held, keys, often: of each set how many shingles other sets have, too; those of its prefix, and how many sets have them.

    Frequencies are counted exactly, by hash range, and go back to the blocks in the order of the blocks' distinct hashes.
    """
    parts = max(4, math.ceil(total / RANGE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                u, c = np.unique(np.frombuffer(data.as_py(), np.uint64), return_counts=True)
                place, at = np.unique(_ranges(u, parts), return_index=True)  # hashes are in order, so each range is one run
                cuts = [(u[x:y], c[x:y].astype(np.uint32)) for x, y in zip(at.tolist(), [*at[1:].tolist(), len(u)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array([block] * len(place), pa.int64()), pa.array([x.tobytes() for x, _ in cuts], pa.binary()), pa.array([x.tobytes() for _, x in cuts], pa.binary())], ["part", "block", "hashes", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_py(), np.uint64) for x in rows["hashes"]]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows["counts"]])
        _, place = np.unique(np.concatenate(each), return_inverse=True)
        often = np.bincount(place, counts).astype(np.uint32)[place] if len(place) else np.zeros(0, np.uint32)
        ends = np.cumsum([len(x) for x in each])
        return pa.table({"block": rows["block"], "part": rows["part"], "often": pa.array([often[e - len(x) : e].tobytes() for e, x in zip(ends, each, strict=True)], pa.binary())})

    def take(block: pa.Table, counted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"cls": [], "n": [], "held": [], "keys": [], "often": []}
        if block.num_rows:
            rows = sorted(zip(counted["part"].to_pylist(), counted["often"].to_pylist(), strict=True))
            often = np.concatenate([np.frombuffer(x, np.uint32) for _, x in rows])
            h = np.frombuffer(block["hashes"][0].as_py(), np.uint64)
            u, place = np.unique(h, return_inverse=True)
            every = often[place]
            names, sizes = np.frombuffer(block["names"][0].as_py(), np.int64), np.frombuffer(block["sizes"][0].as_py(), np.int64)
            end = 0
            for cls, n in zip(names.tolist(), sizes.tolist(), strict=True):
                s, f = h[end : end + n], every[end : end + n]
                end += n
                long = n - (share * n + 99) // 100 + 1
                o = np.lexsort((s, f))[:long]
                o = o[f[o] > 1]
                if len(o):
                    for name, x in (("cls", cls), ("n", n), ("held", int((f > 1).sum())), ("keys", s[o].tobytes()), ("often", f[o].tobytes())):
                        out[name].append(x)
        return pa.table({"cls": pa.array(out["cls"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "held": pa.array(out["held"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()), "often": pa.array(out["often"], pa.binary())})

    counted = blocks.select("block", "hashes").mapInArrow(cut, "part long, block long, hashes binary, counts binary").groupBy("part").applyInArrow(add, "block long, part long, often binary")
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(take, "cls long, n long, held long, keys binary, often binary")


def level(often: np.ndarray) -> np.ndarray:
    """The global order's levels: shingles by their frequency's power of two, rare ones first."""
    return np.minimum(LEVELS - 1, np.log2(often).astype(np.int64))


def level_ranges(prefix: DataFrame) -> list[int]:
    """Into how many hash ranges each level is cut, by how many entries it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(LEVELS, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(level(np.frombuffer(x.as_py(), np.uint32)), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(n)], ["level", "n"])

    found = {r.level: r.n for r in prefix.select("often").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    return [max(1, math.ceil(found.get(k, 0) / ENTRIES)) for k in range(LEVELS)]


def candidates(prefix: DataFrame, share: int, ranges: list[int], turn: str) -> DataFrame:
    """u, v: candidate pairs, each fragment of the global order apart. prefix: cls, n, held, keys, often, root.

    turn "near": neighbours in the lists, by size and by chance, and the two sets of a list that share most, with all of it;
    "all": every pair of different roots. Pairs that can't link are no candidates: for their sizes, because too few of their
    shingles occur anywhere else, or because of the overlap of their prefixes: it is counted for the fragment, and for the
    others bounded by how many entries both sets have in each level.
    """
    begin_of = np.concatenate([[0], np.cumsum(ranges)])
    parts = np.array(ranges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(3)]
            row = np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
            key = np.concatenate(keys)
            at_level = level(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in b.column(4)]))
            place = begin_of[at_level] + ((key >> np.uint64(32)) * parts[at_level].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            levels = np.bincount(row * LEVELS + at_level, minlength=b.num_rows * LEVELS).astype(np.int32).reshape(-1, LEVELS)
            o = np.argsort(place, kind="stable")
            found, at = np.unique(place[o], return_index=True)
            columns = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 5)], 1)
            out: list[list] = [[], [], [], [], []]
            for f, x, y in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(o)], strict=True):
                c = o[x:y]
                docs, counts = np.unique(row[c], return_counts=True)
                for held, v in zip(out, (f, key[c].tobytes(), counts.tobytes(), columns[docs].tobytes(), levels[docs].tobytes()), strict=True):
                    held.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["fragment", "keys", "counts", "sets", "levels"])

    def pairs(rows: pa.Table) -> pa.Table:
        def whole(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows[name]])

        key, counts = whole("keys", np.uint64), whole("counts", np.int64)
        cls, n, held, root = whole("sets", np.int64).reshape(-1, 4).T
        levels = whole("levels", np.int32).reshape(-1, LEVELS)
        here = int(np.searchsorted(begin_of, rows["fragment"][0].as_py(), "right")) - 1
        apart = levels.copy()
        apart[:, here] -= counts.astype(np.int32)  # entries outside this fragment
        rest = (share * n + 99) // 100 - 1  # shingles after the prefix
        d = len(cls)
        member = np.repeat(np.arange(d), counts)
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def sized(i: np.ndarray, j: np.ndarray) -> None:
            most = np.minimum(np.minimum(held[i], held[j]), np.minimum(n[i], n[j]))  # of shingles that both can have
            ok = 100 * most >= share * (n[i] + n[j] - most)
            waiting.append(np.minimum(i, j)[ok] * d + np.maximum(i, j)[ok])

        def settle() -> None:
            nonlocal codes, times
            every = np.concatenate([codes, *waiting])
            number = np.concatenate([times, np.ones(len(every) - len(codes), np.int64)])
            waiting.clear()
            codes, place = np.unique(every, return_inverse=True)
            times = np.bincount(place, number, len(codes)).astype(np.int64)

        if turn == "near":
            for by in (n, mixed(cls.view(np.uint64) + np.uint64(1)), mixed(cls.view(np.uint64) + np.uint64(2))):
                o = np.lexsort((cls[member], by[member], key))
                same = np.flatnonzero(key[o][1:] == key[o][:-1])
                sized(member[o[same]], member[o[same + 1]])
            o = np.lexsort((cls[member], (-held / n)[member], key))
            k, m = key[o], member[o]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            begin = np.flatnonzero(first)[np.cumsum(first) - 1]
            for hub in (begin, np.minimum(begin + 1, len(o) - 1)):
                other = np.flatnonzero((k[hub] == k) & (m[hub] != m))
                sized(m[hub[other]], m[other])
            settle()
        else:
            o = np.lexsort((cls[member], n[member], root[member], key))
            k, m = key[o], member[o]
            runs = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            ends = np.concatenate([runs[1:], [len(o)]])
            roots = root[m]
            apart_runs = np.minimum.reduceat(roots, runs) != np.maximum.reduceat(roots, runs) if len(runs) else np.zeros(0, bool)
            runs, ends = runs[apart_runs], ends[apart_runs]
            short = ends - runs <= 32
            # short lists all at once: each place with the one a step further, step by step
            sizes = (ends - runs)[short]
            at = np.repeat(runs[short] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            until = np.repeat(ends[short], sizes)
            for step in range(1, 32):
                at, until = at[at + step < until], until[at + step < until]
                if not len(at):
                    break
                i, j = m[at], m[at + step]
                sized(i[root[i] != root[j]], j[root[i] != root[j]])
            for a, b in zip(runs[~short].tolist(), ends[~short].tolist(), strict=True):
                where = m[a:b]
                by_size = where[np.argsort(n[where], kind="stable")]
                sizes = n[by_size]
                for i in where.tolist():
                    # sets of other components, not smaller than this one (of equal ones the later), and of a size that fits
                    low, high = np.searchsorted(sizes, n[i], "left"), np.searchsorted(sizes, 100 * n[i] // share, "right")
                    others = by_size[low:high]
                    others = others[(root[others] != root[i]) & ((n[others] > n[i]) | (others > i))]
                    if len(others):
                        sized(np.full(len(others), i), others)
                if sum(map(len, waiting)) > HELD_CODES:
                    settle()
            settle()
            kept = []
            for x in range(0, len(codes), COMPARED):
                i, j = codes[x : x + COMPARED] // d, codes[x : x + COMPARED] % d
                most = times[x : x + COMPARED] + np.minimum(apart[i], apart[j]).sum(1) + np.maximum(rest[i], rest[j])
                kept.append(100 * most >= share * (n[i] + n[j] - most))
            codes = codes[np.concatenate(kept)] if kept else codes
        u, v = cls[codes // d], cls[codes % d]
        return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})

    cuts = prefix.select("cls", "n", "held", "keys", "often", "root").mapInArrow(cut, "fragment long, keys binary, counts binary, sets binary, levels binary")
    return cuts.groupBy("fragment").applyInArrow(pairs, "u long, v long").distinct()


def linked(pairs: DataFrame, blocks: DataFrame, total: int, share: int, n_pairs: int) -> DataFrame:
    """The pairs whose overlap reaches the threshold: partial overlaps of each fragment, summed for each pair.

    The order is cut into a fixed number of fragments; what grows with the data is the number of groups of pairs. total: the
    shingles of all pairs' sets.
    """
    fragments = FRAGMENTS
    groups = max(1, math.ceil(n_pairs / PAIRS), math.ceil(total / (FRAGMENTS * 4 * RANGE)))
    grouped = pairs.withColumn("share", F.pmod(F.xxhash64("u", "v"), F.lit(groups)))
    ends = grouped.select("share", F.col("u").alias("cls")).union(grouped.select("share", F.col("v").alias("cls"))).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                h = np.frombuffer(row["hashes"], np.uint64)
                end = 0
                out: list[list] = [[], [], [], []]
                for cls, n in zip(np.frombuffer(row["names"], np.int64).tolist(), np.frombuffer(row["sizes"], np.int64).tolist(), strict=True):
                    s = h[end : end + n]
                    end += n
                    at = np.searchsorted(_ranges(s, fragments), np.arange(fragments + 1))
                    for f in range(fragments):  # empty ones, too: a pair finds both sets in every fragment
                        for x, y in zip(out, (f, cls, n, s[at[f] : at[f + 1]].tobytes()), strict=True):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["fragment", "cls", "n", "hashes"])

    segments = blocks.select("names", "sizes", "hashes").mapInArrow(cut, "fragment long, cls long, n long, hashes binary").join(ends, "cls").select(F.col("fragment").alias("f"), F.col("share").alias("g"), "cls", "n", "hashes")
    spread = grouped.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1)))).select(F.col("fragment").cast("long").alias("fragment"), F.col("share").alias("share"), F.col("u").alias("u"), F.col("v").alias("v"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        u, v = left["u"].to_numpy(), left["v"].to_numpy()
        if not len(u):
            return pa.table({c: pa.array([], pa.int64()) for c in ("u", "v", "both", "n")})
        cls, size = right["cls"].to_numpy(), right["n"].to_numpy()
        o = np.argsort(cls)
        parts = [np.frombuffer(right["hashes"][int(i)].as_py(), np.uint64) for i in o]
        long = np.array([len(p) for p in parts], np.int64)
        _, place = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
        begin = np.cumsum(long) - long
        i, j = np.searchsorted(cls[o], u), np.searchsorted(cls[o], v)
        n = np.zeros(len(u), np.int64)
        wide = int(place.max()) + 1 if len(place) else 1
        step = max(1, HELD_CODES // max(1, int(long.max()) if len(long) else 1))

        def keys(x: np.ndarray) -> np.ndarray:
            size = long[x]
            run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            return np.repeat(np.arange(len(x)), size) * wide + place[np.repeat(begin[x], size) + run]

        for k in range(0, len(u), step):
            a, b = keys(i[k : k + step]), keys(j[k : k + step])
            if len(a) and len(b):
                hit = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
                n[k : k + step] = np.bincount(a[hit] // wide, minlength=len(i[k : k + step]))
        return pa.table({"u": left["u"], "v": left["v"], "both": pa.array(n, pa.int64()), "n": pa.array(size[o][i] + size[o][j], pa.int64())})

    partial = spread.groupBy("fragment", "share").cogroup(segments.groupBy("f", "g")).applyInArrow(count, "u long, v long, both long, n long")
    return partial.groupBy("u", "v").agg(F.sum("both").alias("both"), F.max("n").alias("n")).where(F.col("both") * 100 >= (F.col("n") - F.col("both")) * share).select("u", "v")


def ngram_components(documents: DataFrame, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; share: the least similarity in hundredths."""
    salt = 0
    while True:
        known = written(classes(documents, salt=salt), "classes")
        kinds = known.where("doc_id is not null and n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("more").alias("low"), F.max("more").alias("high"))
        facts = kinds.agg(F.count_if(F.col("low") != F.col("high")).alias("clashes"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
        if not facts.clashes:
            break
        salt += 1  # two sets of one class: all are digested anew
    total = known.agg(F.sum("n")).first()[0] or 0
    roots = None
    if total:
        near = written(kinds.select("cls", "doc_id", "n").join(promising(documents, total, share, salt=salt), "cls", "left_semi"), "promising")
        facts = near.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
        if facts.k:
            blocks = written(block_sets(documents, near.select("doc_id", "cls"), facts.k, salt), "blocks")
            prefix = written(prefixes(blocks, facts.n, share), "prefixes")
            fragments = level_ranges(prefix)

            def confirmed(pairs: DataFrame) -> DataFrame | None:
                n = pairs.count()
                return linked(pairs, blocks, math.ceil(2 * n * facts.n / facts.k), share, n) if n else None

            first = written(candidates(prefix.withColumn("root", F.col("cls")), share, fragments, "near"), "pairs")
            links = confirmed(first)
            found = components(links if links is not None else first)
            rooted = prefix.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
            more = confirmed(written(candidates(rooted, share, fragments, "all"), "pairs"))
            if more is not None:
                found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
            roots = found.select(F.col("node").alias("cls"), "root")
    labelled = kinds.select("cls", "doc_id")
    if roots is not None:
        labelled = written(labelled.join(roots, "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root")), "roots")
        least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        labelled = beside(labelled, least, "root").select("cls", "component_id")
    else:
        labelled = labelled.select("cls", F.col("doc_id").alias("component_id"))
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return beside(known.select("doc_id", "n", "cls"), labelled, "cls").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(documents: DataFrame, share: int = 80) -> DataFrame:
    """The rows of the smallest id of each group, with all their columns; rows without an id stay; rows equal in id and text count once."""
    found = written(ngram_components(documents, share), "components")
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    facts = found.agg(F.count("doc_id").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    named = documents.where("doc_id is not null").join(F.broadcast(kept) if facts.ids <= BROADCAST else kept, "doc_id", "left_semi")
    if facts.rows > facts.ids:
        named = named.dropDuplicates(["doc_id", "text"])
    return named.select(*documents.columns).union(documents.where("doc_id is null"))
