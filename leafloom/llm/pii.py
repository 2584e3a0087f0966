"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Base spans (email, ip, card, phone) are found by fixed patterns with their checks; they are given, and each is a node of the
field with its label. The other nodes are open: runs of at least seven digits in any notation, tokens with ``@``, and words
that may name the owner of an address (its whole name part, or one of the part's names: capitalised, not at a sentence's
beginning, and never in small letters in the text). The labels are the four kinds and none.

Neighbouring nodes share a chain potential. All nodes of a document that repeat one another or are alike (the same digits in
another notation, an address and its name part) share one hub, however far apart and however many they are, and each node
shares a skip potential with its hubs. Nodes of one string are one variable: a notation is missed once, not at each place. Loopy sum-product messages run over both kinds of edges until they no longer change
and so carry a label that is certain in one place to all others; numbers and tokens with ``@`` whose belief in a kind reaches ``SURE``
become spans. Names only inform them: a name is none of the kinds.

The potentials are fitted to the conditional likelihood of each node's base label given its class and its neighbours' and
twins' labels, over all documents with a digit or ``@``; copies count each. A class tells a node's size and sort, but not
whether the pattern matched, so that the twins' labels have something to tell. Twins are the same string here; alike ones
take the same potential. Gaussian priors of variance 1 stand around no preference, but for the skip potential, which
prefers equal labels by ``CONSISTENT``. Two potentials can't be fitted to base labels and are fixed: that of words (``WORD``),
and that of an open node to be of a kind though the kind's pattern missed it (``MISSED``).

Defined results: a null text counts as an empty one and has no spans; repeated rows get equal results; offsets are code
points, ends exclusive; an empty table gives an empty result; other columns are ignored (``redact`` keeps them, and the
types of those that it changes).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import slices, texts

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9  # belief from which a node's label is taken
CONSISTENT = 4.0  # log odds by which repeats have equal labels before any are counted
MISSED = -5.0  # log odds that a pattern misses what it is for; every kind of an open node bears it
WORD = (0.0, 4.5, -8.0, -8.0, -8.0)  # log potential of a word that may name an address's owner
CLOSE, LONGEST = 1e-4, 100  # change of the messages that ends them; rounds after which oscillating ones are left as they are
CLASSES = ("@", "@ bare", "quad", "7-9", "10-13", "14-19", "14-19 fails", "20-", "local", "name")

WORDLIKE = CLASSES.index("local")  # from here on a node is a word, and never becomes a span

Span = tuple[int, int, str]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TELLING = re.compile(r"[0-9@]")
AT = re.compile(r"[^\s@]*@\S*")
RUN = re.compile(r"(?<![0-9A-Za-z@.])[+(]?[0-9](?:[ ().-]{0,2}[0-9])*+")
WORDS = re.compile(r"[^\W_](?:[\w.%+-]*[^\W_])?")
NAMES = re.compile(r"[^\W\d_]{3,}")
GAP = re.compile(r"[\s<(\[:,;\"'-]{0,3}")
EDGE = ".,;:!?\"'#*&%$()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Every ``@`` once: the run of name characters before it, back to the last address, and the domain after it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        if (found := DOMAIN.match(text, at + 1)) is not None:
            begin = at
            while begin > floor and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at:
                out.append((begin, found.end(), "email"))
                floor = found.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def number_class(digits: str) -> int:
    n = len(digits)
    if n < 14:
        return CLASSES.index("7-9" if n < 10 else "10-13")
    return CLASSES.index("20-" if n > 19 else "14-19" if luhn(digits) else "14-19 fails")


def number_keys(digits: str) -> list[str]:
    """Numbers are alike in all digits, or, as those of telephones are written, in the last ten or seven."""
    out = [f"n {digits}"] if 7 <= len(digits) <= 19 else []
    if 7 <= len(digits) <= 15:
        out += [f"n {digits[-k:]}" for k in (10, 7) if len(digits) > k]
    return out


def name_keys(local: str) -> list[str]:
    out = [f"l {local}"] if len(local) >= 4 else []
    return out + [f"w {x}" for x in set(NAMES.findall(local))]


@dataclass
class Graph:
    """Nodes of one text, and its edges. A given label is a base span's, -1 is open. Nodes of one string are one variable."""

    spots: list[tuple[int, int]]
    variable: list[int]
    classes: list[int]
    given: list[int]
    chain: list[tuple[int, int]]
    hubs: list[list[int]]  # the nodes of each


def graph(text: str, base: list[Span]) -> Graph:
    found: list[tuple[int, int, int, int, list[str]]] = []
    locals_, names = set(), set()
    for a, b, kind in base:
        t = text[a:b]
        if kind == "email":
            local = t.split("@")[0].lower()
            keys = [f"t {t.lower()}", *name_keys(local)]
            locals_.add(local)
            names.update(NAMES.findall(local))
            c = CLASSES.index("@")
        elif kind == "ip":
            keys, c = [f"t {t}"], CLASSES.index("quad")
        else:
            d = digits_of(t)
            keys, c = number_keys(d), number_class(d)
        found.append((a, b, c, 1 + KINDS.index(kind), keys))
    begins, ends, far = [x[0] for x in base], [], 0
    for x in base:
        ends.append(far := max(far, x[1]))

    def taken(a: int, b: int) -> bool:
        k = bisect_right(begins, b - 1)
        return k > 0 and ends[k - 1] > a

    for m in RUN.finditer(text):
        d = digits_of(m[0])
        if len(d) >= 7 and not taken(m.start(), m.end()):
            found.append((m.start(), m.end(), number_class(d), -1, number_keys(d)))
    if "@" in text:
        for m in AT.finditer(text):
            a, b = m.start(), m.end()
            while a < b and text[a] in EDGE:
                a += 1
            while b > a and text[b - 1] in EDGE:
                b -= 1
            if "@" in text[a:b] and not taken(a, b):
                t = text[a:b].lower()
                found.append((a, b, CLASSES.index("@ bare"), -1, [f"t {t}", *name_keys(t.split("@")[0] or t[1:])]))
    if locals_:
        words = [(m.start(), m.end(), m[0]) for m in WORDS.finditer(text)]
        small = {w for _, _, w in words if w in names}
        for a, b, w in words:
            low = w.lower()
            if low in locals_ and not low.isalpha() and not taken(a, b):
                found.append((a, b, CLASSES.index("local"), -1, [f"l {low}"]))
            elif low in names and low not in small and w[0].isupper() and not taken(a, b):
                before = text[max(0, a - 8) : a].rstrip(" ")
                if before and before[-1] not in ".!?\n":
                    found.append((a, b, CLASSES.index("name"), -1, [f"w {low}"]))
    found.sort(key=lambda x: (x[0], x[1], x[2]))
    spots = [(x[0], x[1]) for x in found]
    chain = [(i, i + 1) for i in range(len(found) - 1) if 0 <= spots[i + 1][0] - spots[i][1] <= 3 and GAP.fullmatch(text, spots[i][1], spots[i + 1][0])]
    hubs: dict[str, list[int]] = {}
    for i, x in enumerate(found):
        for k in x[4]:
            hubs.setdefault(k, []).append(i)
    numbers: dict[tuple, int] = {}
    variable = [numbers.setdefault((text[x[0] : x[1]].lower(), x[2], x[3]), len(numbers)) for x in found]
    return Graph(spots, variable, [x[2] for x in found], [x[3] for x in found], chain, [h for h in hubs.values() if len(h) > 1])


@dataclass
class Field:
    """Log potentials."""

    node: np.ndarray = field(default_factory=lambda: np.zeros((len(CLASSES), 5)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))
    skip: np.ndarray = field(default_factory=lambda: np.eye(5) * CONSISTENT)

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals of the nodes by loopy message passing; exact where the edges form no loop."""
        if not g.spots:
            return np.zeros((0, 5))
        variable, first = np.unique(g.variable, return_index=True)
        n = len(variable)
        unary = np.zeros((n + len(g.hubs), 5))
        unary[:n] = self.node[np.array(g.classes)[first]]
        given = np.array(g.given, np.int64)[first]
        unary[np.flatnonzero(given < 0), 1:] += MISSED
        known = np.flatnonzero(given >= 0)
        unary[known] = -60.0
        unary[known, given[known]] = 0.0
        chain = sorted({(g.variable[i], g.variable[j]) for i, j in g.chain if g.variable[i] != g.variable[j]})
        skips = [(i, n + h) for h, held in enumerate(g.hubs) for i in sorted({g.variable[k] for k in held})]
        edges = np.array([*chain, *skips], np.int64).reshape(-1, 2)
        m = len(edges)
        if not m:
            return _normal(unary)[g.variable]
        table = np.empty((2 * m, 5, 5))
        table[: len(chain)] = self.chain
        table[len(chain) : m] = self.skip
        table[m:] = table[:m].transpose(0, 2, 1)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        messages = np.zeros((2 * m, 5))
        for _ in range(LONGEST):
            total = unary.copy()
            np.add.at(total, target, messages)
            into = total[source] - messages[back]
            new = np.logaddexp.reduce(into[:, :, None] + table, axis=1)
            new -= new.max(1, keepdims=True)
            new = 0.5 * messages + 0.5 * new
            change = np.abs(new - messages).max()
            messages = new
            if change < CLOSE:
                break
        total = unary.copy()
        np.add.at(total, target, messages)
        return _normal(total[:n])[g.variable]


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True)) if len(logs) else logs
    return p / p.sum(1, keepdims=True) if len(logs) else p


def cases(text: str, g: Graph) -> Counter:
    """(class, label before, label after, twins' label, own label) of each node that base labels tell of; 5 is no neighbour, or no twin."""
    own = [max(0, x) for x in g.given]
    before, after = {b: own[a] for a, b in g.chain}, {a: own[b] for a, b in g.chain}
    twins: dict[str, Counter] = {}
    for i, (a, b) in enumerate(g.spots):
        twins.setdefault(text[a:b], Counter())[own[i]] += 1
    out: Counter = Counter()
    for i, (a, b) in enumerate(g.spots):
        if g.classes[i] < CLASSES.index("local"):
            held = twins[text[a:b]]
            others = [y for y in sorted(held, key=lambda y: (-held[y], y)) if held[y] > (y == own[i])]
            out[g.classes[i], before.get(i, 5), after.get(i, 5), others[0] if others else 5, own[i]] += 1
    return out


CASE = ("class", "before", "after", "twin", "own")


def learn(documents: DataFrame) -> Field:
    """The field fitted to all documents. Their cases are counted by executors; there are len(CLASSES) * 6 * 6 * 6 * 5 kinds at most."""
    rows = texts(documents).select("text").where(F.col("text").rlike("[0-9@]"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                t = text.as_py()
                found += cases(t, graph(t, base_spans(t)))
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(list(found.values()), pa.int64())], [*CASE, "n"])

    counts = rows.mapInArrow(count, ", ".join(f"{c} int" for c in CASE) + ", n long").groupBy(*CASE).agg(F.sum("n").alias("n"))
    return fitted(Counter({tuple(r)[:5]: r.n for r in counts.collect()}))


def fitted(counts: Counter) -> Field:
    """Newton steps on the conditional log likelihood less the priors."""
    out = Field()
    out.node[CLASSES.index("local") :] = WORD
    if not counts:
        return out
    kinds = len(CLASSES)
    rows = np.array(sorted(counts), np.int64)
    n = np.array([counts[tuple(r)] for r in rows.tolist()], float)
    size = 5 * kinds + 50
    design = np.zeros((len(rows), 5, size), np.float32)
    at = np.arange(len(rows))
    for y in range(5):
        design[at, y, 5 * rows[:, 0] + y] = 1
        for column, place in ((1, lambda z, y=y: 5 * kinds + 5 * z + y), (2, lambda z, y=y: 5 * kinds + 5 * y + z), (3, lambda z, y=y: 5 * kinds + 25 + 5 * z + y)):
            on = np.flatnonzero(rows[:, column] < 5)
            np.add.at(design, (on, y, place(rows[on, column])), 1)
    center = np.concatenate([np.zeros(5 * kinds + 25), (np.eye(5) * CONSISTENT).ravel()])
    w = center.copy()

    def value(w: np.ndarray) -> float:
        z = design @ w
        top = z.max(1)
        return float((n * (z[at, rows[:, 4]] - top - np.log(np.exp(z - top[:, None]).sum(1)))).sum() - 0.5 * ((w - center) ** 2).sum())

    now = value(w)
    for _ in range(60):
        p = _normal(design @ w)
        hot = np.eye(5)[rows[:, 4]]
        g = np.einsum("r,ry,ryk->k", n, hot - p, design, optimize=True) - (w - center)
        mean = np.einsum("ry,ryk->rk", p, design)
        flat = design * np.sqrt(n[:, None] * p)[:, :, None]
        h = flat.reshape(-1, size).T @ flat.reshape(-1, size) - (mean * n[:, None]).T @ mean + np.eye(size)
        step, t = np.linalg.solve(h, g), 1.0
        while (new := value(w + t * step)) < now and t > 1e-6:
            t /= 2
        w, gain, now = w + t * step, new - now, new
        if gain < 1e-9 * max(1.0, abs(now)):
            break
    words = out.node.copy()
    out.node = w[: 5 * kinds].reshape(kinds, 5).copy()
    out.node[CLASSES.index("local") :] = words[CLASSES.index("local") :]
    out.chain = w[5 * kinds : 5 * kinds + 25].reshape(5, 5)
    skip = w[5 * kinds + 25 :].reshape(5, 5)
    out.skip = (skip + skip.T) / 2
    return out


def all_spans(text: str, crf: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans)."""
    if not TELLING.search(text):
        return [], []
    base = base_spans(text)
    g = graph(text, base)
    if -1 not in g.given:
        return base, base
    belief = crf.beliefs(g)
    best = belief.argmax(1)
    # a word that names an address's owner has told its neighbours and twins; it is no personal datum of any kind itself
    label = [int(y) if x < 0 and c < WORDLIKE and p >= SURE else 0 for x, c, y, p in zip(g.given, g.classes, best, belief.max(1), strict=True)]
    linked = {a for a, _ in g.chain}
    out, i, n = list(base), 0, len(g.spots)
    while i < n:
        j = i
        if label[i]:
            while j in linked and label[j + 1] == label[i]:
                j += 1
            out.append((g.spots[i][0], g.spots[j][1], KINDS[label[i] - 1]))
        i = j + 1
    return base, sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def find_spans(df: DataFrame, crf: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, counts of the base kinds, digest of the base spans, all spans, and how many of them the field added."""
    names = [id_column, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for text in part.column(1).to_pylist():
                    base, every = all_spans(text, crf)
                    n = Counter(kind for _, _, kind in base)
                    rows.append((*(n[x] for x in KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(every) - len(base)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:6]), pa.array(columns[6], pa.int64())], names)

    out = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), *(T.StructField(x, T.LongType()) for x in names[1:5]), *(T.StructField(x, T.StringType()) for x in names[5:7]), T.StructField("n_added", T.LongType())])
    return texts(df, id_column, text_column).mapInArrow(run, out)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, as its (first) kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, crf: Field) -> DataFrame:
    """All rows and columns, with the spans in ``text`` replaced and ``n_chars``, if there, counted anew."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names.index("text")):
                out = [None if t is None else redacted(t, all_spans(t, crf)[1]) for t in part.column(names.index("text")).to_pylist()]
                columns = dict(zip(names, part.columns, strict=True))
                columns["text"] = pa.array(out, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return df.mapInArrow(run, df.schema)
