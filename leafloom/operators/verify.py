"""A document against a second reading of its pages: who owns each drawn character, and what is lost, doubled or invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Fixed values of the second reading's rules.
INK_SLANT, INK_SHORT, INK_THIN, INK_AT, INK_GAP = 1.0, 3.0, 3.0, 0.5, 1.0
SIZE_OFF, LINE_OVERLAP = 0.5, 0.5


def ink_rules(paths: DataFrame) -> DataFrame:
    """tbl, axis, at, start, end: the rules that paths draw, by the second reading's own tolerances, merged. paths as for the reader's."""
    from leafloom.operators import reader, tables

    found = reader.extract_rules(paths, INK_SLANT, INK_SHORT, INK_THIN).select(F.col("doc_id").alias("tbl"), "axis", "at", "start", "end")
    return tables.merge_rules(found, INK_AT, INK_GAP)


def owners(ink: DataFrame, words: DataFrame, band: float = 20.0, wide: float = 80.0) -> DataFrame:
    """doc_id, ink, n, word: how many words' boxes hold a character's centre, and the word if it is one.

    ink: doc_id, page, ink, cx, cy, c; words: doc_id, page, id, x0, y0, x1, y1. Dealt by page and squares of ``wide`` by ``band``.
    """
    squares = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    box = F.struct("id", "x0", "y0", "x1", "y1").alias("box")
    w = words.select("doc_id", "page", box, squares("y0", "y1", band).alias("band"), "x0", "x1").select("doc_id", "page", "box", "band", squares("x0", "x1", wide).alias("side"))
    # a square's words are one array, so that the ink, which is most, moves once and is not grouped
    near = w.groupBy("doc_id", "page", "band", "side").agg(F.collect_list("box").alias("near"))
    held = lambda b: (b.x0 <= F.col("cx")) & (F.col("cx") < b.x1) & (b.y0 <= F.col("cy")) & (F.col("cy") < b.y1)
    placed = ink.select("doc_id", "page", "ink", "cx", "cy", F.floor(F.col("cy") / band).alias("band"), F.floor(F.col("cx") / wide).alias("side")).join(near, ["doc_id", "page", "band", "side"], "left")
    n = F.coalesce(F.array_size("homes"), F.lit(0)).cast("long")
    return placed.withColumn("homes", F.filter("near", held)).select("doc_id", "ink", n.alias("n"), F.when(F.array_size("homes") == 1, F.get("homes", 0)["id"]).alias("word"))


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left that right does not answer, each as often as it is short: counts compared, no row numbers needed."""
    a = left.groupBy(*keys).agg(F.count("*").alias("a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("b"))
    short = F.col("a") - F.coalesce("b", F.lit(0))
    return a.join(b, keys, "left").where(short > 0).select(*keys, short.alias("short"))


def lost_runs(lost: DataFrame) -> DataFrame:
    """doc_id, page, first, text: runs of neighbouring lost characters. lost: doc_id, page, ink, c."""
    w = Window.partitionBy("doc_id", "page").orderBy("ink")
    g = lost.withColumn("g", F.col("ink") - F.row_number().over(w))
    return g.groupBy("doc_id", "page", "g").agg(F.min("ink").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ink", "c"))), lambda x: x.c), "").alias("text")).drop("g")


def defect_counts(defects: DataFrame) -> DataFrame:
    return defects.groupBy("code").agg(F.count("*").alias("defects"), F.countDistinct("doc_id").alias("documents"))


def cuts(cells: DataFrame, rules: DataFrame, points: DataFrame, edge: float = 2.0, margin: float = 1.0, step: float = 100.0) -> DataFrame:
    """tbl, row, col, axis: cells that a rule cuts, from edge to edge and inside by a margin, with points on either side.

    cells: tbl, row, col, x0, y0, x1, y1; rules: tbl, axis, at, start, end; points: tbl, row, col, cx, cy. Rules meet the cells
    whose extent across them reaches the rule's step of ``step`` points.
    """
    c = F.col
    both = F.explode(F.array(*(F.struct(F.lit(axis).alias("axis"), *(c(v).alias(n) for v, n in zip(names, ("low", "high", "first", "last"), strict=True))) for axis, names in (("v", ("x0", "x1", "y0", "y1")), ("h", ("y0", "y1", "x0", "x1"))))))
    sides = cells.select("tbl", "row", "col", both.alias("s")).select("tbl", "row", "col", "s.*")
    sides = sides.withColumn("step", F.explode(F.sequence(F.floor(c("low") / step), F.floor(c("high") / step))))
    drawn = rules.select("tbl", "axis", c("at").alias("rule_at"), "start", "end", F.floor(c("at") / step).alias("step"))
    hit = sides.join(drawn, ["tbl", "axis", "step"]).where((c("rule_at") > c("low") + margin) & (c("rule_at") < c("high") - margin) & (c("start") <= c("first") + edge) & (c("end") >= c("last") - edge)).select("tbl", "row", "col", "axis", "rule_at")
    across = F.when(c("axis") == "v", c("cx")).otherwise(c("cy"))
    split = hit.join(points.select("tbl", "row", "col", "cx", "cy"), ["tbl", "row", "col"]).groupBy("tbl", "row", "col", "axis", "rule_at")
    return split.agg(F.count_if(across < c("rule_at")).alias("l"), F.count_if(across > c("rule_at")).alias("r")).where("l > 0 and r > 0").select("tbl", "row", "col", "axis").distinct()


def placed(ink: DataFrame, cells: DataFrame, band: float = 24.0) -> DataFrame:
    """ink with n (the cells that hold its centre), row, col (of the one), inside (the extent of cells not carried). ink: tbl, ink, c, cx, cy and more; cells: tbl, row, col, x0, y0, x1, y1, carried."""
    bands = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / band), F.floor(F.col(b) / band))).alias("_band")
    extent = cells.where("not carried").groupBy("tbl").agg(F.min("x0").alias("_ex0"), F.min("y0").alias("_ey0"), F.max("x1").alias("_ex1"), F.max("y1").alias("_ey1"))
    # a band's cells are one array beside the table's extent, so that the ink, which is most, moves once
    near = cells.select("tbl", F.struct("row", "col", "x0", "y0", "x1", "y1").alias("cell"), bands("y0", "y1")).groupBy("tbl", "_band").agg(F.collect_list("cell").alias("_near"))
    each = near.join(extent.select("*", bands("_ey0", "_ey1")), ["tbl", "_band"], "full")
    held = lambda a, b, x: (a <= F.col(x)) & (F.col(x) < b)
    homes = F.filter("_near", lambda c: held(c.x0, c.x1, "cx") & held(c.y0, c.y1, "cy"))
    out = ink.withColumn("_band", F.floor(F.col("cy") / band)).join(each, ["tbl", "_band"], "left").withColumn("_homes", homes)
    n = F.coalesce(F.array_size("_homes"), F.lit(0)).cast("long")
    one = lambda c: F.when(F.array_size("_homes") == 1, F.get("_homes", 0)[c])
    inside = held(F.col("_ex0"), F.col("_ex1"), "cx") & held(F.col("_ey0"), F.col("_ey1"), "cy")
    return out.select(*ink.columns, n.alias("n"), one("row").alias("row"), one("col").alias("col"), F.coalesce(inside, F.lit(False)).alias("inside"))


def spread(found: DataFrame) -> DataFrame:
    """tbl, code, text: of each table the characters within its extent that no cell holds (orphan), and those that two hold (double). found: placed ink."""
    code = F.when((F.col("n") == 0) & F.col("inside"), "orphan").when(F.col("n") > 1, "double")
    return found.withColumn("code", code).where("code is not null").groupBy("tbl", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ink", "c"))), lambda x: x.c), "").alias("text"))


def slanted(ink: DataFrame) -> DataFrame:
    """word, slanted: whether a word's first and last characters stand at 15 to 75 degrees. ink: word, ink, cx, cy."""
    ends = ink.groupBy("word").agg(F.count("*").alias("n"), F.min_by(F.struct("cx", "cy"), "ink").alias("a"), F.max_by(F.struct("cx", "cy"), "ink").alias("b"))
    turn = F.degrees(F.atan2(F.abs(F.col("b.cy") - F.col("a.cy")), F.abs(F.col("b.cx") - F.col("a.cx"))))
    return ends.select("word", ((F.col("n") >= 2) & (turn > 15) & (turn < 75)).alias("slanted"))


def text_problems(found: DataFrame, words: DataFrame) -> DataFrame:
    """tbl, row, col, problem, text: words of which no more than half the ink is in their cell (misplaced), and ink of other blocks in a cell (foreign), but for slanted overlays.

    found: placed ink with word (its owner, or null); words: word, tbl, row, col (null for words of other blocks), text, horizontal.
    """
    own = words.select("word", F.col("tbl").alias("own_tbl"), F.col("row").alias("own_row"), F.col("col").alias("own_col"), F.col("text").alias("said"), "horizontal")
    drawn = found.where("word is not null").join(own, "word")
    mine = drawn.where("own_tbl = tbl and own_row is not null").groupBy("tbl", "own_row", "own_col", "word", "said").agg(F.count("*").alias("all"), F.count_if((F.col("row") == F.col("own_row")) & (F.col("col") == F.col("own_col"))).alias("in"))
    misplaced = mine.where(2 * F.col("in") <= F.col("all")).select("tbl", F.col("own_row").alias("row"), F.col("own_col").alias("col"), F.lit("misplaced").alias("problem"), F.col("said").alias("text"))
    other = drawn.where("(own_tbl is null or own_tbl <> tbl) and row is not null").join(slanted(found.where("word is not null")), "word", "left").where(~(~F.col("horizontal") & F.coalesce("slanted", F.lit(False))))
    foreign = other.groupBy("tbl", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ink", "c"))), lambda x: x.c), "").alias("text")).select("tbl", "row", "col", F.lit("foreign").alias("problem"), "text")
    return misplaced.union(foreign)


def crossings(ink: DataFrame, rules: DataFrame, breaks: DataFrame) -> DataFrame:
    """word, beyond, problem: of each word that overflows its cell how many characters are beyond, and whether it runs across a drawn rule as two texts: broken there, or with digits on both sides.

    ink: tbl, word, ink, c, cx, cy, home (whether in the word's cell); rules: tbl, axis, at, start, end; breaks: tbl, ink (places that are no ink).
    """
    w = ink.groupBy("tbl", "word").agg(F.min("ink").alias("first"), F.max("ink").alias("last"), F.count_if(~F.col("home")).alias("beyond"), F.count_if("home").alias("within"), *(f(F.when(F.col("home"), F.col(v))).alias(f"{n}{v}") for v in ("cx", "cy") for n, f in (("low_", F.min), ("high_", F.max))), F.bool_or(F.col("home") & F.col("c").rlike(r"\p{Nd}")).alias("digit")).where("beyond > 0")
    out = ink.where("not home").select("tbl", "word", "ink", "c", "cx", "cy").join(w.select("tbl", "word", "within", "low_cx", "high_cx", "low_cy", "high_cy"), ["tbl", "word"]).join(rules, "tbl")
    c = F.col
    v = c("axis") == "v"
    along, across = F.when(v, c("cy")).otherwise(c("cx")), F.when(v, c("cx")).otherwise(c("cy"))
    low, high = F.when(v, c("low_cx")).otherwise(c("low_cy")), F.when(v, c("high_cx")).otherwise(c("high_cy"))
    parted = (c("start") <= along) & (along <= c("end")) & ((c("within") == 0) | ((high < c("at")) & (c("at") < across)) | ((across < c("at")) & (c("at") < low)))
    crossed = out.where(parted).groupBy("tbl", "word").agg(F.bool_or(c("c").rlike(r"\p{Nd}")).alias("digits_beyond"))
    broken = w.join(breaks.select("tbl", c("ink").alias("gap")), "tbl").where("gap > first and gap < last").select("tbl", "word").distinct().withColumn("broken", F.lit(True))
    both = w.join(crossed, ["tbl", "word"], "left").join(broken, ["tbl", "word"], "left")
    problem = c("digits_beyond").isNotNull() & (F.coalesce("broken", F.lit(False)) | (c("digit") & c("digits_beyond")))
    return both.select("tbl", "word", "beyond", F.coalesce(problem, F.lit(False)).alias("problem"))


def sequences(ink: DataFrame) -> DataFrame:
    """tbl, row, col, text: what a cell's ink reads, lines by the overlap with the last line, each from left to right. ink: tbl, row, col, ink, c, x0, y0, y1."""
    spot = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "ink", "x0", "y0", "y1", "c")
    kind = "struct<done:string,line:array<struct<x0:double,ink:bigint,c:string>>,top:double,bottom:double>"
    start = F.struct(F.lit("").alias("done"), F.array().cast("array<struct<x0:double,ink:bigint,c:string>>").alias("line"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom")).cast(kind)
    said = lambda line: F.array_join(F.transform(F.array_sort(line), lambda x: x.c), "")

    def step(s, x):
        one = F.struct(x.x0.alias("x0"), x.ink.alias("ink"), x.c.alias("c"))
        goes_on = (F.size(s.line) > 0) & (F.least(x.y1, s.bottom) - F.greatest(x.y0, s.top) > LINE_OVERLAP * F.least(x.y1 - x.y0, s.bottom - s.top))
        return F.when(goes_on, F.struct(s.done.alias("done"), F.array_append(s.line, one).alias("line"), F.least(s.top, x.y0).alias("top"), F.greatest(s.bottom, x.y1).alias("bottom")).cast(kind)).otherwise(F.struct(F.concat(s.done, said(s.line)).alias("done"), F.array(one).alias("line"), x.y0.alias("top"), x.y1.alias("bottom")).cast(kind))

    folded = F.aggregate(F.array_sort(F.collect_list(spot)), start, step, lambda s: F.concat(s.done, said(s.line)))
    return ink.groupBy("tbl", "row", "col").agg(folded.alias("text"))


def value_defects(ink: DataFrame) -> DataFrame:
    """doc_id, page, first, text, split: values (runs of ink with a digit, cut where a gap exceeds half the larger side) whose characters, all of them owned, are bound to several blocks or cells.

    ink: doc_id, page, ink, c, is_ink, x0, y0, x1, y1, block (or null), cell (or null): all characters in the page's order.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("ink")
    c, prev = F.col, lambda n: F.lag(n).over(w)
    dx, dy = F.greatest(F.lit(0.0), c("x0") - prev("x1"), prev("x0") - c("x1")), F.greatest(F.lit(0.0), c("y0") - prev("y1"), prev("y0") - c("y1"))
    size = F.greatest(prev("x1") - prev("x0"), prev("y1") - prev("y0"), c("x1") - c("x0"), c("y1") - c("y0"))
    starts = prev("ink").isNull() | ~prev("is_ink") | (F.hypot(dx, dy) > size / 2)
    tokens = ink.withColumn("starts", starts.cast("int")).withColumn("token", F.sum("starts").over(w)).where("is_ink").groupBy("doc_id", "page", "token")
    t = tokens.agg(F.min("ink").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ink", "c"))), lambda x: x.c), "").alias("text"), F.count_if(c("block").isNull()).alias("free"), F.countDistinct("block").alias("blocks"), F.countDistinct("cell").alias("cells"))
    split = F.when(c("blocks") > 1, "blocks").when(c("cells") > 1, "cells")
    return t.where(c("text").rlike(r"\p{Nd}") & (c("free") == 0)).select("doc_id", "page", "first", "text", split.alias("split")).where("split is not null")


def homes(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, word, block, row, col: where each word is bound; no cell but in tables. blocks: doc_id, block, kind, words; cells: doc_id, block, row, col, words."""
    plain = blocks.where("kind <> 'table'").select("doc_id", F.explode("words").alias("word"), "block", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("col"))
    return plain.union(cells.select("doc_id", F.explode("words").alias("word"), "block", "row", "col"))


def page_statuses(pages: DataFrame, drawn: DataFrame, unreadable: DataFrame) -> DataFrame:
    """doc_id, page, status, why: declared unreadable, unverified with its reason, or verified.

    pages: doc_id, page, width, height (the document's); drawn: doc_id, page, width, height, error (the second reading's); unreadable: doc_id, page (null: pages that the document lacks).
    """
    own = pages.select("doc_id", "page", F.col("width").alias("w"), F.col("height").alias("h"), F.lit(True).alias("own"))
    seen = drawn.select("doc_id", "page", "width", "height", "error", F.lit(True).alias("seen"))
    every = own.join(seen, ["doc_id", "page"], "full")
    told = unreadable.where("page is not null").select("doc_id", "page").distinct().withColumn("told", F.lit(True))
    rest = unreadable.where("page is null").select("doc_id").distinct().withColumn("rest", F.lit(True))
    d = every.join(told, ["doc_id", "page"], "left").join(rest, "doc_id", "left")
    off = (F.abs(F.col("w") - F.col("width")) > SIZE_OFF) | (F.abs(F.col("h") - F.col("height")) > SIZE_OFF)
    why = F.when(F.col("seen").isNull(), "not drawn").when(F.col("error").isNotNull(), "can't be loaded").when(off, "another size")
    declared = F.col("told").isNotNull() | (F.col("own").isNull() & F.col("rest").isNotNull())
    return d.select("doc_id", "page", F.when(declared, "declared").when(why.isNotNull(), "unverified").otherwise("verified").alias("status"), F.when(~declared, why).alias("why"))


# The codes in a report's order.
CODES = ["lost", "doubled", "invented", "decode", "value", "orphan", "double", "text", "vrule", "hrule", "unverified", "order"]


def report(statuses: DataFrame, *defects: DataFrame) -> DataFrame:
    """doc_id, nth, page, code, text, advisory: every defect of verified pages, and one of each unverified page, in order. Each of defects: doc_id, page, code, y0, x0, text."""
    from functools import reduce

    columns = ["doc_id", "page", "code", "y0", "x0", "text"]
    every = reduce(DataFrame.union, (d.select(*columns) for d in defects)).join(statuses.where("status = 'verified'").select("doc_id", "page"), ["doc_id", "page"], "left_semi").select(*columns)
    blind = statuses.where("status = 'unverified'").select("doc_id", "page", F.lit("unverified").alias("code"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x0"), F.lit("").alias("text"))
    place = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    advisory = F.col("code") == "order"
    order = Window.partitionBy("doc_id", advisory).orderBy("page", place, "y0", "x0", "text")
    return every.union(blind).select("doc_id", F.row_number().over(order).cast("long").alias("nth"), "page", "code", "text", advisory.alias("advisory"))


def same_source(documents: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, source: same, other or missing, whether a file is the one that the document was read from, by SHA-256. documents: doc_id, sha256; files: doc_id, content."""
    source = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("sha256"), "same").otherwise("other")
    return documents.join(files.select("doc_id", F.sha2("content", 256).alias("found")), "doc_id", "left").select("doc_id", source.alias("source"))


def char_kind(code: Column, generated: Column, hyphen: Column, map_error: Column) -> Column:
    """Precedence: generated, hyphen, unmapped, space, invisible, ink."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(generated, "generated")
        .when(hyphen | ((code == 2) & ~map_error), "hyphen")
        .when((map_error & ~code.isin(9, 10, 13, 32, 160)) | (code == 0) | code.between(128, 159), "unmapped")
        .when(char.rlike(r"(?U)^[\s\x1c-\x1f]\z"), "space")
        .when(char.rlike(r"^[\p{Cc}\p{Cf}\p{Co}\p{Cn}]\z"), "invisible")
        .otherwise("ink")
    )
