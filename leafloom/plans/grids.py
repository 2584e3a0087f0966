"""Queries of grids that are merged, framed, cut and drafted, with SQL that states what becomes of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.operators import grids
from leafloom.plans import tables
from leafloom.plans.registry import Registry, dealt, spread, table, values

R = Registry()


def _drawn(rows: int, cols: int, off: list[str]) -> list:
    """A grid all of whose borders are drawn but ``off``: ``v r k`` (before column k in row r), ``h k c``."""
    gone = {tuple([x[0], *map(int, x[1:].split())]) for x in off}
    return [[{"left": ("v", r, c) not in gone, "right": ("v", r, c + 1) not in gone, "top": ("h", r, c) not in gone, "bottom": ("h", r + 1, c) not in gone} for c in range(cols)] for r in range(rows)]


def _shown(boxes: list) -> str:
    return ";".join(",".join(map(str, b)) for b in boxes)


_SINGLE = [(r, c, r + 1, c + 1) for r in range(3) for c in range(3)]
#: (borders, merged boxes, core)
_BORDERS = [
    (_drawn(3, 3, []), _SINGLE, []),
    (_drawn(3, 3, ["v 0 1"]), [(0, 0, 1, 2), *(b for b in _SINGLE if b[:2] not in ((0, 0), (0, 1)))], []),
    (_drawn(3, 3, ["v 0 1", "h 1 0"]), _SINGLE, []),
    (_drawn(3, 3, ["v 0 1", "h 1 0", "h 1 1", "v 1 1"]), [(0, 0, 2, 2), *(b for b in _SINGLE if b[:2] not in ((0, 0), (0, 1), (1, 0), (1, 1)))], []),
    (_drawn(3, 3, ["v 0 1", "h 1 0", "h 1 1"]), _SINGLE, []),
    (_drawn(3, 4, ["v 2 1", "v 2 2", "v 2 3", "h 1 0", "h 1 3", "h 2 0", "h 2 3"]), [(r, c, r + 1, c + 1) for r in range(3) for c in range(4)], [(0, 1, 2, 3)]),
]


def _borders(spark, sf):
    return dealt(spark, sf, [(b,) for b, _, _ in _BORDERS], "borders array<array<struct<left:boolean,right:boolean,top:boolean,bottom:boolean>>>")


def _said(boxes):
    return F.array_join(F.transform(boxes, lambda b: F.concat_ws(",", *(b[n].cast("string") for n in ("r0", "c0", "r1", "c1")))), ";")


@R.add(f"SELECT p_partkey AS doc, b.merged, b.core FROM part JOIN (VALUES {values([(i, _shown(m), _shown(c)) for i, (_, m, c) in enumerate(_BORDERS)])}) b(i, merged, core) ON p_partkey % {len(_BORDERS)} = b.i")
def merged_cells(spark, sf):
    """Cells without a border between them: two, a corner, a block, a block that a border crosses; and a frame's core."""
    return _borders(spark, sf).select("doc", _said(grids.merged_groups("borders")).alias("merged"), _said(grids.frame_core("borders")).alias("core"))


def _grid(xs: list, ys: list, drop: int | None = None, off: float = 0.0) -> list:
    rects = [(float(a), float(b), float(c), float(d)) for b, d in zip(ys, ys[1:], strict=False) for a, c in zip(xs, xs[1:], strict=False)]
    rects = [r for i, r in enumerate(rects) if i != drop]
    return [(rects[0][0] + off, *rects[0][1:]), *rects[1:]]


#: (rectangles, cells)
_TILES = [
    (_grid([0, 10, 30], [0, 5, 9]), [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)]),
    (_grid([0, 10, 30], [0, 5, 9], off=0.4), [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)]),
    (_grid([0, 10, 30], [0, 5, 9], drop=3), []),
    ([(0.0, 0.0, 30.0, 5.0), (0.0, 5.0, 10.0, 9.0), (10.0, 5.0, 30.0, 9.0)], [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]),
    ([(0.0, 0.0, 30.0, 5.0), (10.0, 0.0, 30.0, 5.0)], []),
]


@R.add(f"SELECT p_partkey AS doc, t.cells FROM part JOIN (VALUES {values([(i, _shown(c)) for i, (_, c) in enumerate(_TILES)])}) t(i, cells) ON p_partkey % {len(_TILES)} = t.i")
def grid_tilings(spark, sf):
    """Rectangles that tile, with edges a little off, with a hole, with a merged cell, and that overlap."""
    d = dealt(spark, sf, [(r,) for r, _ in _TILES], "rects array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return d.select("doc", F.array_join(F.transform(grids.grid_shape("rects"), lambda c: F.concat_ws(",", *(c[n].cast("string") for n in ("row", "col", "rows", "cols")))), ";").alias("cells"))


_RING = [(0.0, 0.0, 90.0, 10.0), (0.0, 10.0, 10.0, 50.0), (80.0, 10.0, 90.0, 50.0), *((10.0 + 35 * c, 10.0 + 20 * r, 45.0 + 35 * c, 30.0 + 20 * r) for r in range(2) for c in range(2)), (0.0, 50.0, 90.0, 60.0)]


@R.add("""SELECT p_partkey AS doc, CASE WHEN p_size % 3 = 0 THEN 4 ELSE 8 END::BIGINT AS core, CASE WHEN p_size % 2 = 0 THEN 9 ELSE 8 END::BIGINT AS split FROM part""")
def cut_and_split(spark, sf):
    """A frame around four cells, its margins blank at every third size; a rule through one cell, with words on both sides of it at every second."""
    P, S = F.col("p_partkey"), F.col("p_size")
    rect = lambda r: F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    rects, core = F.array(*map(rect, _RING)), F.array(rect((10.0, 10.0, 80.0, 50.0)))
    inner = F.array(point(20.0, 20.0), point(60.0, 20.0))
    words = F.when(S % 3 == 0, inner).otherwise(F.concat(inner, F.array(point(5.0, 30.0))))
    both = F.when(S % 2 == 0, F.concat(inner, F.array(point(40.0, 20.0)))).otherwise(inner)
    rule = F.array(F.struct(F.lit("v").alias("axis"), F.lit(30.0).alias("at"), F.lit(10.0).alias("start"), F.lit(30.0).alias("end")))
    return spread(table(spark, sf, "part")).select(P.alias("doc"), F.size(grids.in_core(rects, core, words)).cast("long").alias("core"), F.size(grids.split_at_rules(rects, rule, both)).cast("long").alias("split"))


@R.add("""SELECT p_partkey AS doc, g.grid::BIGINT AS grid, CASE WHEN g.grid = 0 THEN 'covered' WHEN g.grid = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'split table' ELSE 'table' END WHEN g.grid = 2 THEN 'no tiling' ELSE 'too small' END AS what FROM part, (VALUES (0), (1), (2), (3)) g(grid)""")
def lattice_order(spark, sf):
    """A panel around a table, the table, cells with a hole, and a single row."""
    P, S = F.col("p_partkey"), F.col("p_size")
    rect = lambda r: F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    held = F.array(*(F.array(*map(rect, g)) for g in (_grid([0, 100, 200], [0, 50, 100]), _grid([10, 50, 90], [10, 20, 30]), _grid([300, 310, 320], [0, 5, 9], drop=3), _grid([400, 410, 420], [0, 5]))))
    points = F.array(point(20.0, 15.0), point(60.0, 15.0), point(30.0, 25.0), point(44.0, 25.0), point(405.0, 2.0))
    rule = F.array(F.struct(F.lit("v").alias("axis"), F.lit(40.0).alias("at"), F.when(S % 2 == 0, 10.0).otherwise(26.0).alias("start"), F.lit(30.0).alias("end")), F.struct(F.lit("h").alias("axis"), F.lit(20.0).alias("at"), F.lit(10.0).alias("start"), F.lit(90.0).alias("end")))
    got = spread(table(spark, sf, "part")).select(P.alias("doc"), F.explode(grids.lattice_tables(held, points, rule)).alias("g"))
    return got.select("doc", "g.grid", "g.what")


@R.add("""SELECT p_partkey AS doc, CASE WHEN p_size % 3 = 0 THEN 60.0 ELSE 35.0 END::DOUBLE AS "at", CASE WHEN p_size % 3 = 0 THEN '0-0:3' ELSE '0-0:2;1-1:1' END AS cells FROM part""")
def boundary_votes(spark, sf):
    """Three rows of words across a corridor from 20 to 100: two leave 30 to 40 blank; at every third size all leave 50 to 70."""
    P, S = F.col("p_partkey"), F.col("p_size")
    word = lambda a, b: F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"))
    rows = lambda *r: F.array(*(F.array(*(word(*w) for w in ws)) for ws in r))
    wide = rows([(20, 50), (70, 100)], [(20, 44), (45, 50), (70, 100)], [(20, 50), (70, 80), (81, 100)])
    narrow = rows([(20, 30), (40, 100)], [(20, 30), (40, 100)], [(20, 60), (61, 100)])
    at = grids.boundary_vote(F.lit(20.0), F.lit(100.0), F.when(S % 3 == 0, wide).otherwise(narrow), F.lit(10.0))
    piece = F.array(F.array(word(20, 24), word(25, 30), F.when(S % 3 == 0, word(31, 49)).otherwise(word(40, 90))))
    cells = grids.banded_cells(piece, F.array("at"), F.lit(10.0))
    d = spread(table(spark, sf, "part")).select(P.alias("doc"), S.alias("p_size"), at.alias("at"))
    return d.select("doc", "at", F.array_join(F.transform(cells, lambda c: F.concat(c["first"].cast("string"), F.lit("-"), c["last"].cast("string"), F.lit(":"), c["n"].cast("string"))), ";").alias("cells"))


@R.add("""SELECT p_partkey AS doc, p_size % 4 = 0 AS axis FROM part""")
def chart_axes(spark, sf):
    """Four numbers in a line below ticks; unevenly spaced at some sizes, in no progression at others, without ticks at others."""
    P, S = F.col("p_partkey"), F.col("p_size")
    kind = S % 4
    labels, rules = [], []
    for i in range(4):
        x = F.lit(50.0 * i) + F.when((kind == 1) & F.lit(i == 2), 9.0).otherwise(0.0)
        labels.append(F.struct((x - 5).alias("x0"), F.lit(100.0).alias("y0"), (x + 5).alias("x1"), F.lit(108.0).alias("y1"), F.lit(8.0).alias("size"), (F.lit(10.0 * i) + F.when((kind == 2) & F.lit(i == 3), 5.0).otherwise(0.0)).alias("number")))
        rules.append(F.struct(F.lit("v").alias("axis"), x.alias("at"), F.when(kind == 3, 40.0).otherwise(90.0).alias("start"), F.when(kind == 3, 50.0).otherwise(96.0).alias("end")))
    title = F.struct(F.lit(200.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(240.0).alias("x1"), F.lit(28.0).alias("y1"), F.lit(8.0).alias("size"), F.lit(None).cast("double").alias("number"))
    return spread(table(spark, sf, "part")).select(P.alias("doc"), grids.has_axis(F.array(*labels, title), F.array(*rules)).alias("axis"))


@R.add("""SELECT p_partkey AS doc, c.r::BIGINT AS "row", c.c::BIGINT AS col, c.h::BIGINT AS "rows", c.w::BIGINT AS cols, c.t || p_partkey AS text FROM part, (VALUES (0, 0, 0, 1, 2, 'a'), (0, 1, 0, 1, 1, 'b'), (0, 1, 1, 1, 1, 'c'), (1, 0, 0, 1, 1, 'a'), (1, 1, 0, 1, 1, 'b'), (1, 1, 1, 1, 1, 'c')) c(v, r, c, h, w, t) WHERE p_size % 2 = v""")
def boxes_to_cells(spark, sf):
    """A merged head over two cells; and a head whose box covers the cell below it, which ends it."""
    P, S = F.col("p_partkey"), F.col("p_size")
    box = lambda a, b, c, d: F.struct(*(F.lit(float(v)).alias(n) for v, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)))
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    low = F.array(box(0, 10, 20, 20), box(20, 10, 40, 20))
    plain, over = F.array(F.array(box(0, 0, 40.4, 10), none), low), F.array(F.array(box(0, 0, 20, 20), none), low)
    texts = F.array(F.array(F.concat(F.lit("a"), P.cast("string")), F.lit(None).cast("string")), F.array(F.concat(F.lit("b"), P.cast("string")), F.concat(F.lit("c"), P.cast("string"))))
    d = spread(table(spark, sf, "part")).select(P.alias("doc"), F.explode(grids.box_cells(F.when(S % 2 == 0, plain).otherwise(over), texts)).alias("c"))
    return d.select("doc", "c.*")


@R.add(f"""{tables.ONCE}, n AS (SELECT *, lead(text) OVER (PARTITION BY tbl, col ORDER BY "row") AS below FROM cells)
    SELECT tbl, "row", col, CASE WHEN "row" = 0 AND col = 0 AND tbl % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS "rows", 1::BIGINT AS cols, CASE WHEN "row" = 0 AND col = 0 AND tbl % 2 = 0 THEN text || ' ' || below ELSE text END AS text FROM n WHERE NOT (tbl % 2 = 0 AND "row" = 1 AND col = 0)""")
def drafted_tables(spark, sf):
    """The sales tables drafted from their grids and words; in every second one the first two labels are one cell."""
    w = tables.words(spark, sf)
    size = tables.cells(spark, sf).groupBy("tbl").agg((F.max("row") + 1).alias("rows"))
    merges = F.when(F.col("tbl") % 2 == 0, F.array(F.struct(*(F.lit(v).cast("long").alias(n) for v, n in ((0, "row"), (0, "col"), (2, "rows"), (1, "cols")))))).otherwise(F.array().cast("array<struct<row:bigint,col:bigint,rows:bigint,cols:bigint>>"))
    g = size.select("tbl", F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows")), lambda i: 89.0 + 12 * i).alias("row_edges"), F.array(*(F.lit(70.0 + 110 * i) for i in range(5))).alias("col_edges"), merges.alias("merges"))
    return grids.drafted(g, w.select("tbl", F.lit(0).alias("block"), F.col("row").alias("line"), F.col("col").alias("nth"), "text", "x0", "y0", "x1", "y1"))


@R.add("""SELECT p_partkey AS tbl, CASE WHEN p_size % 2 = 0 THEN 'no values, and the first row isn''t bold' ELSE 'the first rows hold values' END AS why FROM part WHERE p_size % 3 = 0""")
def headerless_tables(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    return grids.missing_headers(table(spark, sf, "part").select(F.lit(0).alias("doc_id"), P.alias("tbl"), (S % 3).alias("header_rows"), (S % 2 == 0).alias("text_only"))).drop("doc_id")


@R.add("""SELECT p_partkey AS id, b.n::BIGINT AS n, CASE WHEN r = 0 AND w THEN NULL WHEN r = 180 THEN CASE n WHEN 0 THEN 602 - x WHEN 1 THEN 50 WHEN 2 THEN 612 - x ELSE 60 END
    WHEN r = 90 AND w THEN CASE n WHEN 0 THEN 732 WHEN 1 THEN 602 - x WHEN 2 THEN 742 ELSE 612 - x END WHEN r = 270 AND w THEN CASE n WHEN 0 THEN 50 WHEN 1 THEN x WHEN 2 THEN 60 ELSE x + 10 END
    ELSE CASE n WHEN 0 THEN x WHEN 1 THEN 732 WHEN 2 THEN x + 10 ELSE 742 END END::DOUBLE AS at
    FROM (SELECT p_partkey, p_size % 4 * 90 AS r, p_partkey % 2 = 1 AS w, (p_partkey % 500)::DOUBLE AS x FROM part), range(4) b(n)""")
def placed_grids(spark, sf):
    """A lattice reader's boxes on pages of all four turns, in its own frame and in one that lies across: left, top, right and bottom; nulls where a box can't be placed."""
    P, S = F.col("p_partkey"), F.col("p_size")
    r, swapped, x = (S % 4 * 90).cast("int"), P % 2 == 1, (P % 500).cast("double")
    box = grids.placed_box(r, swapped, (x, F.lit(50.0), x + 10, F.lit(60.0)), F.lit(612.0), F.lit(792.0), F.lit(792.0))
    return table(spark, sf, "part").select(P.alias("id"), F.posexplode(F.array(*box)).alias("n", "at")).select("id", F.col("n").cast("long").alias("n"), "at")


@R.add("""SELECT p_partkey AS doc_id, k::BIGINT AS id, (CASE WHEN p_size % 3 = 0 AND k >= 2 THEN 1 ELSE 0 END)::BIGINT + (CASE WHEN k = 3 THEN 1 ELSE 0 END)::BIGINT AS piece FROM part, range(4) r(k)""")
def walled_pieces(spark, sf):
    """Three words close by and one far off; at every third size a rule stands between the second and the third, at others it is too short."""
    P, S = F.col("p_partkey"), F.col("p_size")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    w = table(spark, sf, "part").select(P.alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line"), k.alias("id"))
    x = 10.0 + 24 * F.col("id") + F.when(F.col("id") == 3, 30.0).otherwise(0.0)
    words = w.select("*", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 20).alias("x1"), F.lit(10.0).alias("y1"), F.lit(10.0).alias("size"))
    walls = table(spark, sf, "part").select(P.alias("doc_id"), F.lit(1).alias("page"), F.lit(56.0).alias("at"), F.lit(0.0).alias("start"), F.when(S % 3 == 0, 10.0).otherwise(4.0).alias("end"))
    return grids.walled(words, walls).select("doc_id", "id", "piece")


def _roles(text: str) -> list:
    """Cells from rows of texts: ``*`` bold, ``^`` two rows high, ``$`` a value."""
    return [(r, c, 2 if "^" in t else 1, t != "", "$" in t, "*" in t) for r, row in enumerate(text.split("/")) for c, t in enumerate(row.split(","))]


#: (cells, rows, header rows, banners, whether there is no value)
_ROLES = [
    (_roles("a,b/c,$"), 2, 1, "", False),
    (_roles("title,/a,b/c,$"), 3, 2, "0", False),
    (_roles("a,b/part,/c,$"), 3, 1, "1", False),
    (_roles("$,b/c,$"), 2, 0, "", False),
    (_roles("*a,*b/c,d"), 2, 1, "", True),
    (_roles("a,b/c,d"), 2, 0, "", True),
    (_roles("a^,b/,c$/d,$"), 3, 2, "", False),
]


@R.add(f"SELECT p_partkey AS doc, r.header::BIGINT AS header, r.banners, r.text_only FROM part JOIN (VALUES {values([(i, *x[2:]) for i, x in enumerate(_ROLES)])}) r(i, header, banners, text_only) ON p_partkey % {len(_ROLES)} = r.i")
def table_roles(spark, sf):
    """Header rows, banners, bold first rows and header cells that reach down."""
    d = dealt(spark, sf, [x[:2] for x in _ROLES], "cells array<struct<row:int,col:int,rows:int,filled:boolean,valued:boolean,bold:boolean>>, n int")
    r = grids.table_roles("cells", "n")
    return d.select("doc", r.alias("r")).select("doc", "r.header", F.array_join("r.banners", ",").alias("banners"), "r.text_only")


@R.add("""SELECT p_partkey AS doc, p_size % 5 < 2 AS bars FROM part""")
def bar_charts(spark, sf):
    """Four bars upward and four to the left, each with its number; with a wrong number, with two numbers, and one over another."""
    P, S = F.col("p_partkey"), F.col("p_size")
    kind = S % 5
    fills, labels = [], []
    for i in range(4):
        long, x = 20.0 + 15 * i, 30.0 * i
        up = kind != 1
        pick = lambda a, b, up=up: F.when(up, F.lit(float(a))).otherwise(F.lit(float(b)))
        shift = F.when((kind == 4) & F.lit(i == 3), -25.0).otherwise(0.0)
        fills.append(F.struct((pick(x, 200 - long) + shift).alias("x0"), pick(100 - long, x).alias("y0"), (pick(x + 10, 200) + shift).alias("x1"), pick(100, x + 10).alias("y1")))
        value = F.when((kind == 2) & F.lit(i == 3), 1.0).otherwise(long * 10)
        labels.append(F.struct((pick(x + 2, 190 - long) + shift).alias("x0"), pick(90 - long, x + 2).alias("y0"), (pick(x + 8, 196 - long) + shift).alias("x1"), pick(98 - long, x + 8).alias("y1"), F.lit(8.0).alias("size"), value.alias("number")))
    extra = F.struct(F.lit(2.0).alias("x0"), F.lit(85.0).alias("y0"), F.lit(8.0).alias("x1"), F.lit(93.0).alias("y1"), F.lit(8.0).alias("size"), F.when(kind == 3, 7.0).alias("number"))
    return spread(table(spark, sf, "part")).select(P.alias("doc"), grids.has_bars(F.array(*fills), F.array(*labels, extra)).alias("bars"))
