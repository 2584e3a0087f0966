"""Ruled and unruled tables: rules to grids, words to cells, rows to roles, values to columns.

Joins of words with cells are equi-joins on the table and a band of the coordinate, with the exact test after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import tokens as tk

# Fixed values.
SNAP, MERGE_AT, MERGE_GAP, CROSS = 0.5, 0.25, 0.5, 1.0


def snapped(edges: Column, tolerance: float = SNAP) -> Column:
    """Sorted edges of which each is further than the tolerance from the last one kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(edges), start, lambda kept, e: F.when((F.size(kept) == 0) | (e - F.element_at(kept, -1) > tolerance), F.array_append(kept, e)).otherwise(kept))


def merge_rules(rules: DataFrame, at: float = MERGE_AT, gap: float = MERGE_GAP) -> DataFrame:
    """tbl, axis, at, start, end: collinear pieces (by distance from a group's first) joined over small gaps."""
    ats = rules.groupBy("tbl", "axis").agg(snapped(F.collect_set("at"), at).alias("firsts"))
    grouped = rules.join(ats, ["tbl", "axis"]).withColumn("at0", F.array_max(F.filter("firsts", lambda a: a <= F.col("at"))))
    w = Window.partitionBy("tbl", "axis", "at0").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = grouped.withColumn("new", F.when(reach.isNull() | (F.round(F.col("start") - reach, 2) > gap), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("new").over(w))
    return islands.groupBy("tbl", "axis", "at0", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("tbl", "axis", F.col("at0").alias("at"), "start", "end")


def lattice_cells(rules: DataFrame) -> DataFrame:
    """tbl, row, col, x0, y0, x1, y1: the elementary cells between merged rules of which all four sides are drawn."""
    v, h = rules.where("axis = 'v'"), rules.where("axis = 'h'")
    xs = v.groupBy("tbl").agg(snapped(F.collect_set("at")).alias("xs"))
    ys = h.groupBy("tbl").agg(snapped(F.collect_set("at")).alias("ys"))
    grid = xs.join(ys, "tbl").where((F.size("xs") > 1) & (F.size("ys") > 1))
    cells = grid.select("tbl", "xs", "ys", F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("row")).select("tbl", "xs", "ys", "row", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)).alias("col"))
    at = lambda c, i: F.get(F.col(c), i)
    cells = cells.select("tbl", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), at("xs", F.col("col")).alias("x0"), at("ys", F.col("row")).alias("y0"), at("xs", F.col("col") + 1).alias("x1"), at("ys", F.col("row") + 1).alias("y1"))
    lines = rules.groupBy("tbl").agg(F.collect_list(F.struct("axis", "at", "start", "end")).alias("lines"))

    def drawn(axis: str, where: str, a: str, b: str) -> Column:
        return F.exists("lines", lambda r: (r.axis == axis) & (F.abs(r["at"] - F.col(where)) <= SNAP) & (r.start <= F.col(a) + SNAP) & (r.end >= F.col(b) - SNAP))

    closed = drawn("h", "y0", "x0", "x1") & drawn("h", "y1", "x0", "x1") & drawn("v", "x0", "y0", "y1") & drawn("v", "x1", "y0", "y1")
    return cells.join(lines, "tbl").where(closed).drop("lines")


def words_in_cells(words: DataFrame, cells: DataFrame, band: float = 24.0) -> DataFrame:
    """words with row and col of the cell that holds the centre (half-open); unplaced words are left out.

    A cell is dealt to each band of y that it meets, a word to the band of its centre: an equi-join.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w = words.select("tbl", F.col("text"), "x0", "x1", x.alias("cx"), y.alias("cy"), F.floor(y / band).alias("band"))
    c = cells.select("tbl", "row", "col", F.col("x0").alias("a0"), F.col("y0").alias("b0"), F.col("x1").alias("a1"), F.col("y1").alias("b1"), F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))).alias("band"))
    return w.join(c, ["tbl", "band"]).where("a0 <= cx and cx < a1 and b0 <= cy and cy < b1").select("tbl", "row", "col", "text", "x0", "x1", F.col("a0").alias("cell_x0"), F.col("a1").alias("cell_x1"), "cx", "cy")


def crossing(placed: DataFrame) -> DataFrame:
    """Words that overhang their cell by more than a point."""
    return placed.where((F.col("x0") < F.col("cell_x0") - CROSS) | (F.col("x1") > F.col("cell_x1") + CROSS))


def header_rows(cells: DataFrame) -> DataFrame:
    """tbl, header_rows: the leading rows without a value."""
    rows = cells.groupBy("tbl", "row").agg(F.bool_or(tk.is_strong_value(F.col("text")) | (tk.is_value(F.col("text")) & F.col("text").rlike(r"[0-9]"))).alias("valued"))
    first = rows.where("valued").groupBy("tbl").agg(F.min("row").alias("first"))
    n = rows.groupBy("tbl").agg(F.count("*").alias("n"))
    return n.join(first, "tbl", "left").select("tbl", F.coalesce("first", "n").alias("header_rows"))


def value_columns(words: DataFrame) -> DataFrame:
    """tbl, column, x0, x1: spans of the pieces of value rows, merged where they touch. words: tbl, row, x0, x1, text."""
    valued = words.groupBy("tbl", "row").agg((F.count("*") >= 2).alias("two"), F.bool_or(tk.is_strong_value(F.col("text"))).alias("strong")).where("two and strong").select("tbl", "row")
    pieces = words.join(valued, ["tbl", "row"], "left_semi").select("tbl", "x0", "x1").distinct()
    w = Window.partitionBy("tbl").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("column", F.sum(F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)).over(w) - 1)
    return islands.groupBy("tbl", F.col("column").cast("long").alias("column")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def row_edges(words: DataFrame) -> DataFrame:
    """tbl, row, y0, y1: contiguous bands, each border midway between neighbouring rows' extents."""
    rows = words.groupBy("tbl", "row").agg(F.min("y0").alias("low"), F.max("y1").alias("high"))
    w = Window.partitionBy("tbl").orderBy("row")
    y0 = F.coalesce((F.lag("high").over(w) + F.col("low")) / 2, F.col("low"))
    y1 = F.coalesce((F.col("high") + F.lead("low").over(w)) / 2, F.col("high"))
    return rows.select("tbl", "row", y0.alias("y0"), y1.alias("y1"))


def corridor_cells(words: DataFrame) -> DataFrame:
    """tbl, row, col, text, from the boxes of words alone: rows by their height on the page, columns by the spans of value rows.

    words: tbl, x0, y0, x1, y1, text.
    """
    # all steps are by table, so that words move once; a line is the words of one top and bottom, and counts with its first
    words = words.select("tbl", "x0", "y0", "x1", "y1", "text").repartition("tbl")
    w = Window.partitionBy("tbl").orderBy("y0", "y1")
    before, reach = F.lag(F.struct("y0", "y1")).over(w), F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = before.isNull() | ((before != F.struct("y0", "y1")) & (F.col("y0") >= reach))
    placed = words.withColumn("begins", begins.cast("int")).withColumn("row", (F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).select("tbl", "row", "x0", "x1", "text")
    columns = value_columns(placed).groupBy("tbl").agg(F.collect_list(F.struct("column", "x0", "x1")).alias("columns"))
    # a piece belongs to the column that it overlaps most
    over = lambda c: F.least("x1", c.x1) - F.greatest("x0", c.x0)
    best = F.array_max(F.transform("columns", lambda c: F.struct(over(c).alias("over"), (-c.column).alias("before"))))
    home = placed.distinct().join(columns, "tbl").withColumn("col", -best.before)
    return home.select("tbl", "row", "col", "text")


def table_text(cells: DataFrame) -> DataFrame:
    """tbl, text: cells joined by a blank, rows by a line end."""
    rows = cells.groupBy("tbl", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c.text), " ").alias("line"))
    return rows.groupBy("tbl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r.line), "\n").alias("text"))


def ruled_pages(rules: DataFrame) -> DataFrame:
    """Pages with two rules each way."""
    return rules.groupBy("tbl").agg(F.count_if(F.col("axis") == "h").alias("h"), F.count_if(F.col("axis") == "v").alias("v")).where("h >= 2 and v >= 2")


def running_text_columns(cells: DataFrame, words: int = 3) -> DataFrame:
    """tbl, layout: whether every column holds running text only, so that the rules frame prose and no table."""
    columns = cells.groupBy("tbl", "col").agg(F.bool_and((F.size(F.split("text", " ")) >= words) & ~tk.is_value(F.col("text"))).alias("prose"))
    return columns.groupBy("tbl").agg(F.bool_and("prose").alias("layout"))


def uncovered(cells: DataFrame) -> DataFrame:
    """tbl, row, col of the positions of a grid that no cell covers. cells: tbl, row, col, row_span, col_span."""
    from leafloom.operators.export import dense_rows

    size = cells.groupBy("tbl").agg(F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("col") + F.col("col_span")).alias("cols"))
    every = size.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))).select("tbl", "row", "col")
    return every.join(dense_rows(cells.withColumn("text", F.lit(""))), ["tbl", "row", "col"], "left_anti")


def bars(fills: DataFrame) -> DataFrame:
    """page, scale: pages whose bars stand on one baseline, are of one thickness, and have lengths in one proportion to their numbers.

    fills: page, x0, y0, x1, y1, value.
    """
    b = fills.where("value > 0").groupBy("page").agg(
        F.count("*").alias("n"), (F.max("y1") - F.min("y1")).alias("off"), (F.max(F.col("x1") - F.col("x0")) - F.min(F.col("x1") - F.col("x0"))).alias("uneven"), F.max_by(F.col("y1") - F.col("y0"), F.struct("value", "x0")).alias("length"), F.max("value").alias("value"),
        F.collect_list(F.struct((F.col("y1") - F.col("y0")).alias("length"), "value")).alias("all"),
    )
    scale = F.col("length") / F.col("value")
    fits = F.forall("all", lambda x: F.abs(x.length - x.value * scale) <= F.greatest(F.lit(1.0), 0.03 * x.length))
    return b.where((F.col("n") >= 3) & (F.col("off") <= 0.5) & (F.col("uneven") <= 0.5) & fits).select("page", F.round(scale, 6).alias("scale"))
