"""Queries of furniture's conditions over planted pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom.operators import furniture
from leafloom.plans.prose import FURNITURE
from leafloom.plans.registry import Registry, table

R = Registry()

#: Lines of a page by what the customer's key is: (line, which customers, text, top, x0, width, parts, whether the table holds it)
_LINES = [
    (0, "true", "'Acme ' || page || ' Report'", 40, "72 + CASE WHEN c % 4 = 1 THEN page * 10 ELSE 0 END", 80, 1, "c % 7 = 3"),
    (1, "true", "page::VARCHAR", 760, "300 + CASE WHEN c % 3 = 1 THEN page * 20 ELSE 0 END", 10, 1, "false"),
    (2, "c % 5 = 2", "'Acme ' || page || ' Report'", 55, "72", 80, 1, "false"),
    (3, "c % 5 >= 3", "'Left ' || page || ' right'", 20, "72", 300, 3, "false"),
    (4, "c % 5 = 4", "'One two ' || page", 30, "90", 300, 3, "false"),
    (5, "true", "'words of the body ' || page", 300, "72", 200, 1, "false"),
    (6, "c % 6 = 5", "'Foot ' || page", 740, "72", 40, 1, "false"),
]
_EVERY = " UNION ALL ".join(f"SELECT c AS doc_id, page, {k}::BIGINT AS line, {text} AS text, {top}::DOUBLE AS top, {top + 10}::DOUBLE AS bottom, ({x})::DOUBLE AS x0, ({x} + {wide})::DOUBLE AS x1, {parts}::BIGINT AS parts, {tabled} AS tabled FROM pg WHERE {who}" for k, who, text, top, x, wide, parts, tabled in _LINES)


def lines(spark, sf):
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pg = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), page.cast("long").alias("page"))
    out = None
    for k, who, text, top, x, wide, parts, tabled in _LINES:
        e = lambda sql: F.expr(sql.replace("::VARCHAR", ""))
        one = pg.where(who).select(F.col("c").alias("doc_id"), "page", F.lit(k).cast("long").alias("line"), e(text).cast("string").alias("text"), F.lit(float(top)).alias("top"), F.lit(top + 10.0).alias("bottom"), e(x).cast("double").alias("x0"), e(f"{x} + {wide}").cast("double").alias("x1"), F.lit(parts).cast("long").alias("parts"), e(tabled).alias("tabled"))
        out = one if out is None else out.union(one)
    return out.withColumn("page_height", F.lit(792.0))


_PAGES = "pg AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders)"


@R.add(f"WITH {_PAGES}, every AS ({_EVERY}), {FURNITURE}")
def furniture_conditions(spark, sf):
    """Heads that are stacked, below a table's rows or in a table, numbers that wander, and feet of three parts."""
    return furniture.find_furniture(lines(spark, sf))


@R.add(f"WITH {_PAGES}, n AS (SELECT c AS doc_id, count(*) AS pages FROM pg GROUP BY 1) SELECT * FROM n WHERE pages > 8 AND doc_id % 2 = 1")
def long_without_furniture(spark, sf):
    """Documents of even keys have furniture."""
    every = lines(spark, sf)
    return furniture.long_without(every, every.where("doc_id % 2 = 0"))


@R.add("""SELECT p_partkey AS doc_id, g.page, g.line FROM part, (VALUES (1, 0), (1, 1), (2, 0), (2, 1)) g(page, line) WHERE p_size % 5 <> 0 AND NOT (p_size % 3 = 0 AND line = 0) AND NOT (p_size % 4 = 0 AND line = 0)""")
def tabled_lines(spark, sf):
    """Two lines over a grid of two by two cells; a word beside it in the first line at every third size, a blank cell in the second at every fourth, the same box on both pages at every fifth."""
    P, S = F.col("p_partkey"), F.col("p_size")
    i = F.explode(F.array(*(F.struct(F.lit(p).alias("page"), F.lit(l).alias("line"), F.lit(k).alias("k")) for p in (1, 2) for l in (0, 1) for k in (0, 1, 2))))  # noqa: E741
    w = table(spark, sf, "part").select(P.alias("doc_id"), S.alias("s"), i.alias("i")).select("doc_id", "s", "i.*")
    w = w.where(((F.col("k") < 2) | ((F.col("line") == 0) & (F.col("s") % 3 == 0))) & ~((F.col("s") % 4 == 0) & (F.col("line") == 1) & (F.col("k") == 1)))
    text = F.concat(F.lit("w"), F.col("line").cast("string"), F.when(F.col("s") % 5 == 0, F.lit("")).otherwise(F.element_at(F.array(F.lit("a"), F.lit("b")), F.col("page"))))
    x, y = 10.0 + 100 * F.col("k"), 12.0 + 20 * F.col("line")
    words = w.select("doc_id", "page", "line", (F.col("line") * 10 + F.col("k")).alias("id"), text.alias("text"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 10).alias("y1"))
    c = F.explode(F.array(*(F.struct(F.lit(p).alias("page"), F.lit(r).alias("row"), F.lit(k).alias("col")) for p in (1, 2) for r in (0, 1) for k in (0, 1))))
    cells = table(spark, sf, "part").select(P.alias("doc_id"), c.alias("c")).select("doc_id", "c.page", F.lit(1).alias("tbl"), "c.row", "c.col", (100.0 * F.col("c.col")).alias("x0"), (10.0 + 20 * F.col("c.row")).alias("y0"), (100.0 * F.col("c.col") + 100).alias("x1"), (30.0 + 20 * F.col("c.row")).alias("y1"))
    return furniture.tabled_lines(words, cells)


#: (the first line's parts, size, top, whether a table holds it, the role that it is found in and its key)
_HEADS = [
    (["Running head"], 8.0, 60.0, False, ("header", "Running head")),
    (["Running head"], 10.0, 60.0, False, None),
    (["Report 7"], 10.0, 60.0, False, ("header", "Report")),
    (["Homework 3"], 14.0, 60.0, False, None),
    (["Title", "3"], 14.0, 60.0, False, ("header", "Title")),
    (["Page 2 of 28"], 14.0, 60.0, False, ("header", "Page # of")),
    (["1. note text"], 8.0, 60.0, False, None),
    (["* see there"], 8.0, 60.0, False, None),
    (["9 is called"], 8.0, 60.0, False, None),
    (["Running head"], 8.0, 100.0, False, None),
    (["Running head"], 8.0, 60.0, True, None),
    (["A", "B", "C"], 8.0, 60.0, False, None),
]


@R.add(
    "SELECT p_partkey AS doc_id, 5::BIGINT AS line, '#' AS key, 'page_number' AS role FROM part UNION ALL SELECT p_partkey, 0, h.key, h.role FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{h[4][0]}', '{h[4][1]}')" for i, h in enumerate(_HEADS) if h[4])
    + f") h(i, role, key) ON p_partkey % {len(_HEADS)} = h.i"
)
def one_page_furniture(spark, sf):
    """Documents of one page: a first line that is or isn't set apart, four lines of text, and a page number."""
    P = F.col("p_partkey")
    part = lambda x, t: F.struct(F.lit(float(x)).alias("x0"), F.lit(x + 40.0).alias("x1"), F.lit(t).alias("text"))
    line = lambda n, top, high, size, parts, tabled=False: F.struct(F.lit(n).cast("long").alias("line"), F.lit(float(top)).alias("top"), F.lit(float(top + high)).alias("bottom"), F.lit(size).alias("size"), F.array(*(part(72 + 100 * i, t) for i, t in enumerate(parts))).alias("parts"), F.lit(tabled).alias("tabled"))
    heads = F.array(*(line(0, top, 10.0, size, parts, tabled) for parts, size, top, tabled, _ in _HEADS))
    body = [line(n, 100 + 12 * n, 10.0, 10.0, ["words", "of", "text"] if n == 1 else ["words of text"]) for n in range(1, 5)]
    held = F.concat(F.array(F.element_at(heads, (P % len(_HEADS) + 1).cast("int"))), F.array(*body, line(5, 290.0, 10.0, 10.0, ["12"])))
    d = table(spark, sf, "part").select(P.alias("doc_id"), F.explode(held).alias("l")).select("doc_id", F.lit(1).alias("page"), "l.*")
    every = d.withColumn("text", F.array_join(F.transform("parts", lambda x: x.text), " ")).withColumn("page_height", F.lit(792.0))
    docs = table(spark, sf, "part").select(P.alias("doc_id"))
    return furniture.one_page(every, docs.withColumn("body", F.lit(10.0)), docs.withColumn("label", F.lit("9")))
