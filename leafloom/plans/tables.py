"""Queries over tables typeset from the sales, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions import tokens as tk
from leafloom.operators import export, tables, verify
from leafloom.plans.registry import Registry, table
from leafloom.sources import typeset as ts

R = Registry()
C = f"WITH {ts.SALES_CELLS_SQL}"
#: The same, computed once where a query reads it several times.
ONCE = C.replace("cells AS (", "cells AS MATERIALIZED (")
W = f"{C}, {ts.SALES_WORDS_SQL}"


def cells(spark, sf):
    return ts.sales_cells(table(spark, sf, "lineitem"))


def words(spark, sf):
    return ts.sales_words(cells(spark, sf))


def spanned(spark, sf):
    """The cells, with a title over all columns above them."""
    one = F.lit(1).cast("long")
    body = cells(spark, sf).select("tbl", (F.col("row") + 1).alias("row"), "col", one.alias("row_span"), one.alias("col_span"), "text")
    title = body.select("tbl").distinct().select("tbl", F.lit(0).cast("long"), F.lit(0).cast("long"), one, F.lit(4).cast("long"), F.concat(F.lit("Order | "), F.col("tbl").cast("string"), F.lit(" <b>")))
    return body.union(title)


SPANNED = f"""{C}, spanned AS (SELECT tbl, "row" + 1 AS "row", col, 1 AS row_span, 1 AS col_span, text FROM cells UNION ALL SELECT DISTINCT tbl, 0, 0, 1, 4, 'Order | ' || tbl || ' <b>' FROM cells)"""


def rules(spark, sf):
    """Each table's lines, every horizontal one in two pieces, the second set off a little; every fifth table lacks its last column's line."""
    size = cells(spark, sf).groupBy("tbl").agg((F.max("row") + 1).alias("rows"))
    h = size.select("tbl", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows"))).alias("i")).select(
        "tbl", F.explode(F.array(F.struct((F.lit(89.0) + 12 * F.col("i")).alias("at"), F.lit(70.0).alias("start"), F.lit(290.0).alias("end")), F.struct((F.lit(89.1) + 12 * F.col("i")).alias("at"), F.lit(290.3).alias("start"), F.lit(510.0).alias("end")))).alias("r")
    ).select("tbl", F.lit("h").alias("axis"), F.round("r.at", 2).alias("at"), "r.start", "r.end")
    v = size.select("tbl", "rows", F.explode(F.sequence(F.lit(0), F.when(F.col("tbl") % 5 == 0, 3).otherwise(4))).alias("i")).select("tbl", F.lit("v").alias("axis"), (F.lit(70.0) + 110 * F.col("i")).alias("at"), F.lit(89.0).alias("start"), F.round(F.lit(89.1) + 12 * F.col("rows"), 2).alias("end"))
    return h.union(v)


RULES = f"""{W}, size AS (SELECT tbl, max("row") + 1 AS n_rows FROM cells GROUP BY 1),
rules AS (SELECT tbl, 'h' AS axis, round(89.0::DOUBLE + 12 * i, 2) AS at, 70.0::DOUBLE AS s, 290.0::DOUBLE AS e FROM (SELECT tbl, unnest(range(0, n_rows + 1)) AS i FROM size)
    UNION ALL SELECT tbl, 'h', round(89.1::DOUBLE + 12 * i, 2), 290.3, 510.0 FROM (SELECT tbl, unnest(range(0, n_rows + 1)) AS i FROM size)
    UNION ALL SELECT tbl, 'v', 70.0::DOUBLE + 110 * i, 89.0, round(89.1::DOUBLE + 12 * n_rows, 2) FROM (SELECT tbl, n_rows, unnest(range(0, CASE WHEN tbl % 5 = 0 THEN 4 ELSE 5 END)) AS i FROM size))"""
#: The merged rules and the closed cells, by construction.
MERGED = f"""{RULES}, merged AS (SELECT tbl, 'h' AS axis, round(89.0::DOUBLE + 12 * i, 2) AS at, 70.0::DOUBLE AS s, 510.0::DOUBLE AS e FROM (SELECT tbl, unnest(range(0, n_rows + 1)) AS i FROM size) UNION ALL SELECT * FROM rules WHERE axis = 'v')"""
GRID = f"""{W}, grid AS (SELECT DISTINCT tbl, "row", col, 70.0::DOUBLE + 110 * col AS x0, round(89.0::DOUBLE + 12 * "row", 2) AS y0, 180.0::DOUBLE + 110 * col AS x1, round(101.0::DOUBLE + 12 * "row", 2) AS y1 FROM cells WHERE NOT (tbl % 5 = 0 AND col = 3))"""


@R.add(f"{C} SELECT * FROM cells")
def typeset_cells(spark, sf):
    return cells(spark, sf)


@R.add(f'{MERGED} SELECT tbl, axis, "at", s AS start, e AS "end" FROM merged')
def rule_merge(spark, sf):
    return tables.merge_rules(rules(spark, sf))


@R.add(f"{RULES} SELECT tbl, count(*) FILTER (axis = 'h') AS h, count(*) FILTER (axis = 'v') AS v FROM rules GROUP BY 1")
def ruled_pages(spark, sf):
    return tables.ruled_pages(rules(spark, sf))


@R.add(f"{GRID} SELECT * FROM grid")
def lattice_cells(spark, sf):
    return tables.lattice_cells(tables.merge_rules(rules(spark, sf)))


@R.add(f"""{W} SELECT tbl, "row", col, text FROM cwords WHERE NOT (tbl % 5 = 0 AND col = 3)""")
def lattice_roundtrip(spark, sf):
    """Words put into the cells that the rules draw: the source rows, but for the column that is not closed."""
    return tables.words_in_cells(words(spark, sf), tables.lattice_cells(tables.merge_rules(rules(spark, sf)))).select("tbl", "row", "col", "text")


@R.add(f"""{W} SELECT tbl, "row", col, text FROM cwords WHERE col = 0 AND x1 + 70 > 181 AND NOT (tbl % 5 = 0 AND col = 3)""")
def crossing_words(spark, sf):
    """Labels drawn 70 points longer than they are: those that overhang their cell."""
    long = words(spark, sf).withColumn("x1", F.when(F.col("col") == 0, F.col("x1") + 70).otherwise(F.col("x1")))
    return tables.crossing(tables.words_in_cells(long, tables.lattice_cells(tables.merge_rules(rules(spark, sf))))).select("tbl", "row", "col", "text")


@R.add(f"{W} SELECT tbl, \"row\", col, text FROM cells")
def corridor_roundtrip(spark, sf):
    """Rows and columns found again from the boxes of words alone."""
    return tables.corridor_cells(words(spark, sf).drop("row", "col"))


@R.add(f"{W} SELECT DISTINCT tbl, 1::BIGINT AS header_rows FROM cells")
def header_rows(spark, sf):
    return tables.header_rows(cells(spark, sf))


@R.add(f"""{W}, v AS (SELECT tbl, col, min(x0) AS x0, max(x1) AS x1 FROM cwords WHERE "row" > 0 GROUP BY 1, 2) SELECT tbl, col AS "column", x0, x1 FROM v""")
def value_columns(spark, sf):
    return tables.value_columns(words(spark, sf))


@R.add(f"""{W}, r AS (SELECT tbl, "row", min(y0) AS low, max(y1) AS high FROM cwords GROUP BY 1, 2) SELECT tbl, "row", coalesce((lag(high) OVER w + low) / 2, low) AS y0, coalesce((high + lead(low) OVER w) / 2, high) AS y1 FROM r WINDOW w AS (PARTITION BY tbl ORDER BY "row")""")
def row_edges(spark, sf):
    return tables.row_edges(words(spark, sf))


@R.add(f"""{C}, l AS (SELECT tbl, "row", string_agg(text, ' ' ORDER BY col) AS line FROM cells GROUP BY 1, 2) SELECT tbl, string_agg(line, chr(10) ORDER BY "row") AS text FROM l GROUP BY 1""")
def table_texts(spark, sf):
    return tables.table_text(cells(spark, sf))


@R.add(f"""{SPANNED} SELECT tbl, "row", c.col AS col, text, c.col <> s.col AS copy FROM (SELECT *, unnest(range(col, col + col_span)) AS cc FROM spanned) s, LATERAL (SELECT cc AS col) c""")
def dense_rows(spark, sf):
    return export.dense_rows(spanned(spark, sf))


@R.add(f"""{SPANNED}, l AS (SELECT tbl, "row", CASE WHEN "row" = 0 THEN '| ' || max(replace(regexp_replace(text, '<([A-Za-z/!?])', '\\\\<\\1', 'g'), '|', '\\|')) || ' |  |  |  |' ELSE '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' END AS s FROM spanned GROUP BY 1, 2),
    r AS (SELECT tbl, "row" * 2 AS o, s FROM l UNION ALL SELECT tbl, 1, '| --- | --- | --- | --- |' FROM l WHERE "row" = 0) SELECT tbl, string_agg(s, chr(10) ORDER BY o) AS markdown FROM r GROUP BY 1""")
def table_markdown(spark, sf):
    return export.table_markdown(spanned(spark, sf))


@R.add(f"""{SPANNED}, c AS (SELECT *, CASE WHEN "row" < 2 THEN 'th' ELSE 'td' END AS tag, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc FROM spanned),
    l AS (SELECT tbl, "row", '<tr>' || string_agg('<' || tag || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || '>' || esc || '</' || tag || '>', '' ORDER BY col) || '</tr>' AS s FROM c GROUP BY 1, 2)
    SELECT tbl, '<table>' || string_agg(CASE WHEN "row" = 0 THEN '<thead>' WHEN "row" = 2 THEN '<tbody>' ELSE '' END || s || CASE WHEN "row" = 1 THEN '</thead>' ELSE '' END, '' ORDER BY "row") || '</tbody></table>' AS html FROM l GROUP BY 1""")
def table_html(spark, sf):
    return export.table_html(spanned(spark, sf), 2)


@R.add(f"{SPANNED} SELECT tbl, \"row\", col FROM spanned WHERE \"row\" % 3 = 2 AND col = 1")
def uncovered_positions(spark, sf):
    """Positions of cells taken away from whole grids."""
    one = F.lit(1).cast("long")
    kept = spanned(spark, sf).where(~((F.col("row") % 3 == 2) & (F.col("col") == 1)))
    return tables.uncovered(kept.withColumn("row_span", one))


_VALUE = tk.value_pattern(tk.CODES).replace("'", "''")


@R.add(f"""{C} SELECT DISTINCT tbl, false AS layout FROM cells UNION ALL SELECT doc_id + 10000000000, len(string_split(coalesce(text, ''), ' ')) >= 3 AND NOT regexp_full_match(trim(coalesce(text, '')), '{_VALUE}') FROM documents""")
def ruled_layouts(spark, sf):
    """Tables, and frames around one column of running text."""
    prose = table(spark, sf, "documents").select((F.col("doc_id") + 10_000_000_000).alias("tbl"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.coalesce("text", F.lit("")).alias("text"))
    return tables.running_text_columns(cells(spark, sf).unionByName(prose))


@R.add("""SELECT p_size::BIGINT AS page, round(1 / 20::DOUBLE, 6) AS scale FROM part WHERE p_size % 4 <> 1 GROUP BY 1 HAVING count(*) >= 3""")
def chart_bars(spark, sf):
    """Bars as high as a part's price; on every fourth page they stand on no common line."""
    p = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("page"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("value"))
    foot = F.when(F.col("page") % 4 == 1, F.lit(700.0) + F.col("k") % 7).otherwise(F.lit(700.0))
    x = F.lit(10.0) * (F.col("k") % 50)
    return tables.bars(p.select("page", x.alias("x0"), (foot - F.col("value") / 20).alias("y0"), (x + 8).alias("x1"), foot.alias("y1"), "value"))


@R.add(f"{C} SELECT col, text FROM cells WHERE \"row\" > 0 AND (col > 0) GROUP BY 1, 2")
def value_cells(spark, sf):
    """The distinct value cells by column: counts, money and shares."""
    return cells(spark, sf).where("row > 0").where(tk.is_value(F.col("text"))).select("col", "text").distinct()


@R.add(f"""{W} SELECT tbl, "row", 0::BIGINT AS col FROM cells WHERE tbl % 4 = 1 AND col = 3""")
def verify_vrule(spark, sf):
    """Cells made of two neighbouring ones: in every fourth table a drawn rule runs through the first, with words on either side."""
    w = words(spark, sf).withColumn("col", F.when(F.col("col") < 2, F.lit(0)).otherwise(F.col("col")).cast("long"))
    c = w.groupBy("tbl", "row", "col").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    drawn = c.where("tbl % 4 = 1").groupBy("tbl").agg(F.min("y0").alias("start"), F.max("y1").alias("end")).select("tbl", F.lit("v").alias("axis"), F.lit(180.0).alias("at"), "start", "end")
    points = w.select("tbl", "row", "col", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return verify.cuts(c, drawn, points).drop("axis")


def _tabled(spark, sf, forms):
    """A heading, the table and a running foot of each order, as blocks."""
    t = cells(spark, sf).select(F.col("tbl").alias("doc_id")).distinct()
    one = lambda n, kind, text: t.select("doc_id", F.lit(n).cast("long").alias("block"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(10.0).alias("size"), text.alias("text"))
    blocks = one(1, "heading", F.concat(F.lit("Order "), F.col("doc_id").cast("string"))).union(one(2, "table", F.lit(""))).union(one(3, "furniture", F.lit("Page 1")))
    return export.document_markdown(blocks, forms.select(F.col("tbl").alias("doc_id"), F.lit(2).cast("long").alias("block"), F.col(forms.columns[1]).alias("form")))


@R.add(f"""WITH m AS ({R.oracles["table_markdown"]}) SELECT tbl AS doc_id, '# Order ' || tbl || chr(10) || chr(10) || markdown || chr(10) AS markdown FROM m""")
def markdown_with_tables(spark, sf):
    """Documents with a pipe table; the running foot is left out."""
    return _tabled(spark, sf, export.table_markdown(spanned(spark, sf)))


@R.add(f"""WITH m AS ({R.oracles["table_html"]}) SELECT tbl AS doc_id, '# Order ' || tbl || chr(10) || chr(10) || html || chr(10) AS markdown FROM m""")
def markdown_with_html(spark, sf):
    """The same with tables as HTML."""
    return _tabled(spark, sf, export.table_html(spanned(spark, sf), 2))


@R.add("""SELECT o_orderkey AS doc_id, '<!DOCTYPE html><html><body><section><svg viewBox="0 0 612 792"><rect class="word" x="1.0" y="2.0" width="10.0" height="8.0"><title>w&lt;' || o_orderkey || '</title></rect><rect class="block" x="0.0" y="0.0" width="50.0" height="20.0"><title>a &amp; b</title></rect></svg><div class="card"><b>b1 paragraph</b> a &amp; b</div>' || CASE WHEN o_custkey % 2 = 0 THEN '<div class="finding"><b>hidden_text</b> 3 characters</div>' ELSE '' END || '</section></body></html>' AS html FROM orders""")
def inspector_pages(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_custkey").alias("c"))
    box = [F.lit(float(v)).alias(n) for v, n in zip((0, 0, 50, 20), ("x0", "y0", "x1", "y1"), strict=True)]
    words = o.select("doc_id", "page", F.lit(0).alias("id"), *(F.lit(float(v)).alias(n) for v, n in zip((1, 2, 11, 10), ("x0", "y0", "x1", "y1"), strict=True)), F.concat(F.lit("w<"), F.col("doc_id").cast("string")).alias("text"))
    blocks = o.select("doc_id", "page", F.lit(1).alias("block"), F.lit("paragraph").alias("kind"), *box, F.lit("a & b").alias("text"))
    findings = o.where("c % 2 = 0").select("doc_id", "page", F.lit("hidden_text").alias("code"), F.lit("3 characters").alias("detail"))
    return export.inspector_html(o.select("doc_id", "page", F.lit(612).alias("width"), F.lit(792).alias("height")), words, blocks, findings)
