"""Queries over what other tools write and read, and over names, units and terms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions import tokens as tk
from leafloom.operators import export, reader
from leafloom.plans import tables
from leafloom.plans.registry import Registry, spread, table
from leafloom.sources import formats

R = Registry()


def text(c):
    return c.cast("string")


def exploded(df, cells: str = "cells", *keep: str):
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def sales(spark, sf):
    """The sales tables' cells, each order's table on page 1."""
    one = F.lit(1).cast("long")
    return tables.cells(spark, sf).select(F.col("tbl").alias("doc"), F.lit(0).alias("tbl"), F.lit(1).alias("page"), F.lit(70).alias("x0"), F.lit(80).alias("y0"), F.lit(510).alias("x1"), F.lit(700).alias("y1"), "row", "col", one.alias("rows"), one.alias("cols"), "text")


@R.add(f"""{tables.C} SELECT tbl AS doc, 0::BIGINT AS tbl, 0::BIGINT AS region, 1::BIGINT AS page, "row", col, "row" AS end_row, col AS end_col, text, 70.0::DOUBLE AS x1, 80.0::DOUBLE AS y1, 510.0::DOUBLE AS x2, 700.0::DOUBLE AS y2 FROM cells""")
def structure_file_roundtrip(spark, sf):
    """Structure files written and read back."""
    return formats.icdar_cells(formats.icdar_structure_xml(sales(spark, sf)))


@R.add("""SELECT o_custkey AS doc, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<document filename="' || o_custkey || '.pdf">' || string_agg('<table id="' || n || '"><region id="1" page="' || page || '"><bounding-box x1="' || x0 || '" y1="10" x2="' || x0 + 9 || '" y2="20"/></region></table>', '' ORDER BY n) || '</document>' || chr(10) AS xml
    FROM (SELECT o_custkey, o_orderkey % 7 AS page, o_orderkey % 500 AS x0, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1""")
def region_files(spark, sf):
    o = F.col("o_orderkey")
    return formats.icdar_region_xml(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), o.alias("tbl"), (o % 7).alias("page"), (o % 500).alias("x0"), F.lit(10).alias("y0"), (o % 500 + 9).alias("x1"), F.lit(20).alias("y1")))


@R.add("""WITH b AS (SELECT p_partkey AS id, (p_size % 4 * 90)::INT AS r, (p_partkey % 500)::DOUBLE + 0.25 AS x0, (p_partkey % 600)::DOUBLE + 0.75 AS y0, (p_partkey % 500)::DOUBLE + 50.5 AS x1, (p_partkey % 600)::DOUBLE + 9.25 AS y1 FROM part),
    s AS (SELECT *, CASE r WHEN 0 THEN x0 WHEN 90 THEN 792 - y1 WHEN 180 THEN 612 - x1 ELSE y0 END AS a, CASE r WHEN 0 THEN y0 WHEN 90 THEN x0 WHEN 180 THEN 792 - y1 ELSE 612 - x1 END AS b, CASE r WHEN 0 THEN x1 WHEN 90 THEN 792 - y0 WHEN 180 THEN 612 - x0 ELSE y1 END AS c, CASE r WHEN 0 THEN y1 WHEN 90 THEN x1 WHEN 180 THEN 792 - y0 ELSE 612 - x0 END AS d, CASE WHEN r IN (90, 270) THEN 612 ELSE 792 END AS h FROM b)
    SELECT id, floor(a)::BIGINT AS ux0, floor(h - d)::BIGINT AS uy0, ceil(c)::BIGINT AS ux1, ceil(h - b)::BIGINT AS uy1, round(a * 1000 / h, 6) AS px0, round(b * 1000 / h, 6) AS py0, round(c * 1000 / h, 6) AS px1, round(d * 1000 / h, 6) AS py1 FROM s""")
def scorer_boxes(spark, sf):
    """Boxes as two scorers measure them."""
    P, S = F.col("p_partkey"), F.col("p_size")
    x, y = (P % 500).cast("double"), (P % 600).cast("double")
    box, r, w, h, zero = (x + 0.25, y + 0.75, x + 50.5, y + 9.25), (S % 4 * 90).cast("int"), F.lit(612.0), F.lit(792.0), F.lit(0.0)
    user, image = formats.user_box(r, box, zero, h, w, h), formats.image_box(r, box, w, h)
    names = ("x0", "y0", "x1", "y1")
    return table(spark, sf, "part").select(P.alias("id"), *(c.alias(f"u{n}") for c, n in zip(user, names, strict=True)), *(F.round(c, 6).alias(f"p{n}") for c, n in zip(image, names, strict=True)))


@R.add("""SELECT p_size || '_' || (p_partkey % 4) || '.jpg' AS image, count(*) AS tables, string_agg('<table>' || p_partkey || '</table>', '' ORDER BY p_partkey) AS html, sum(p_partkey % 100)::DOUBLE AS x FROM part GROUP BY 1""")
def image_predictions(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    t = table(spark, sf, "part").select(S.alias("doc"), (P % 4 + 1).alias("page"), P.alias("tbl"), (P % 100).cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), F.concat(F.lit("<table>"), text(P), F.lit("</table>")).alias("html"))
    return formats.image_predictions(t).select("image", F.size("boxes").cast("long").alias("tables"), F.array_join("html", "").alias("html"), F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b[0]).alias("x"))


@R.add(f"""{tables.SPANNED} SELECT tbl, "row", col, row_span::BIGINT AS "rows", col_span::BIGINT AS cols, text, "row" < 2 AS header FROM spanned""")
def html_table_cells(spark, sf):
    """Tables written as HTML and read back."""
    return exploded(export.table_html(tables.spanned(spark, sf), 2).select("tbl", formats.html_cells(F.col("html")).alias("cells")), "cells", "tbl")


@R.add(rf"""{tables.SPANNED}, d AS (SELECT tbl, "row", c AS col, CASE WHEN "row" > 0 THEN text WHEN c = 0 THEN replace(text, '<b', '\<b') ELSE '' END AS text FROM spanned, range(4) r(c) WHERE c = col OR "row" = 0) SELECT tbl, "row", col, 1::BIGINT AS "rows", 1::BIGINT AS cols, text, "row" = 0 AS header FROM d""")
def pipe_table_cells(spark, sf):
    """Tables written as pipe tables between two lines of text, turned into HTML and read."""
    m = F.concat(F.lit("before | here\n"), "markdown", F.lit("\n\nafter"))
    return exploded(export.table_markdown(tables.spanned(spark, sf)).select("tbl", formats.html_cells(formats.pipes_to_html(m)).alias("cells")), "cells", "tbl")


_TSV = """w AS (SELECT l_orderkey AS doc, l_suppkey % 4 AS page, l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_returnflag || ' ' || l_linestatus AS text, (l_partkey % 400)::DOUBLE AS x, (l_suppkey % 600)::DOUBLE AS y, CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 5 END AS level FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS nth FROM w),
    t AS (SELECT *, (row_number() OVER (PARTITION BY doc, page ORDER BY nth) - 1)::BIGINT AS id FROM n WHERE level = 5)"""


def _tsv(spark, sf):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    order = ["l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]
    level = F.when(F.col("l_linenumber") % 3 == 0, "4").otherwise("5")
    line = F.concat_ws("\t", level, text(2 * (k % 400)), text(2 * (s % 600)), F.lit("60"), F.lit("20"), F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (s % 4).alias("page"), F.struct(*order, line.alias("line")).alias("l"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.line), "\n")
    pages = d.groupBy("doc", "page").agg(F.concat(F.lit("level\tleft\ttop\twidth\theight\ttext\n"), lines).alias("tsv"))
    return pages.select("*", F.lit(0.5).alias("scale"), (F.col("page") * 90).cast("int").alias("rotation"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


@R.add(f"""WITH {_TSV} SELECT doc, page, id, replace(text, ' ', '') AS text, CASE page WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 612 - x - 30 ELSE 612 - y - 10 END AS x0, CASE page WHEN 0 THEN y WHEN 1 THEN 792 - x - 30 WHEN 2 THEN 792 - y - 10 ELSE x END AS y0,
    CASE page WHEN 0 THEN x + 30 WHEN 1 THEN y + 10 WHEN 2 THEN 612 - x ELSE 612 - y END AS x1, CASE page WHEN 0 THEN y + 10 WHEN 1 THEN 792 - x WHEN 2 THEN 792 - y ELSE x + 30 END AS y1, 10.0::DOUBLE AS size, page = 0 AS horizontal FROM t""")
def recognised_words(spark, sf):
    """A recogniser's TSV, on turned pages too."""
    return formats.words_from_tsv(_tsv(spark, sf))


@R.add(f"""WITH {_TSV}, every AS (SELECT doc, page, id, replace(text, ' ', '') AS text FROM t WHERE page < 2 UNION ALL SELECT o_orderkey, 2, 0, 'kept' FROM orders UNION ALL SELECT o_orderkey, 1, 0, 'kept' FROM orders WHERE o_orderkey NOT IN (SELECT doc FROM t WHERE page = 1)) SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page, id) - 1 AS id, text FROM every""")
def replaced_words(spark, sf):
    """Words of two pages of each order; the recogniser read the pages 0 and 1 only."""
    seen = formats.words_from_tsv(_tsv(spark, sf).where("page < 2")).select("doc", "page", "id", "text")
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("page"), F.lit(0).cast("long").alias("id"), F.lit("kept").alias("text"))
    return formats.words_replaced(own, seen)


@R.add(f"""{tables.ONCE}, h AS (SELECT tbl, col, text AS head FROM cells WHERE "row" = 0), s AS (SELECT tbl, "row", text AS stub FROM cells WHERE col = 0)
    SELECT c.tbl AS doc, text AS value, stub || '/' || head AS labels FROM cells c JOIN h USING (tbl, col) JOIN s USING (tbl, "row") WHERE "row" > 0 AND col > 0""")
def access_path_rows(spark, sf):
    """Each value of the sales tables with its row's and column's label, as a file of access paths, half of them with semicolons."""
    # a row's cells are one array, a table's rows another, of which the first are the heads
    c = tables.cells(spark, sf).where("tbl is not null")
    r = c.groupBy("tbl", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("stub"), F.array_sort(F.collect_list(F.when(F.col("col") > 0, F.struct("col", "text")))).alias("cells"))
    rows = r.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("row", "stub", "cells"))).alias("rows"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    mark = F.when(F.col("tbl") % 2 == 0, ",").otherwise(";")
    line = lambda stub, head, cell: F.concat(quoted(stub), mark, mark, quoted(head.text), mark, quoted(cell.text))
    body = F.transform(F.slice("rows", 2, F.size("rows")), lambda r: F.array_join(F.zip_with(F.get("rows", 0).cells, r.cells, lambda head, cell: line(r.stub, head, cell)), "\n"))
    files = rows.select("tbl", F.array_join(F.filter(body, lambda x: x != ""), "\n").alias("body"))
    got = formats.access_path_rows(files.select(F.col("tbl").alias("doc"), F.concat(F.when(F.col("tbl") % 2 == 0, '"0",,').otherwise('"0";;'), F.lit("\n"), "body").alias("text")))
    return got.select("doc", "value", F.array_join(F.transform("dimensions", lambda d: F.array_join(d, "|")), "/").alias("labels"))


def _json_cells():
    """Two by two cells, one of which spans a place that another one holds."""
    P = F.col("p_partkey")
    return lambda row, col, rows, cols, t, head: F.array(*(F.struct(F.lit(r).alias(row), F.lit(c).alias(col), F.lit(a).alias(rows), F.lit(b).alias(cols), F.concat(F.lit(x), text(P)).alias(t), F.lit(r == 0).alias(head)) for r, c, a, b, x in ((0, 0, 1, 2, "h"), (1, 0, 1, 2, "a"), (1, 1, 1, 1, "b"))))


@R.add("""SELECT p_partkey AS doc, r.tbl::BIGINT AS tbl, p_size::BIGINT AS page, 10.0::DOUBLE AS x0, CASE WHEN p_partkey % 2 = 0 THEN 92.0 ELSE 20.0 END::DOUBLE AS y0, 90.0::DOUBLE AS x1, CASE WHEN p_partkey % 2 = 0 THEN 772.0 ELSE 700.0 END::DOUBLE AS y1, c.r::BIGINT AS "row", c.c::BIGINT AS col, c.n::BIGINT AS cols, c.t || p_partkey AS text
    FROM part, (VALUES (1)) r(tbl), (VALUES (0, 0, 2, 'h'), (1, 0, 1, 'a'), (1, 1, 1, 'b')) c(r, c, n, t)""")
def converter_tables(spark, sf):
    """A converter's JSON: the first table has no provenance, every second one is measured from the bottom."""
    P, S = F.col("p_partkey"), F.col("p_size")
    cells = _json_cells()("start_row_offset_idx", "start_col_offset_idx", "row_span", "col_span", "text", "column_header")
    box = F.struct(F.lit(10.0).alias("l"), F.when(P % 2 == 0, 700.0).otherwise(20.0).alias("t"), F.lit(90.0).alias("r"), F.when(P % 2 == 0, 20.0).otherwise(700.0).alias("b"), F.when(P % 2 == 0, "BOTTOMLEFT").otherwise("TOPLEFT").alias("coord_origin"))
    prov = F.array(F.struct(S.alias("page_no"), box.alias("bbox")))
    data = F.struct(cells.alias("table_cells"))
    t = F.array(F.struct(F.slice(prov, 1, 0).alias("prov"), data.alias("data")), F.struct(prov.alias("prov"), data.alias("data")))
    pages = F.create_map(text(S), F.struct(F.struct(F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).alias("size")))
    got = formats.proved_tables(spread(table(spark, sf, "part")).select(P.alias("doc"), F.to_json(F.struct(pages.alias("pages"), t.alias("tables"))).alias("json")))
    keep = ["doc", "tbl", "page", "x0", "y0", "x1", "y1"]
    return exploded(got, "cells", *keep).select(*keep, "row", "col", "cols", "text")


@R.add("""SELECT p_partkey AS doc, (p_size % 3)::BIGINT AS tbl, (p_size + 1)::BIGINT AS page, 1.0::DOUBLE AS x0, 4.0::DOUBLE AS y1, 0::BIGINT AS "row", c.c::BIGINT AS col, c.t || p_partkey AS text FROM part, (VALUES (0, 'a'), (1, 'b')) c(c, t) UNION ALL SELECT p_partkey, i, p_size + 1, 1.0, 4.0, 0, 0, 'x' FROM part, range(3) r(i) WHERE i < p_size % 3""")
def block_tree_tables(spark, sf):
    """A converter's tree of blocks: some tables within groups, and one at the end."""
    P, S = F.col("p_partkey"), F.col("p_size")
    html = F.concat(F.lit("<table><tr><td>a"), text(P), F.lit("</td><td>b"), text(P), F.lit("</td></tr></table>"))
    block = lambda i, h: F.concat(F.lit('{"block_type":"Table","id":"/page/'), text(S), F.lit(f'/Table/{i}","bbox":[1,2,3,4],"html":"'), h, F.lit('"}'))
    inner = F.array_join(F.slice(F.array(*(block(i, F.lit("<table><tr><td>x</td></tr></table>")) for i in range(3))), 1, (S % 3).cast("int")), ",")
    tree = F.concat(F.lit('{"block_type":"Document","children":[{"block_type":"Group","children":['), inner, F.lit("]},"), block(9, html), F.lit(",{\"block_type\":\"Text\",\"html\":\"<table><tr><td>no</td></tr></table>\"}]}"))
    got = formats.block_tables(spread(table(spark, sf, "part")).select(P.alias("doc"), tree.alias("json")))
    return exploded(got, "cells", "doc", "tbl", "page", "x0", "y1").select("doc", "tbl", "page", "x0", "y1", "row", "col", "text")


@R.add("""SELECT p_partkey AS doc, 1::BIGINT AS tbl, p_size::BIGINT AS page, 61.2::DOUBLE AS x0, 79.2::DOUBLE AS y0, 306.0::DOUBLE AS x1, 396.0::DOUBLE AS y1, 0::BIGINT AS "row", 'c' || p_partkey AS text FROM part WHERE p_size % 4 <> 0""")
def element_tables(spark, sf):
    """A partitioner's elements, in pixels of a page image twice as large; every fourth table's structure is missing."""
    P, S = F.col("p_partkey"), F.col("p_size")
    html = F.when(S % 4 != 0, F.concat(F.lit("<table><tr><td>c"), text(P), F.lit("</td></tr></table>")))
    points = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((122.4, 158.4), (612.0, 158.4), (612.0, 792.0), (122.4, 792.0))))
    meta = F.struct(html.alias("text_as_html"), S.alias("page_number"), F.struct(F.lit("PixelSpace").alias("system"), F.lit(1224.0).alias("layout_width"), F.lit(1584.0).alias("layout_height"), points.alias("points")).alias("coordinates"))
    e = F.array(F.struct(F.lit("Text").alias("type"), meta.alias("metadata")), F.struct(F.lit("Table").alias("type"), meta.alias("metadata")))
    got = formats.element_tables(spread(table(spark, sf, "part")).select(P.alias("doc"), F.to_json(e).alias("json"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height")))
    return exploded(got, "cells", "doc", "tbl", "page", "x0", "y0", "x1", "y1").select("doc", "tbl", "page", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "row", "text")


@R.add("""SELECT p_name AS item, arg_min(p_brand, (p_size, p_partkey)) AS "group" FROM part GROUP BY 1""")
def benchmark_listing(spark, sf):
    """Listings of JSON lines that name some files twice: the first listing's group counts."""
    P, S = F.col("p_partkey"), F.col("p_size")
    return formats.listed(table(spark, sf, "part").select(S.alias("place"), P.alias("nth"), F.col("p_brand").alias("group"), F.to_json(F.struct(F.col("p_name").alias("pdf"), S.alias("n"))).alias("json")))


@R.add("""SELECT track || '/' || s AS item, CASE WHEN track = 'table' THEN 'table' ELSE 'text' || coalesce('_' || arg_min(tag, p_partkey) FILTER (tag <> 'hard'), '') END AS "group" FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'text' END AS track, 'f' || p_size AS s, CASE WHEN p_partkey % 3 = 0 THEN 'hard' ELSE p_type END AS tag FROM part) GROUP BY track, s""")
def tagged_listing(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    tags = F.array(F.lit("hard"), F.when(P % 3 == 0, "hard").otherwise(F.col("p_type")))
    rows = table(spark, sf, "part").select(F.when(S % 2 == 0, "table").otherwise("text").alias("track"), P.alias("nth"), F.to_json(F.struct(F.concat(F.lit("docs/f"), text(S), F.lit(".pdf")).alias("pdf"), tags.alias("tags"))).alias("json"))
    return formats.tagged(rows, ["easy", "hard"])


@R.add("""SELECT p_partkey AS path, CASE WHEN p_size % 10 = 0 THEN 'missing' WHEN p_size % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM part""")
def fetched_files(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf, "part")
    files = p.where(S % 10 != 0).select(P.alias("path"), F.col("p_name").cast("binary").alias("content"))
    manifest = p.select(P.alias("path"), F.upper(F.sha2(F.when(S % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256)).alias("sha256"))
    return formats.fetched(files, manifest)


@R.add("""SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN 'not a document' WHEN 1 THEN 'pages out of order' WHEN 2 THEN 'word ids out of order' WHEN 3 THEN 'word on no page' WHEN 4 THEN 'word in two blocks' WHEN 5 THEN 'word in no block' WHEN 6 THEN 'block ids out of order' END AS problem FROM part""")
def stored_documents(spark, sf):
    """Documents stored as JSON, compact or pretty, seven of eight with one fault each."""
    P, S = F.col("p_partkey"), F.col("p_size")
    fault = S % 8
    pages = F.array(F.struct(F.when(fault == 1, 2).otherwise(1).alias("number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height")))
    words = F.array(*(F.struct(F.when((fault == 2) & F.lit(i == 2), 7).otherwise(i).alias("id"), F.when((fault == 3) & F.lit(i == 1), 2).otherwise(1).alias("page"), F.lit(f"w{i}").alias("text")) for i in range(3)))
    second = F.when(fault == 4, F.array(F.lit(1), F.lit(2))).when(fault == 5, F.array().cast("array<int>")).otherwise(F.array(F.lit(2)))
    blocks = F.array(*(F.struct(F.when((fault == 6) & F.lit(i == 2), "b9").otherwise(f"b{i}").alias("id"), F.lit("paragraph").alias("kind"), F.lit("").alias("text"), w.alias("words")) for i, w in ((1, F.array(F.lit(0), F.lit(1))), (2, second))))
    d = F.struct(F.lit("1").alias("schema"), pages.alias("pages"), words.alias("words"), blocks.alias("blocks"))
    stored = F.when(fault == 0, "{not json").when(P % 2 == 0, formats.document_json(d)).otherwise(formats.document_json(d, pretty=True))
    return formats.documents_from_json(table(spark, sf, "part").select(P.alias("id"), stored.alias("json"))).select("id", "problem")


@R.add("""SELECT o_orderkey AS doc, a + 3 AS correct, a + 5 + f AS detected, 30::BIGINT AS gt, CASE WHEN o_orderkey % 11 = 0 THEN 'a table is missing' WHEN o_orderkey % 13 = 0 THEN 'another size than the truth''s' WHEN o_orderkey % 17 = 0 THEN 'false positives declared and listed differ' END AS problem
    FROM (SELECT o_orderkey, o_custkey % 9 AS a, CASE WHEN o_custkey % 2 = 0 THEN 6 ELSE 0 END AS f FROM orders) WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0
    UNION ALL SELECT o_orderkey, a + 3, a + 5 + f, CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 26 ELSE 25 END ELSE 31 END, CASE WHEN o_orderkey % 13 = 0 THEN 'another size than the truth''s' ELSE 'a table is missing' END FROM (SELECT o_orderkey, o_custkey % 9 AS a, CASE WHEN o_custkey % 2 = 0 THEN 6 ELSE 0 END AS f FROM orders) WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def structure_logs(spark, sf):
    """A structure scorer's logs, some of them with faults."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    truth = F.lit("Table 1:  GT size: 10 corrDet: 10 detected: 10 \nTable 2: GT size: 15 corrDet: 15 detected: 15 \nTable 3: GT size: 5 corrDet: 5 detected: 5 \n")
    first = F.concat(F.lit("warnTable 1: GT size: "), F.when(o % 13 == 0, "11").otherwise("10"), F.lit(" corrDet: "), text(c % 9), F.lit(" detected: "), text(c % 9 + 1), F.lit(" \n"))
    rest = F.concat(F.lit("Table 2: GT size: 15 corrDet: 3 detected: 4 \n"), F.when(o % 11 == 0, "").otherwise("Table 3: no matching result found\n"))
    false = F.when(c % 2 == 0, F.concat(F.when(o % 17 == 0, "1").otherwise("2"), F.lit(" FALSE POSITIVE TABLES FOUND\nFP table with 2 adjacency relations\nFP table with 4 adjacency relations\n"))).otherwise(F.when(o % 17 == 0, "3 FALSE POSITIVE TABLES FOUND\n").otherwise(""))
    return formats.structure_counts(table(spark, sf, "orders").select(o.alias("doc"), F.concat(first, rest, false).alias("log"), truth.alias("sizes")))


@R.add("""SELECT o_orderkey AS doc, a AS correct, a + 2 + CASE WHEN c THEN 7 ELSE 0 END AS detected, 50::BIGINT AS gt, CASE WHEN o_orderkey % 11 = 0 THEN 'regions declared and reported differ' WHEN c AND o_orderkey % 13 = 0 THEN 'false items declared and summed differ' END AS problem FROM (SELECT o_orderkey, o_custkey % 30 AS a, o_custkey % 2 = 0 AS c FROM orders)""")
def region_logs(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    a = c % 30
    regions = F.concat(F.lit("GT Regions: "), F.when(o % 11 == 0, "3").otherwise("2"), F.lit("\nRegion: 1 GT Items: 20 correct items: "), text(a), F.lit(" result items: "), text(a + 2), F.lit("\nRegion: 2  GT Items: 30\n"))
    false = F.when(c % 2 == 0, F.concat(F.lit("FP regions: 2\nFP Region: 1  items: 3 FP Region: 2  items: 4 FP items: "), F.when(o % 13 == 0, "8").otherwise("7"), F.lit("\n"))).otherwise("FP regions: 0\n")
    return formats.region_counts(table(spark, sf, "orders").select(o.alias("doc"), F.concat(regions, false).alias("log")))


@R.add("""SELECT p_partkey AS id, CASE WHEN p_size % 6 <> 0 AND p_size % 5 <> 0 THEN round(100 * p_size / 50.0, 1)::DOUBLE END AS score FROM part""")
def printed_scores(spark, sf):
    """A command line's average, which fails for every sixth size and is off for every fifth."""
    P, S = F.col("p_partkey"), F.col("p_size")
    shown = F.format_string("%.1f", 100 * S / 50.0 + F.when(S % 5 == 0, 1.0).otherwise(0.0))
    log = F.concat(F.lit("tool-b  : Average Score: 3.0%\ntool.a  : Average Score: "), F.when(S % 6 == 0, F.lit("FAILED (errors)")).otherwise(F.concat(shown, F.lit("%"))))
    return table(spark, sf, "part").select(P.alias("id"), formats.printed_score(log, "tool.a", S, F.lit(50)).alias("score"))


# --- names, units, terms ---
_TERMS = [('“Fee” means', 1), ('"Base Fee": the fee', 2), ("‘Fee’ or “Charge” (net) is", 4), ('"Fee" (the "Charge") means', 3), ("plain Fee means", 0), ('"Fee"', 0), ('"never closed by a mark', 0), ('"Fee" and plain words', 1)]


@R.add("SELECT p_partkey AS id, [" + ", ".join(str(n) for _, n in _TERMS) + "][p_size % 8 + 1]::INT AS term FROM part")
def quoted_terms(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    words = F.split(F.concat_ws(" ", F.element_at(F.array(*(F.lit(t) for t, _ in _TERMS)), (S % 8 + 1).cast("int")), F.when(S % 8 != 5, F.col("p_name"))), " ")
    return table(spark, sf, "part").select(P.alias("id"), tk.quoted_term(words).alias("term"))


@R.add("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN [97, 128512, 98] WHEN 1 THEN [97, 55357, 98] WHEN 2 THEN [56832, 128512] ELSE [128512, 56832, 97] END::BIGINT[]::VARCHAR AS points, CASE p_size % 4 WHEN 0 THEN 'a' || chr(128512) || 'b' WHEN 1 THEN 'a' || chr(65533) || 'b' WHEN 2 THEN chr(65533) || chr(128512) ELSE chr(128512) || chr(65533) || 'a' END AS text FROM part""")
def surrogate_pairs(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    units = F.element_at(F.array(*(F.array(*(F.lit(u).cast("long") for u in held)) for held in ([97, 0xD83D, 0xDE00, 98], [97, 0xD83D, 98], [0xDE00, 0xD83D, 0xDE00], [0xD83D, 0xDE00, 0xDE00, 97]))), (S % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(P.alias("id"), F.concat(F.lit("["), F.array_join(tk.join_surrogates(units), ", "), F.lit("]")).alias("points"), tk.scorable(units).alias("text"))


@R.add("""SELECT p_partkey AS id, CASE WHEN p_size % 5 < 3 THEN CASE WHEN p_size % 2 = 0 AND p_size % 5 = 1 THEN chr(9985) ELSE chr(65533) END END AS reads FROM part""")
def glyph_names(spark, sf):
    """Names of digits: in a dingbats font the table's character, else U+FFFD; other names and listed ones are left."""
    P, S = F.col("p_partkey"), F.col("p_size")
    name = F.element_at(F.array(*map(F.lit, ("50.alt", "a1", "a999", "space", "a12"))), (S % 5 + 1).cast("int"))
    font = F.when(S % 2 == 0, "ZapfDingbats").otherwise("Helvetica")
    known = spark.createDataFrame([("a1", 9985), ("a2", 9986)], "stem string, code int")
    g = table(spark, sf, "part").select(P.alias("id"), name.alias("name"), font.alias("font"), (S % 5 == 4).alias("listed"), tk.glyph_stem(name).alias("stem"))
    return g.join(F.broadcast(known), "stem", "left").select("id", tk.glyph_reading(F.col("name"), F.col("font"), F.col("listed"), F.col("code")).alias("reads"))


@R.add("""SELECT p_partkey AS id, 'A' || p_size || ',b.alt' AS names, 'x' || p_partkey || ',y' AS "charset" FROM part""")
def listed_names(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    encoding = F.concat(F.lit("<</Type/Encoding /Differences [1 /A"), text(S), F.lit(" 7/b.alt /A"), text(S), F.lit("] /Other /c>>"))
    charset = F.concat(F.lit("/x"), text(P), F.lit("/y/y"))
    return table(spark, sf, "part").select(P.alias("id"), F.array_join(tk.differences_names(encoding), ",").alias("names"), F.array_join(tk.slashed_names(charset), ",").alias("charset"))


@R.add(r"""SELECT doc_id, regexp_replace(chr(1) || text || chr(11) || chr(65535), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g') AS text, sha256(text) AS digest FROM documents""")
def xml_texts(spark, sf):
    t = F.concat(F.lit("\x01"), "text", F.lit("\x0b￿"))
    return table(spark, sf, "documents").select("doc_id", tk.xml_chars(t).alias("text"), F.sha2("text", 256).alias("digest"))


@R.add("""SELECT p_partkey AS id, lower(replace(p_name, ' ', '')) || 'fi1' || p_size || 'ss' AS folded, replace(p_name, ' ', '') || 'fi1' || p_size || 'ß' AS glyphs FROM part""")
def compared_texts(spark, sf):
    """Ligatures, wide digits and white space of every kind."""
    P, S = F.col("p_partkey"), F.col("p_size")
    t = F.concat("p_name", F.lit(" ﬁ １\t"), text(S), F.lit("ß　"))
    return table(spark, sf, "part").select(P.alias("id"), tk.compared(True)(t).alias("folded"), tk.compared(False)(t).alias("glyphs"))


@R.add("""SELECT user_id AS doc_id, string_agg(event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' on page ' || (event_id % 9) END, ', ' ORDER BY event_id) AS summary FROM events GROUP BY 1""")
def finding_summaries(spark, sf):
    e = F.col("event_id")
    return reader.summaries(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), e.alias("nth"), F.col("event_type").alias("code"), F.when(e % 3 != 0, e % 9).alias("page")))


_CODES = ["lost", "doubled", "value", "order"]


@R.add(f"""WITH d AS (SELECT user_id, event_id % 4 AS k, count(*) AS n FROM events GROUP BY ALL) SELECT user_id AS doc_id, sum(n)::BIGINT || CASE WHEN sum(n) = 1 THEN ' defect: ' ELSE ' defects: ' END || string_agg({_CODES!r}[k + 1] || ' ' || n, ', ' ORDER BY k) AS summary FROM d GROUP BY 1""")
def defect_summaries(spark, sf):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 4 + 1).cast("int"))
    return reader.defect_summaries(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), code.alias("code")), _CODES)


@R.add("""SELECT '/in/' || p_partkey || '.pdf' AS path, p_partkey || '.pdf' AS name, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE length(p_name) + CASE p_size % 4 WHEN 3 THEN 5 ELSE 0 END END::BIGINT AS bytes, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN sha256('') WHEN 2 THEN sha256(p_name) ELSE sha256('%PDF-' || p_name) END AS sha256, CASE p_size % 4 WHEN 0 THEN 'no bytes' WHEN 1 THEN 'empty' WHEN 2 THEN 'not a PDF' END AS problem FROM part""")
def file_sources(spark, sf):
    """Files' bytes: none, empty, of another kind, and a document's."""
    from leafloom.sources import files

    P, S = F.col("p_partkey"), F.col("p_size")
    held = F.when(S % 4 == 1, "").when(S % 4 == 2, F.col("p_name")).when(S % 4 == 3, F.concat(F.lit("%PDF-"), "p_name"))
    return files.sources(table(spark, sf, "part").select(F.concat(F.lit("/in/"), text(P), F.lit(".pdf")).alias("path"), held.cast("binary").alias("content")))
