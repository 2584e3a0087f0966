"""Queries over what a reader takes from a page (boxes, frames, spans, copies, counts), with their SQL. Their tables come from the sales by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions import geometry as geo
from leafloom.operators import reader
from leafloom.plans.registry import Registry, table

R = Registry()


def part(spark, sf):
    return table(spark, sf, "part")


@R.add("""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, a0 <= v AND v < a1 AS holds, least(a1, b1) > greatest(a0, b0) AS overlaps,
    CASE WHEN x1 = 10 THEN v = 10 ELSE 10 <= v AND v < x1 END AND CASE WHEN y1 = 5 THEN n = 5 ELSE 5 <= n AND n < y1 END AS flat, (abs(dx - 1) <= 0.001 AND abs(dy) <= 0.001) AS level
    FROM (SELECT *, l_partkey % 50 AS a0, l_partkey % 50 + l_quantity AS a1, l_suppkey % 60 AS b0, l_suppkey % 60 + 5 AS b1, l_suppkey % 80 AS v, 10 + l_partkey % 3 AS x1, 5 + l_suppkey % 2 AS y1, l_linenumber AS n, 1 - (l_partkey % 3)::DOUBLE / 1000 AS dx, (l_suppkey % 4)::DOUBLE / 2000 AS dy FROM lineitem)""")
def intervals(spark, sf):
    """Half-open intervals, boxes without extent, and directions."""
    K = F.col("l_partkey")
    d = table(spark, sf, "lineitem")
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    a0, a1, b0, b1, v = K % 50, K % 50 + F.col("l_quantity"), s % 60, s % 60 + 5, s % 80
    flat = geo.contains_point_closed_if_flat((F.lit(10), F.lit(5), 10 + K % 3, 5 + s % 2), v, n)
    return d.select(F.col("l_orderkey").alias("k"), n.alias("n"), K.alias("p"), ((a0 <= v) & (v < a1)).alias("holds"), geo.intervals_overlap(a0, a1, b0, b1).alias("overlaps"), flat.alias("flat"), geo.horizontal(1 - (K % 3).cast("double") / 1000, (s % 4).cast("double") / 2000).alias("level"))


@R.add("""SELECT p_partkey AS id, e - s AS long, CASE WHEN axis = 'h' THEN s ELSE "at" - t / 2 END AS x0, CASE WHEN axis = 'h' THEN "at" - t / 2 ELSE s END AS y0, CASE WHEN axis = 'h' THEN e ELSE "at" + t / 2 END AS x1, CASE WHEN axis = 'h' THEN "at" + t / 2 ELSE e END AS y1
    FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'h' ELSE 'v' END AS axis, (p_partkey % 500)::DOUBLE AS "at", (p_size)::DOUBLE AS s, (p_size * 3)::DOUBLE AS e, (p_size % 4)::DOUBLE / 2 AS t FROM part)""")
def rule_boxes(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    at, s, e, t = ((P % 500).cast("double"), S.cast("double"), (S * 3).cast("double"), (S % 4).cast("double") / 2)
    box = geo.rule_rect(F.when(S % 2 == 0, "h").otherwise("v"), at, s, e, t)
    return part(spark, sf).select(P.alias("id"), geo.rule_length(s, e).alias("long"), *(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


@R.add("""WITH f AS (SELECT p_partkey AS id, (p_size % 4 * 90)::INT AS r, (p_partkey % 600)::DOUBLE AS x, (p_partkey % 700)::DOUBLE AS y, CASE WHEN p_size % 4 = 0 THEN 10.0 ELSE 0.0 END::DOUBLE AS l, 792.0::DOUBLE AS t FROM part),
    s AS (SELECT *, CASE r WHEN 90 THEN 792 - y WHEN 180 THEN 612 - x WHEN 270 THEN y ELSE x END AS sx, CASE r WHEN 90 THEN x WHEN 180 THEN 792 - y WHEN 270 THEN 612 - x ELSE y END AS sy FROM f)
    SELECT id, r AS rotation, sx, sy, CASE WHEN r = 0 THEN x + l ELSE sx END AS ix, CASE WHEN r = 0 THEN t - y WHEN r = 180 THEN 792 - sy ELSE 612 - sy END AS iy, true AS back FROM s""")
def page_frames(spark, sf):
    """A page of 612 by 792: the frame that displays, that of a table competition, and back."""
    P, S = F.col("p_partkey"), F.col("p_size")
    r, x, y = (S % 4 * 90).cast("int"), (P % 600).cast("double"), (P % 700).cast("double")
    left, top, w, h = F.when(S % 4 == 0, 10.0).otherwise(0.0), F.lit(792.0), F.lit(612.0), F.lit(792.0)
    sx, sy = geo.turn_point(r, x, y, w, h)
    ix, iy = geo.to_icdar(r, x, y, left, top, w, h)
    bx, by = geo.from_icdar(r, ix, iy, left, top, w, h)
    return part(spark, sf).select(P.alias("id"), r.alias("rotation"), sx.alias("sx"), sy.alias("sy"), ix.alias("ix"), iy.alias("iy"), ((bx == x) & (by == y)).alias("back"))


@R.add("""WITH b AS (SELECT p_partkey AS id, (p_size - 10)::DOUBLE AS c0, (p_partkey % 30 - 5)::DOUBLE AS c1, (p_size + p_partkey % 80)::DOUBLE AS c2, (p_partkey % 30 + p_size * 2)::DOUBLE AS c3, (p_partkey * 37 % 1000)::INT AS r FROM part),
    m AS (SELECT id, r, greatest(c0, 0) AS x0, greatest(100 - c3, 0) AS y0, least(c2, 60) AS x1, least(100 - c1, 100) AS y1 FROM b)
    SELECT id, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS y0, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END AS y1, (round_even((r % 360) / 90, 0)::INT % 4) * 90 AS rotation FROM m""")
def page_boxes(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    crop = tuple(c.cast("double") for c in (S - 10, P % 30 - 5, S + P % 80, P % 30 + S * 2))
    box = geo.page_box(crop, tuple(map(F.lit, (0.0, 0.0, 60.0, 100.0))))
    return part(spark, sf).select(P.alias("id"), *(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)), geo.quarter(P * 37 % 1000).alias("rotation"))


@R.add("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, (l_partkey % 130 - 20)::DOUBLE AS x0, (l_suppkey % 110 - 20)::DOUBLE AS y0, (l_partkey % 130 - 20 + l_quantity)::DOUBLE AS x1, (l_suppkey % 110 - 20 + l_quantity)::DOUBLE AS y1 FROM lineitem WHERE l_linenumber < 6),
    p AS (SELECT o_orderkey AS doc_id, unnest([0, 1, 2]) AS page FROM orders), c AS (SELECT *, least(x1, 100) - greatest(x0, 0) AS w, least(y1, 80) - greatest(y0, 0) AS h FROM p LEFT JOIN i USING (doc_id, page))
    SELECT doc_id, page, round(least(1.0, coalesce(sum(CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END), 0) / 8000), 9) AS ratio FROM c GROUP BY 1, 2""")
def image_ratios(spark, sf):
    K = F.col("l_partkey")
    d = table(spark, sf, "lineitem").where("l_linenumber < 6")
    x, y, q = K % 130 - 20, F.col("l_suppkey") % 110 - 20, F.col("l_quantity")
    images = d.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + q).cast("double").alias("x1"), (y + q).cast("double").alias("y1"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("page"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"))
    return reader.image_ratio(images, pages).select("doc_id", "page", F.round("ratio", 9).alias("ratio"))


_TURNED = """w AS (SELECT p_size AS doc_id, p_partkey % 3 AS page, p_partkey AS id, p_name AS text, (p_partkey + p_size) % (2 + p_size % 3) <> 0 AS horizontal, p_partkey % 7 = 0 AND (p_partkey + p_size) % (2 + p_size % 3) = 0 AS diagonal, (p_partkey % 500)::DOUBLE AS x0, (p_partkey % 700)::DOUBLE AS y0, (p_partkey % 500 + 40)::DOUBLE AS x1, (p_partkey % 700 + 10)::DOUBLE AS y1, p_size % 4 * 90 AS r FROM part),
    t AS (SELECT *, r <> 0 AND 2 * sum(CASE WHEN horizontal THEN 0 ELSE length(text) END) OVER p > sum(length(text)) OVER p AS turned FROM w WINDOW p AS (PARTITION BY doc_id, page))"""


@R.add(f"""WITH {_TURNED} SELECT doc_id, page, id, CASE WHEN turned THEN NOT horizontal AND NOT diagonal ELSE horizontal END AS horizontal, turned,
    CASE WHEN NOT turned THEN x0 WHEN r = 90 THEN 792 - y1 WHEN r = 180 THEN 612 - x1 ELSE y0 END AS x0, CASE WHEN NOT turned THEN y0 WHEN r = 90 THEN x0 WHEN r = 180 THEN 792 - y1 ELSE 612 - x1 END AS y0,
    CASE WHEN NOT turned THEN x1 WHEN r = 90 THEN 792 - y0 WHEN r = 180 THEN 612 - x0 ELSE y1 END AS x1, CASE WHEN NOT turned THEN y1 WHEN r = 90 THEN x1 WHEN r = 180 THEN 792 - y0 ELSE 612 - x0 END AS y1 FROM t""")
def upright_pages(spark, sf):
    """Turned pages, most of whose text is upright as they display."""
    P, S = F.col("p_partkey"), F.col("p_size")
    level = (P + S) % (2 + S % 3) != 0
    words = part(spark, sf).select(S.alias("doc_id"), (P % 3).alias("page"), P.alias("id"), F.col("p_name").alias("text"), level.alias("horizontal"), ((P % 7 == 0) & ~level).alias("diagonal"), (P % 500).cast("double").alias("x0"), (P % 700).cast("double").alias("y0"), (P % 500 + 40).cast("double").alias("x1"), (P % 700 + 10).cast("double").alias("y1"))
    pages = words.select("doc_id", "page").distinct().select("doc_id", "page", (F.col("doc_id") % 4 * 90).alias("rotation"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return reader.upright(words, pages).drop("text")


@R.add("""SELECT p_partkey AS span, false AS clipped FROM part UNION ALL SELECT p_partkey + 100000000, true FROM part WHERE p_size % 4 = 1 AND p_partkey % 2 = 1 UNION ALL SELECT p_partkey + 200000000, true FROM part WHERE p_size % 5 = 1""")
def clip_copies(spark, sf):
    """Spans, clipped unseen copies of every fourth size's (moved off for odd keys), and clipped copies that are seen."""
    P, S = F.col("p_partkey"), F.col("p_size")
    def spans(add: int, clipped: bool, alpha: int, move):
        chars = F.transform(F.split("p_name", ""), lambda c, i: F.struct(c.alias("c"), (P % 100 + i * 5 + move).cast("double").alias("x0"), F.lit(1.0).alias("y0"), (P % 100 + i * 5 + 5 + move).cast("double").alias("x1"), F.lit(9.0).alias("y1")))
        return part(spark, sf).select((P % 9).alias("doc_id"), S.alias("page"), (P + add).alias("span"), F.lit(clipped).alias("clipped"), F.lit(alpha).alias("alpha"), chars.alias("chars"), S.alias("size"))

    every = spans(0, False, 255, F.lit(0)).union(spans(100_000_000, True, 0, P % 2 * 1000).where("size % 4 = 1")).union(spans(200_000_000, True, 255, F.lit(0)).where("size % 5 = 1"))
    return reader.drawn_spans(every).select("span", "clipped")


@R.add("""SELECT p_partkey * 10 + i AS id, CASE WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN true ELSE i IN (0, 3) END AS kept FROM part, range(5) t(i)""")
def words_read_once(spark, sf):
    """Each word five times, moved by 0, 0.5, 1, 1.5 and 2 points at 10 points of size: the second and third are copies of the first, the last of the fourth. Type 3 and unmapped words stay."""
    P, S = F.col("p_partkey"), F.col("p_size")
    i = F.explode(F.array(*map(F.lit, range(5))))
    w = part(spark, sf).select(P.alias("doc_id"), F.lit(1).alias("page"), i.alias("i"), F.when(S % 11 == 0, F.concat("p_name", F.lit("�"))).otherwise(F.col("p_name")).alias("text"), (S % 7 == 0).alias("type3"))
    x = F.col("i") * 0.5
    words = w.select("doc_id", "page", (F.col("doc_id") * 10 + F.col("i")).alias("id"), "text", F.lit("f").alias("font"), F.lit(10.0).alias("size"), F.lit(0).alias("state"), "type3", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 30).alias("x1"), F.lit(10.0).alias("y1"))
    return reader.read_once(words).select("id", "kept")


@R.add("""WITH c AS (SELECT user_id AS doc_id, event_id % 5 AS page, CASE event_id % 7 WHEN 0 THEN 'invisible' WHEN 1 THEN 'no_unicode' WHEN 2 THEN 'space' ELSE 'word' END AS class, event_id % 11 = 0 AS hidden, event_id % 3 <> 0 AS unclipped FROM events)
    SELECT doc_id, page, count(*) FILTER (NOT unclipped AND class = 'invisible') AS invisible, count(*) FILTER (NOT unclipped AND class = 'no_unicode') AS unmapped, count(*) FILTER (NOT unclipped AND class = 'word' AND hidden) AS hidden,
    greatest(0, count(*) FILTER (unclipped AND class = 'word') - count(*) FILTER (NOT unclipped AND class = 'word')) AS clipped FROM c GROUP BY 1, 2""")
def page_char_counts(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 7 == 0, "invisible").when(e % 7 == 1, "no_unicode").when(e % 7 == 2, "space").otherwise("word")
    return reader.page_counts(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (e % 5).alias("page"), kind.alias("class"), (e % 11 == 0).alias("hidden"), (e % 3 != 0).alias("unclipped")))


@R.add("""SELECT p_partkey AS span, p_size % 5 = 0 OR font LIKE '%bold%' AS bold, p_size % 6 = 0 OR font LIKE '%italic%' OR font LIKE '%oblique%' AS italic FROM (SELECT *, lower('ABC+' || p_brand || ['-Bold', '-Italic', 'Oblique', '-BOLDItalic', ''][p_partkey % 5 + 1]) AS font FROM part)""")
def span_styles(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    font = F.concat(F.lit("ABC+"), "p_brand", F.element_at(F.array(*map(F.lit, ("-Bold", "-Italic", "Oblique", "-BOLDItalic", ""))), (P % 5 + 1).cast("int")))
    bold, italic = reader.styles(font, S % 5 == 0, S % 6 == 0)
    return part(spark, sf).select(P.alias("span"), bold.alias("bold"), italic.alias("italic"))


@R.add("""SELECT p_partkey AS id, least(0, (p_size % 4)::DOUBLE / 4) AS x0, 0.0::DOUBLE AS y0, 50.0::DOUBLE AS x1, 9.0::DOUBLE AS y1 FROM part WHERE p_size % 4 < 3""")
def quad_rectangles(spark, sf):
    """Four corners, one of them up to three quarters of a point off."""
    P, S = F.col("p_partkey"), F.col("p_size")
    off = (S % 4).cast("double") / 4
    points = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.lit(0.0)), (F.lit(50.0), F.lit(0.0)), (off, F.lit(9.0)), (F.lit(50.0), F.lit(9.0)))))
    return reader.quad_boxes(part(spark, sf).select(P.alias("id"), points.alias("points"))).drop("points")


@R.add("""SELECT o_orderkey AS doc_id, d - l || ' of ' || d || ' pages are missing: ' || (l + 1) || '-' || d AS detail FROM (SELECT o_orderkey, o_custkey % 30 AS d, o_custkey % 17 AS l FROM orders) WHERE d > l""")
def unreadable_pages(spark, sf):
    c = F.col("o_custkey")
    return reader.unreadable(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (c % 30).alias("declared"), (c % 17).alias("loaded")))


@R.add(r"""SELECT doc_id, page FROM (SELECT doc_id, 1 AS page, text FROM documents UNION ALL SELECT doc_id, 2, repeat('12.5 and 1,400 ', (doc_id % 13)::INT) FROM documents) WHERE len(regexp_extract_all(text, '\p{Nd}[\p{Nd},.]*')) >= 20""")
def numeric_pages(spark, sf):
    d = table(spark, sf, "documents")
    pages = d.select("doc_id", F.lit(1).alias("page"), "text").union(d.select("doc_id", F.lit(2), F.repeat(F.lit("12.5 and 1,400 "), (F.col("doc_id") % 13).cast("int"))))
    return reader.numeric_pages(pages)


_CENSUS = """p AS (SELECT o_custkey AS doc_id, o_orderkey AS page, CASE WHEN o_orderkey % 41 = 0 THEN 'image_backed' WHEN o_orderkey % 37 = 0 THEN 'no_text' ELSE 'born_digital' END AS class FROM orders),
    d AS (SELECT doc_id, coalesce(arg_min(class, page) FILTER (class <> 'born_digital'), 'born_digital') AS class FROM p GROUP BY 1)"""


def _census(spark, sf):
    o = F.col("o_orderkey")
    return reader.document_classes(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), o.alias("page"), F.when(o % 41 == 0, "image_backed").when(o % 37 == 0, "no_text").otherwise("born_digital").alias("class")))


@R.add(f"WITH {_CENSUS} SELECT * FROM d")
def document_classes(spark, sf):
    return _census(spark, sf)


@R.add(f"""WITH {_CENSUS} SELECT c_custkey AS doc_id, c_mktsegment AS "group", CASE WHEN class IS NULL THEN 'unclassified' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'unnamed group' WHEN class <> 'born_digital' THEN class WHEN c_mktsegment = 'FURNITURE' THEN 'group' END AS why FROM customer LEFT JOIN d ON doc_id = c_custkey""")
def scored_documents(spark, sf):
    return reader.scored(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("group")), _census(spark, sf), ["BUILDING", "MACHINERY"], ["FURNITURE"])


@R.add("""WITH f AS (SELECT p_partkey AS doc_id, 1 AS page, p_size % 9 = 0 AS failed, p_size % 8 AS type3 FROM part) SELECT doc_id, page, 'unreadable_page' AS code, 'error' AS severity FROM f WHERE failed UNION ALL SELECT doc_id, page, 'type3_font', 'warning' FROM f WHERE type3 > 0""")
def font_findings(spark, sf):
    P, S = F.col("p_partkey"), F.col("p_size")
    one, none = F.lit(1), F.lit(0)
    facts = part(spark, sf).select(P.alias("doc_id"), one.alias("page"), one.alias("words"), none.alias("unmapped"), none.alias("hidden_chars"), one.alias("visible_chars"), none.alias("clipped"), none.alias("overprinted"), F.lit(0.0).alias("image_ratio"), (S % 9 == 0).alias("failed"), (S % 8).alias("type3"))
    return reader.page_findings(facts)
