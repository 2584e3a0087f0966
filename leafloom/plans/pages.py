"""Queries over geometry, the reader, links, the verifier and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom.functions import geometry as geo
from leafloom.operators import links, reader, scoring, verify
from leafloom.plans import prose
from leafloom.plans.registry import Registry, table
from leafloom.sources import typeset as ts

R = Registry()

# --- geometry: boxes from the sales ---
_BOX = """b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey * 7 % 700)::DOUBLE AS y0, (l_partkey % 500 + l_quantity)::DOUBLE AS x1, (l_suppkey * 7 % 700 + 10)::DOUBLE AS y1, (l_linenumber % 4 * 90)::INT AS rotation FROM lineitem)"""


def boxes(spark, sf):
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") * 7 % 700
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + 10).cast("double").alias("y1"), (F.col("l_linenumber") % 4 * 90).cast("int").alias("rotation"))


@R.add(f"""WITH {_BOX} SELECT k, n, p, round((x1 - x0) * (y1 - y0), 2) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0 <= 250 AND 250 < x1 AND y0 <= 350 AND 350 < y1 AS holds, x0 >= 100 AND y0 >= 100 AND x1 <= 400 AND y1 <= 600 AS inside, least(x1, 400) > greatest(x0, 100) AND least(y1, 600) > greatest(y0, 100) AS meets FROM b""")
def rect_predicates(spark, sf):
    b, page = geo.box(), tuple(F.lit(float(v)) for v in (100, 100, 400, 600))
    cx, cy = geo.center(b)
    return boxes(spark, sf).select("k", "n", "p", F.round(geo.area(b), 2).alias("area"), cx.alias("cx"), cy.alias("cy"), geo.contains_point(b, F.lit(250.0), F.lit(350.0)).alias("holds"), geo.contains_rect(page, b).alias("inside"), geo.intersects(b, page).alias("meets"))


@R.add(f"WITH {_BOX} SELECT k, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY 1")
def union_bbox(spark, sf):
    return boxes(spark, sf).groupBy("k").agg(*(c.alias(n) for c, n in zip(geo.union_all(geo.box()), ("x0", "y0", "x1", "y1"), strict=True)))


@R.add(f"""WITH {_BOX} SELECT k, n, p, rotation, CASE rotation WHEN 90 THEN 792 - y1 WHEN 180 THEN 612 - x1 WHEN 270 THEN y0 ELSE x0 END AS tx0, CASE rotation WHEN 90 THEN x0 WHEN 180 THEN 792 - y1 WHEN 270 THEN 612 - x1 ELSE y0 END AS ty0,
    CASE rotation WHEN 90 THEN 792 - y0 WHEN 180 THEN 612 - x0 WHEN 270 THEN y1 ELSE x1 END AS tx1, CASE rotation WHEN 90 THEN x1 WHEN 180 THEN 792 - y0 WHEN 270 THEN 612 - x0 ELSE y1 END AS ty1, true AS back FROM b""")
def turn_rects(spark, sf):
    w, h = F.lit(612.0), F.lit(792.0)
    t = geo.turn_rect(F.col("rotation"), geo.box(), w, h)
    out = boxes(spark, sf).select("*", *(c.alias(f"t{n}") for c, n in zip(t, ("x0", "y0", "x1", "y1"), strict=True)))
    u = geo.unturn_rect(F.col("rotation"), geo.box("t"), w, h)
    return out.select("k", "n", "p", "rotation", "tx0", "ty0", "tx1", "ty1", ((u[0] == F.col("x0")) & (u[1] == F.col("y0")) & (u[2] == F.col("x1")) & (u[3] == F.col("y1"))).alias("back"))


@R.add("""SELECT event_id, CASE WHEN isfinite(value) THEN round(value, 2) + 0.0 END AS q, value >= 20 AND value < 40 AS held, CASE WHEN degrees(atan2(abs(value - 30), abs(event_id % 50))) BETWEEN 15 AND 75 THEN true ELSE false END AS diagonal FROM events""")
def quantized_values(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", geo.quantize(v).alias("q"), ((v >= 20) & (v < 40)).alias("held"), geo.diagonal((F.col("event_id") % 50).cast("double"), v - 30).alias("diagonal"))


_EDGES = [((5, 18), (20, 33)), ((20, 3), (5, 18)), ((35, 18), (20, 3)), ((20, 33), (35, 18))]
_CROSSED = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay})::DOUBLE + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in _EDGES)


@R.add(f"""SELECT event_id, ({_CROSSED}) % 2 = 1 AS inside FROM (SELECT event_id, value % 40 AS x, event_id % 37 AS y FROM events)""")
def points_in_polygon(spark, sf):
    """A diamond about (20, 18); points of its border by the even-odd rule."""
    x, y = F.col("value") % 40, (F.col("event_id") % 37).cast("double")
    diamond = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((5.0, 18.0), (20.0, 3.0), (35.0, 18.0), (20.0, 33.0))))
    return table(spark, sf, "events").select("event_id", geo.in_polygon(diamond, x, y).alias("inside"))


# --- reader: characters of the typeset words ---
def glyphs(spark, sf):
    """Each word's characters, and a blank after it; the span changes in the middle of words of six characters or more."""
    w = prose.words(spark, sf).select("doc_id", "page", "line", "id", F.split("text", "").alias("chars"), "x0", "y0", "y1", "size", "bold")
    c = w.select("doc_id", "page", "line", "id", "y0", "y1", "size", "bold", "x0", F.size("chars").alias("n"), F.posexplode(F.concat("chars", F.array(F.lit(" ")))).alias("i", "c"))
    x = F.col("x0") + F.col("size") / 2 * F.col("i")
    return c.select("doc_id", "page", "line", (F.col("id") * 2 + F.when((F.col("n") >= 6) & (F.col("i") >= 3), 1).otherwise(0)).alias("span"), (F.col("id") * 100_000 + F.col("i")).alias("char"), "c", x.alias("x0"), "y0", (x + F.col("size") / 2).alias("x1"), "y1", "size", "bold")


def glyph_lines(spark, sf):
    """``glyphs``, a line's in one row."""
    far = lambda w, i: w.x0 + F.col("size") / 2 * i
    split = lambda t: F.concat(F.split(t, ""), F.array(F.lit(" ")))

    def drawn(w):
        n = F.length(w.text)
        char = lambda c, i: F.struct(
            (w.id * 2 + F.when((n >= 6) & (i >= 3), 1).otherwise(0)).alias("span"), (w.id * 100_000 + i).alias("char"), c.alias("c"), far(w, i).alias("x0"), F.col("y0"),
            (far(w, i) + F.col("size") / 2).alias("x1"), F.col("y1"), F.col("size"), F.col("bold"),
        )
        return F.transform(split(w.text), char)

    return ts.prose_set(table(spark, sf, "documents")).select("doc_id", "page", "line", F.flatten(F.transform("words", drawn)).alias("chars"))


@R.add(f"WITH {ts.PROSE_WORDS_SQL} SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY id) AS nth, x0, y0, x1, y1, text, size, bold FROM words")
def words_from_glyphs(spark, sf):
    """The words put together again from their characters."""
    w = reader.line_words(glyph_lines(spark, sf)).repartition("doc_id")
    nth = F.row_number().over(Window.partitionBy("doc_id", "page", "line").orderBy("word"))
    return w.select("doc_id", "page", "line", nth.cast("long").alias("nth"), *(F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")), "text", "size", "bold")


_PATHS = """paths AS (SELECT p_partkey AS doc_id, 1 AS page, CASE WHEN p_size % 2 = 0 THEN 'line' ELSE 'rect' END AS kind, (p_partkey % 100)::DOUBLE AS x0, 50.0::DOUBLE AS y0, (p_partkey % 100 + p_size % 7)::DOUBLE AS x1, 50.0::DOUBLE + p_size % 3 * 4 AS y1, 0.5::DOUBLE AS width, p_size % 5 <> 0 AS stroked, p_size % 3 = 1 AS filled FROM part)"""


def paths(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(p.alias("doc_id"), F.lit(1).alias("page"), F.when(s % 2 == 0, "line").otherwise("rect").alias("kind"), (p % 100).cast("double").alias("x0"), F.lit(50.0).alias("y0"), (p % 100 + s % 7).cast("double").alias("x1"), (F.lit(50.0) + s % 3 * 4).alias("y1"), F.lit(0.5).alias("width"), (s % 5 != 0).alias("stroked"), (s % 3 == 1).alias("filled"))


@R.add(f"""WITH {_PATHS}, d AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM paths),
    r AS (SELECT doc_id, page, 'h' AS axis, (y0 + y1) / 2 AS at, x0 AS s, x1 AS e, CASE WHEN kind = 'line' THEN width ELSE dy END AS t FROM d WHERE (kind = 'line' AND stroked AND dy <= 0.5 AND dx >= 2) OR (kind = 'rect' AND dy <= 3.5 AND dx >= 2 AND dx >= dy)
    UNION ALL SELECT doc_id, page, 'v', (x0 + x1) / 2, y0, y1, CASE WHEN kind = 'line' THEN width ELSE dx END FROM d WHERE (kind = 'line' AND stroked AND NOT (dy <= 0.5 AND dx >= 2) AND dx <= 0.5 AND dy >= 2) OR (kind = 'rect' AND NOT (dy <= 3.5 AND dx >= 2 AND dx >= dy) AND dx <= 3.5 AND dy >= 2)
    UNION ALL SELECT doc_id, page, c.axis, c.pos, c.s, c.e, width FROM d, LATERAL (VALUES ('h', y0, x0, x1), ('h', y1, x0, x1), ('v', x0, y0, y1), ('v', x1, y0, y1)) c(axis, pos, s, e) WHERE kind = 'rect' AND stroked AND NOT (dy <= 3.5 AND dx >= 2 AND dx >= dy) AND NOT (dx <= 3.5 AND dy >= 2))
    SELECT doc_id, page, axis, "at", s AS start, e AS "end", max(t) AS thickness FROM r GROUP BY ALL""")
def rules_from_paths(spark, sf):
    return reader.extract_rules(paths(spark, sf))


@R.add(f"WITH {_PATHS} SELECT DISTINCT doc_id, page, x0, y0, x1, y1 FROM paths WHERE kind = 'rect' AND filled AND x1 - x0 > 3.5 AND y1 - y0 > 3.5")
def fills_from_paths(spark, sf):
    return reader.extract_fills(paths(spark, sf))


_FACTS = "f AS (SELECT p_partkey AS doc_id, 1 AS page, p_size % 5 AS words, p_size % 2 AS unmapped, p_size % 3 * 10 AS hidden, 15 AS visible, p_size % 7 AS clipped, p_size % 11 AS over, p_size / 50.0 AS img FROM part)"


@R.add(f"""WITH {_FACTS} SELECT doc_id, page, CASE WHEN img > 0 THEN 'no_text_layer' ELSE 'blank_page' END AS code, CASE WHEN img > 0 THEN 'error' ELSE 'info' END AS severity FROM f WHERE words = 0
    UNION ALL SELECT doc_id, page, 'partial_text_layer', 'warning' FROM f WHERE words > 0 AND unmapped > 0 UNION ALL SELECT doc_id, page, CASE WHEN hidden * 2 >= hidden + visible AND img >= 0.5 THEN 'ocr_text_layer' ELSE 'hidden_text' END, 'warning' FROM f WHERE hidden > 0
    UNION ALL SELECT doc_id, page, 'clipped_text', 'info' FROM f WHERE clipped > 0 UNION ALL SELECT doc_id, page, 'overprinted_text', 'info' FROM f WHERE over > 0""")
def page_findings(spark, sf):
    s = F.col("p_size")
    facts = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), (s % 5).alias("words"), (s % 2).alias("unmapped"), (s % 3 * 10).alias("hidden_chars"), F.lit(15).alias("visible_chars"), (s % 7).alias("clipped"), (s % 11).alias("overprinted"), (s / 50.0).alias("image_ratio"))
    return reader.page_findings(facts)


@R.add("""WITH w AS (SELECT user_id AS doc_id, event_type || event_id % 30 AS message, min(event_id) AS nth FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth, message) AS n FROM w)
    SELECT doc_id, message AS detail FROM r WHERE n <= 20 UNION ALL SELECT doc_id, count(*) || ' more warnings' FROM r WHERE n > 20 GROUP BY 1""")
def engine_warning_topk(spark, sf):
    return reader.warning_findings(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("nth"), F.concat("event_type", (F.col("event_id") % 30).cast("string")).alias("message")))


# --- links ---
_SITES = "sites AS (SELECT l_orderkey % 100 AS doc, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS site, l_partkey AS ord, l_partkey // 100 AS page, (l_suppkey % 40)::VARCHAR AS label FROM lineitem)"
_NOTES = "notes AS (SELECT p_partkey % 100 AS doc, p_partkey AS ord, p_partkey // 100 AS page, (p_size % 40)::VARCHAR AS label FROM part)"


@R.add(f"""WITH {_SITES}, {_NOTES}, printed AS (SELECT doc, label, count(*) AS printed FROM notes GROUP BY 1, 2),
    a AS (SELECT s.doc, s.ord, s.page, s.label, min(n.ord) AS note, arg_min(n.page, n.ord) AS note_page FROM (SELECT DISTINCT doc, ord, page, label FROM sites) s JOIN notes n ON n.doc = s.doc AND n.label = s.label AND n.ord > s.ord AND n.page >= s.page GROUP BY ALL)
    SELECT DISTINCT doc, ord, label, coalesce(CASE WHEN printed = 1 OR note_page <= page + 1 THEN note END, -1) AS note FROM sites LEFT JOIN a USING (doc, ord, page, label) LEFT JOIN printed USING (doc, label)""")
def footnote_asof(spark, sf):
    line = table(spark, sf, "lineitem")
    sites = line.select((F.col("l_orderkey") % 100).alias("doc"), F.col("l_partkey").alias("order"), F.floor(F.col("l_partkey") / 100).alias("page"), (F.col("l_suppkey") % 40).cast("string").alias("label")).distinct().withColumn("site", F.struct("order", "label"))
    notes = table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("doc"), F.col("p_partkey").alias("order"), F.floor(F.col("p_partkey") / 100).alias("page"), (F.col("p_size") % 40).cast("string").alias("label"))
    return links.resolve(sites, notes).select("doc", F.col("site.order").alias("ord"), "label", F.coalesce("note", F.lit(-1)).alias("note"))


@R.add(f"""WITH {_SITES}, {_NOTES}, printed AS (SELECT doc, label, count(*) AS printed FROM notes GROUP BY 1, 2),
    a AS (SELECT s.doc, s.ord, s.page, s.label, min(n.ord) AS note, arg_min(n.page, n.ord) AS note_page FROM (SELECT DISTINCT doc, ord, page, label FROM sites) s JOIN notes n ON n.doc = s.doc AND n.label = s.label AND n.ord > s.ord AND n.page >= s.page GROUP BY ALL)
    SELECT DISTINCT doc, ord, label, coalesce(CASE WHEN printed = 1 OR note_page <= greatest(page, page + ord % 4 - 1) + 1 THEN note END, -1) AS note FROM sites LEFT JOIN a USING (doc, ord, page, label) LEFT JOIN printed USING (doc, label)""")
def chained_calls(spark, sf):
    """Calls in tables that go on over up to two pages more: their notes may follow the last of them."""
    k = F.col("l_partkey")
    page = F.floor(k / 100)
    sites = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("doc"), k.alias("order"), page.alias("page"), (page + k % 4 - 1).alias("through"), (F.col("l_suppkey") % 40).cast("string").alias("label")).distinct().withColumn("site", F.struct("order", "label"))
    notes = table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("doc"), F.col("p_partkey").alias("order"), F.floor(F.col("p_partkey") / 100).alias("page"), (F.col("p_size") % 40).cast("string").alias("label"))
    return links.resolve(sites, notes).select("doc", F.col("site.order").alias("ord"), "label", F.coalesce("note", F.lit(-1)).alias("note"))


@R.add("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_suppkey % 9 + 1 AS k, l_partkey % 9 + 1 AS j, l_partkey FROM lineitem), d AS (SELECT DISTINCT doc, n, k, j FROM b)
    SELECT doc, n * 100 + k * 10 + j AS ord, k::VARCHAR AS label, length('Fee ')::BIGINT AS at, NULL::VARCHAR AS reason FROM d WHERE doc % 10 = k UNION ALL
    SELECT doc, n * 100 + k * 10 + j, j::VARCHAR, length('Fee (' || k || ') and of ')::BIGINT, 'function-word' FROM d WHERE doc % 10 = j""")
def register_semi_join(spark, sf):
    """``Fee (k) and of (j)``: the note's register admits one label of each document."""
    k, j = F.col("l_suppkey") % 9 + 1, F.col("l_partkey") % 9 + 1
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), k.alias("k"), j.alias("j")).repartition("doc")
    d = line.distinct().select("doc", (F.col("n") * 100 + F.col("k") * 10 + F.col("j")).alias("ord"), F.concat(F.lit("Fee ("), F.col("k").cast("string"), F.lit(") and of ("), F.col("j").cast("string"), F.lit(")")).alias("text"))
    register = line.select("doc", (F.col("doc") % 10).cast("string").alias("label")).distinct()
    return links.parenthetical_calls(d.withColumnRenamed("ord", "order"), register).select("doc", F.col("order").alias("ord"), "label", "at", "reason")


_PARTS = "parts AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 5 <> 0 AS first_on, o_orderkey % 7 <> 0 AS last_on, (o_orderkey % 3)::DOUBLE * 0.4 AS shift, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority[1] END AS header FROM orders)"


def parts(spark, sf):
    k = F.col("o_orderkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    shift = (k % 3).cast("double") * 0.4
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), page.cast("long").alias("page"), (k % 5 != 0).alias("first"), (k % 7 != 0).alias("last"), F.array(F.lit(72.0) + shift, F.lit(182.0) + shift).alias("edges"), F.when(k % 2 == 0, F.substring("o_orderpriority", 1, 1)).alias("header"))


_CONTINUED = f"""{_PARTS}, n AS (SELECT *, lead(page) OVER w AS next_page, lead(first_on) OVER w AS nf, lead(shift) OVER w AS ns, lead(header) OVER w AS nh FROM parts WINDOW w AS (PARTITION BY doc ORDER BY page)),
    linked AS (SELECT doc, page, next_page, nh IS NULL AS carried FROM n WHERE last_on AND nf AND abs(shift - ns) <= 0.5 AND (nh IS NULL OR nh = header))"""


@R.add(f"WITH {_CONTINUED} SELECT * FROM linked")
def continuation_pairs(spark, sf):
    return links.continued_tables(parts(spark, sf), 0.5)


@R.add(f"WITH {_CONTINUED}, g AS (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM linked) SELECT doc, page, max(next_page) OVER (PARTITION BY doc, g) AS through FROM g")
def continuation_chains(spark, sf):
    return links.chains(links.continued_tables(parts(spark, sf), 0.5))


# --- verifier: ink with planted faults ---
def ink(spark, sf):
    """The characters of the words, of which every 97th is lost and every 101st drawn twice."""
    g = glyphs(spark, sf).where("c <> ' '").select("doc_id", "page", "c", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("char").alias("ink"))
    return g


_INK = f"""WITH {ts.PROSE_WORDS_SQL}, ink0 AS (SELECT doc_id, page, id, unnest(range(0, length(text))) AS i, text FROM words), ink AS (SELECT doc_id, page, id, id * 100000 + i AS ink, text[i + 1] AS c FROM ink0)"""


@R.add(f"{_INK} SELECT doc_id, count(*) AS chars, count(*) AS owned, 0::BIGINT AS wrong FROM ink GROUP BY 1")
def multiset_ownership(spark, sf):
    """Every character's centre lies in its own word and in no other."""
    own = verify.owners(ink(spark, sf), prose.words(spark, sf))
    return own.groupBy("doc_id").agg(F.count("*").alias("chars"), F.count("word").alias("owned"), F.count_if(F.col("word") != F.floor(F.col("ink") / 100_000)).alias("wrong"))


@R.add(f"{_INK} SELECT doc_id, page, c, count(*) AS short FROM ink WHERE ink % 97 = 5 GROUP BY 1, 2, 3")
def verify_lost(spark, sf):
    whole = ink(spark, sf)
    return verify.multiset_difference(whole, whole.where("ink % 97 <> 5"), ["doc_id", "page", "c"])


@R.add(f"{_INK} SELECT doc_id, page, c, count(*) AS short FROM ink WHERE ink % 101 = 7 GROUP BY 1, 2, 3")
def verify_doubled(spark, sf):
    whole = ink(spark, sf)
    return verify.multiset_difference(whole.union(whole.where("ink % 101 = 7")), whole, ["doc_id", "page", "c"])


@R.add(f"{_INK} SELECT doc_id, page, min(ink) AS first, string_agg(c, '' ORDER BY ink) AS text FROM ink WHERE id % 50 = 3 GROUP BY doc_id, page, id")
def lost_runs(spark, sf):
    return verify.lost_runs(ink(spark, sf).where(F.floor(F.col("ink") / 100_000) % 50 == 3))


@R.add("SELECT event_type AS code, count(*) AS defects, count(DISTINCT user_id) AS documents FROM events GROUP BY 1")
def defect_counts(spark, sf):
    return verify.defect_counts(table(spark, sf, "events").select(F.col("event_type").alias("code"), F.col("user_id").alias("doc_id")))


# --- scores ---
@R.add("""SELECT l_returnflag, l_linestatus, round(sum(l_discount) / nullif(sum(l_quantity), 0), 8) AS pooled, round(avg(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END), 6) AS mean_of, round(2 * sum(l_discount) / nullif(sum(l_tax) + sum(l_quantity), 0), 8) AS dice, grouping(l_returnflag, l_linestatus)::BIGINT AS level
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def metric_cube(spark, sf):
    """Pooled, averaged and dice metrics by tool, data set, both and all."""
    g = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.round(scoring.pooled("l_discount", "l_quantity"), 8).alias("pooled"), F.round(scoring.mean_of("l_discount", "l_tax"), 6).alias("mean_of"), F.round(scoring.dice("l_discount", "l_tax", "l_quantity"), 8).alias("dice"), F.grouping_id().alias("level"))


@R.add("""WITH m AS (SELECT l_shipmode, p, r FROM (SELECT l_returnflag AS l_shipmode, sum(l_discount) / nullif(sum(l_tax), 0) AS p, sum(l_tax) / nullif(sum(l_quantity), 0) AS r FROM lineitem GROUP BY 1)) SELECT l_shipmode AS tool, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 8) AS f, round((p + r) / 2, 8) AS macro FROM m""")
def metric_harmonic_macro(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tool")).agg(scoring.pooled("l_discount", "l_tax").alias("p"), scoring.pooled("l_tax", "l_quantity").alias("r"))
    return m.select("tool", F.round(scoring.harmonic(F.col("p"), F.col("r")), 8).alias("f"), F.round(scoring.macro(F.col("p"), F.col("r")), 8).alias("macro"))


_DRAWS = """d AS (SELECT doc_id AS i, toxic AS num, 1 AS den FROM (SELECT row_number() OVER (ORDER BY doc_id, toxic) - 1 AS doc_id, toxic FROM labels)), n AS (SELECT count(*) AS n FROM d),
    s AS (SELECT draw, slot, ('0x' || sha256('20260928:' || draw || ':' || slot)[1:8])::BIGINT % n AS i FROM n, range(10000) a(draw), LATERAL (SELECT unnest(range(0, n)) AS slot) z), v AS (SELECT draw, sum(num) / sum(den) AS value FROM s JOIN d USING (i) GROUP BY 1)"""


def _drawn(spark, sf):
    counts = scoring.dense_index(table(spark, sf, "labels").withColumn("k", F.struct("doc_id", "toxic")), "k").select("i", F.col("toxic").alias("num"), F.lit(1).alias("den"))
    return scoring.bootstrap(counts, 10_000)


@R.add(f"WITH {_DRAWS} SELECT draw, round(value, 8) AS value FROM v")
def bootstrap_draws(spark, sf):
    return _drawn(spark, sf).select("draw", F.round("value", 8).alias("value"))


@R.add(f"WITH {_DRAWS} SELECT round(quantile_cont(value, 0.025), 8) AS low, round(quantile_cont(value, 0.975), 8) AS high FROM v")
def bootstrap_interval(spark, sf):
    return scoring.interval(_drawn(spark, sf)).select(F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@R.add("""WITH t AS (SELECT p_partkey % 50 AS doc, p_size AS page, p_partkey AS t, (p_partkey % 100)::DOUBLE AS x0, (p_partkey % 60)::DOUBLE AS y0, (p_partkey % 100 + 40)::DOUBLE AS x1, (p_partkey % 60 + 40)::DOUBLE AS y1 FROM part),
    f AS (SELECT doc, page, t AS f, x0 + 7 AS x0, y0 + 5 AS y0, x1 + 7 AS x1, y1 + 5 AS y1 FROM t), o AS (SELECT t.doc, t, f, (least(t.x1, f.x1) - greatest(t.x0, f.x0)) * (least(t.y1, f.y1) - greatest(t.y0, f.y0)) AS area FROM t JOIN f USING (doc, page) WHERE least(t.x1, f.x1) > greatest(t.x0, f.x0) AND least(t.y1, f.y1) > greatest(t.y0, f.y0))
    SELECT doc, t, arg_max(f, (area, -f)) AS f FROM o GROUP BY 1, 2""")
def table_match_topk(spark, sf):
    p = F.col("p_partkey")
    t = table(spark, sf, "part").select((p % 50).alias("doc"), F.col("p_size").alias("page"), p.alias("t"), (p % 100).cast("double").alias("x0"), (p % 60).cast("double").alias("y0"), (p % 100 + 40).cast("double").alias("x1"), (p % 60 + 40).cast("double").alias("y1"))
    f = t.select("doc", "page", F.col("t").alias("f"), (F.col("x0") + 7).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x1") + 7).alias("x1"), (F.col("y1") + 5).alias("y1"))
    return scoring.best_match(t, f)


@R.add("""SELECT source, doc_id, numbers FROM (SELECT source, doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, row_number() OVER (PARTITION BY source ORDER BY len(regexp_extract_all(text, '[0-9]+')) DESC, length(text) DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def most_numeric(spark, sf):
    """Of each source the document with the most numbers, then the longest, then the first."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).cast("long").alias("numbers"), F.length("text").alias("long"))
    return scoring.top_of_group(d, "source", F.desc("numbers"), F.desc("long"), F.col("doc_id")).select("source", "doc_id", "numbers")


@R.add("""WITH t AS (SELECT p_size AS doc, p_partkey % 3 AS tbl, p_partkey AS t, p_name AS text FROM part), f AS (SELECT doc, tbl, replace(text, 'a', 'e') AS other FROM t)
    SELECT doc, t, max(length(replace(text, ' ', ''))) AS chars, min(least(levenshtein(replace(text, ' ', ''), replace(other, ' ', '')), length(replace(text, ' ', '')))) AS errors FROM t JOIN f USING (doc, tbl) GROUP BY 1, 2""")
def cer_counts(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_size").alias("doc"), (F.col("p_partkey") % 3).alias("tbl"), F.col("p_partkey").alias("t"), F.col("p_name").alias("text"))
    return scoring.character_errors(t, t.select("doc", "tbl", F.replace("text", F.lit("a"), F.lit("e")).alias("text")))


_CODES = "c AS (SELECT event_id, (event_id * 7919 % 1200)::INT AS code, event_id % 11 = 0 AS generated, event_id % 13 = 0 AS hyphen, event_id % 17 = 0 AS map_error FROM events)"


@R.add(f"""WITH {_CODES} SELECT event_id, code, CASE WHEN generated THEN 'generated' WHEN hyphen OR (code = 2 AND NOT map_error) THEN 'hyphen' WHEN (map_error AND code NOT IN (9, 10, 13, 32, 160)) OR code = 0 OR code BETWEEN 128 AND 159 THEN 'unmapped' WHEN code IN (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160) THEN 'space' WHEN code < 32 OR code IN (127, 173, 888, 889, 896, 897, 898, 899, 907, 909, 930) THEN 'invisible' ELSE 'ink' END AS kind FROM c""")
def char_kinds(spark, sf):
    """What a drawn character is, in the order in which its facts decide."""
    e = F.col("event_id")
    c = table(spark, sf, "events").select("event_id", (e * 7919 % 1200).cast("int").alias("code"), (e % 11 == 0).alias("generated"), (e % 13 == 0).alias("hyphen"), (e % 17 == 0).alias("map_error"))
    return c.select("event_id", "code", verify.char_kind(F.col("code"), F.col("generated"), F.col("hyphen"), F.col("map_error")).alias("kind"))
