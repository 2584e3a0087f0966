"""Lines to blocks: fragments, body size, line gaps, paragraph breaks, block types and texts. Windows are per document or page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.config import Lexicon, Profile
from leafloom.functions import tokens as tk

MIN_GAPS = 4  # fixed value


def fragments(words: DataFrame, profile: Profile | None = None) -> DataFrame:
    """doc_id, page, line, fragment, x0, x1, n_words, text: a line cut where a gap exceeds one em of the larger size beside it."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("id")
    gap = F.col("x0") - F.lag("x1").over(w)
    cut = F.when(gap > (profile or Profile()).fragment_gap_em * F.greatest("size", F.lag("size").over(w)), 1).otherwise(0)
    numbered = words.withColumn("cut", cut).withColumn("fragment", F.sum("cut").over(w).cast("long"))
    tokens = F.array_sort(F.collect_list(F.struct("id", "text")))
    return numbered.groupBy("doc_id", "page", "line", "fragment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n_words"), F.array_join(F.transform(tokens, lambda t: t.text), " ").alias("text"))


def parts(words: str, size: Column, profile: Profile | None = None) -> Column:
    """How many fragments ``fragments`` cuts a line of one size into. words: its words in order, with x0 and x1."""
    n, em = F.size(words), (profile or Profile()).fragment_gap_em
    gaps = F.zip_with(F.slice(f"{words}.x1", F.lit(1), n - 1), F.slice(f"{words}.x0", F.lit(2), n - 1), lambda a, b: b - a)
    return (1 + F.size(F.filter(gaps, lambda g: g > em * size))).cast("long")


def body_size(words: DataFrame) -> DataFrame:
    """doc_id, body: the half-point size that carries most characters; of equals the smaller."""
    sized = words.groupBy("doc_id", (F.round(F.col("size") * 2) / 2).alias("s")).agg(F.sum(F.length("text")).alias("chars"))
    return sized.groupBy("doc_id").agg(F.max_by("s", F.struct(F.col("chars"), -F.col("s"))).alias("body"))


def line_gaps(lines: DataFrame) -> DataFrame:
    """doc_id, size, gap: the lower quartile of the clamped gaps of each size class with four gaps or more; size null: of all."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    half = F.round(F.col("size") * 2) / 2
    g = lines.withColumn("half", half).select("doc_id", F.greatest(F.lit(0.0), F.round(F.lead("top").over(w) - F.col("bottom"), 2)).alias("gap"), F.lead("line").over(w).alias("next"), F.when(F.lead("half").over(w) == F.col("half"), F.col("half")).alias("half")).where("next is not null")
    by_size = g.where("half is not null").groupBy("doc_id", F.col("half").alias("size")).agg(F.expr("percentile_disc(0.25) within group (order by gap)").alias("gap"), F.count("*").alias("n")).where(F.col("n") >= MIN_GAPS).drop("n")
    return by_size.union(g.groupBy("doc_id").agg(F.expr("percentile_disc(0.25) within group (order by gap)").alias("gap")).select("doc_id", F.lit(None).cast("double").alias("size"), "gap"))


def heading_levels(blocks: DataFrame) -> DataFrame:
    """Adds level to headings: 1 for the largest half-point size of the document, 2 for the next."""
    heads = blocks.where("kind = 'heading'").withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.col("size") * 2) / 2))).cast("long"))
    return heads


def blocks(lines: DataFrame, words: DataFrame, profile: Profile | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, page, block, kind, label, size, n_lines, n_words, first_line, x0, x1, top, bottom, text, key. lines that have a part: a block ends where it does."""
    p, bullet = profile or Profile(), lambda c: tk.is_bullet(c, (lexicon or Lexicon()).bullets)
    gaps = line_gaps(lines)
    # a document's gaps are one row, so that its lines are not joined by size
    known = gaps.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("size").isNotNull(), F.struct("size", "gap")))).alias("own_gaps"), F.max(F.when(F.col("size").isNull(), F.col("gap"))).alias("any_gap"))
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    first, last = F.substring_index("text", " ", 1), F.substring_index("text", " ", -1)
    placed = lines.withColumn("half", F.round(F.col("size") * 2) / 2).withColumn("first", first).withColumn("last", last)
    placed = placed.join(known.hint("merge"), "doc_id", "left").withColumn("lead", F.coalesce(F.try_element_at("own_gaps", F.col("half")), "any_gap", F.lit(0.0))).drop("own_gaps", "any_gap")
    prev = lambda c: F.lag(c).over(w)
    runs_on = ~prev("last").rlike(r"[.:;?!]\z") & F.col("first").rlike(r"^\p{Ll}")
    opens = bullet(F.col("first")) | tk.full(F.col("first"), tk.ENUMERATOR)
    breaks = (
        prev("line").isNull()
        | ((F.round(F.col("top") - prev("bottom"), 2) > F.greatest(p.paragraph_gap_ratio * prev("lead"), F.lit(p.paragraph_gap_floor))) & ~runs_on)
        | (F.abs(F.col("size") - prev("size")) > p.size_change_ratio * prev("size"))
        | (F.col("bold") != prev("bold"))
        | opens
        | (F.col("part") != prev("part") if "part" in lines.columns else F.lit(False))
    )
    doc = Window.partitionBy("doc_id").orderBy("line")
    placed = placed.withColumn("breaks", breaks.cast("int")).withColumn("opens", opens).withColumn("block", F.sum("breaks").over(doc).cast("long"))
    inside = Window.partitionBy("doc_id", "block").orderBy("line")
    hyphened = F.coalesce(F.lag("last").over(inside).rlike(r".-\z") & F.col("first").rlike(r"^\p{Ll}"), F.lit(False))
    placed = placed.withColumn("joined", hyphened)
    part = F.concat(F.when(F.col("joined") | F.lag("line").over(inside).isNull(), "").otherwise(" "), F.when(F.coalesce(F.lead("joined").over(inside), F.lit(False)), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    placed = placed.withColumn("part", part)
    g = placed.groupBy("doc_id", "page", "block").agg(
        F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words"), F.min("line").alias("first_line"), F.min_by("size", "line").alias("size"), F.min_by("first", "line").alias("first"), F.max_by("last", "line").alias("last"),
        F.min_by("opens", "line").alias("opens"), F.bool_and("bold").alias("bold"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda p: p.part), "").alias("text"),
    ).join(body_size(words).hint("merge"), "doc_id")
    label = F.when((F.col("size") <= p.footnote_size_ratio * F.col("body")) & tk.note_label(F.col("first")).isNotNull() & (tk.strip_label(F.col("first")) != ""), tk.strip_label(F.col("first")))
    heading = (F.col("n_lines") <= p.heading_max_lines) & (F.col("n_words") <= p.heading_max_words) & ~bullet(F.col("first")) & ~F.col("last").rlike(r"[.;,]\z") & ((F.col("size") >= p.heading_size_ratio * F.col("body")) | F.col("bold"))
    kind = F.when(label.isNotNull(), "footnote").when(heading, "heading").when(F.col("opens"), "list_item").otherwise("paragraph")
    g = g.withColumn("kind", kind).withColumn("label", F.when(F.col("kind") == "footnote", label).when(F.col("kind") == "list_item", F.col("first")))
    g = g.withColumn("key0", tk.content_key(F.col("kind"), F.col("text")))
    twin = F.row_number().over(Window.partitionBy("doc_id", "key0").orderBy("block"))
    return g.withColumn("key", F.when(twin == 1, F.col("key0")).otherwise(F.concat("key0", F.lit(":"), twin.cast("string")))).select(
        "doc_id", "page", "block", "kind", "label", "size", "n_lines", F.col("n_words").cast("long").alias("n_words"), "first_line", "x0", "x1", "top", "bottom", "first", "last", "text", "key"
    )


BLOCKS_SQL = """
bodies AS (SELECT doc_id, arg_max(s, (chars, -s)) AS body FROM (SELECT doc_id, round(size * 2) / 2 AS s, sum(length(text)) AS chars FROM words GROUP BY 1, 2) GROUP BY 1),
gap0 AS (SELECT doc_id, greatest(0.0::DOUBLE, round(lead(top) OVER w - bottom, 2)) AS gap, lead(line) OVER w AS nxt, CASE WHEN lead(size) OVER w = size THEN round(size * 2) / 2 END AS half FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
gap1 AS (SELECT * FROM gap0 WHERE nxt IS NOT NULL),
gap_own AS (SELECT doc_id, half, quantile_disc(gap, 0.25) AS own_gap FROM gap1 WHERE half IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4),
gap_any AS (SELECT doc_id, quantile_disc(gap, 0.25) AS any_gap FROM gap1 GROUP BY 1),
placed0 AS (SELECT l.*, split_part(text, ' ', 1) AS first_t, split_part(text, ' ', -1) AS last_t, coalesce(own_gap, any_gap, 0) AS lead_gap,
    regexp_full_match(split_part(text, ' ', 1), '([0-9]{1,3}|[a-z]|[ivxlc]{1,6}|[A-Z])[.)]|\\(([0-9]{1,3}|[a-z]|[ivxlc]{1,6})\\)') OR split_part(text, ' ', 1) IN ('•','▪','◦','■','□','●','○','‣','⁃','∙','·','–','—','-','*') AS opens
    FROM lines l LEFT JOIN gap_own o ON o.doc_id = l.doc_id AND o.half = round(l.size * 2) / 2 LEFT JOIN gap_any a ON a.doc_id = l.doc_id),
placed1 AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL
        OR (round(top - lag(bottom) OVER w, 2) > greatest(1.75 * lag(lead_gap) OVER w, 2.0) AND NOT (NOT regexp_matches(lag(last_t) OVER w, '[.:;?!]$') AND regexp_matches(first_t, '^\\p{Ll}')))
        OR abs(size - lag(size) OVER w) > 0.1 * lag(size) OVER w OR bold <> lag(bold) OVER w OR opens THEN 1 ELSE 0 END AS breaks
    FROM placed0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
placed2 AS (SELECT *, sum(breaks) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS block FROM placed1),
placed3 AS (SELECT *, coalesce(regexp_matches(lag(last_t) OVER w, '.-$') AND regexp_matches(first_t, '^\\p{Ll}'), false) AS joined, lag(line) OVER w IS NULL AS opening FROM placed2 WINDOW w AS (PARTITION BY doc_id, block ORDER BY line)),
placed4 AS (SELECT *, CASE WHEN joined OR opening THEN '' ELSE ' ' END || CASE WHEN coalesce(lead(joined) OVER (PARTITION BY doc_id, block ORDER BY line), false) THEN left(text, length(text) - 1) ELSE text END AS part FROM placed3),
block0 AS (SELECT p.doc_id, page, block, count(*) AS n_lines, sum(n_words)::BIGINT AS n_words, min(line) AS first_line, arg_min(size, line) AS size, arg_min(first_t, line) AS first_t, arg_max(last_t, line) AS last_t,
    arg_min(opens, line) AS opens, bool_and(bold) AS bold, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, string_agg(part, '' ORDER BY line) AS text FROM placed4 p GROUP BY 1, 2, 3),
block1 AS (SELECT b.*, body, CASE WHEN size <= 0.9 * body AND (regexp_full_match(first_t, '([0-9]{1,3}|[a-z]|[ivxlc]{1,6}|[A-Z])[.)]|\\(([0-9]{1,3}|[a-z]|[ivxlc]{1,6})\\)') OR regexp_full_match(first_t, '[0-9]{1,3}|[*†‡§¶#]{1,3}')) AND trim(first_t, '().') <> '' THEN trim(first_t, '().') END AS note
    FROM block0 b JOIN bodies USING (doc_id)),
block2 AS (SELECT *, CASE WHEN note IS NOT NULL THEN 'footnote'
        WHEN n_lines <= 2 AND n_words <= 15 AND first_t NOT IN ('•','▪','◦','■','□','●','○','‣','⁃','∙','·','–','—','-','*') AND NOT regexp_matches(last_t, '[.;,]$') AND (size >= 1.1 * body OR bold) THEN 'heading'
        WHEN opens THEN 'list_item' ELSE 'paragraph' END AS kind FROM block1),
block3 AS (SELECT *, CASE kind WHEN 'footnote' THEN note WHEN 'list_item' THEN first_t END AS label, 'k' || sha256(kind || chr(31) || trim(regexp_replace(text, '\\s+', ' ', 'g')))[1:16] AS key0 FROM block2),
blocks AS (SELECT doc_id, page, block, kind, label, size, n_lines, n_words, first_line, x0, x1, top, bottom, first_t, last_t, text, body,
    CASE WHEN row_number() OVER k = 1 THEN key0 ELSE key0 || ':' || row_number() OVER k END AS key FROM block3 WINDOW k AS (PARTITION BY doc_id, key0 ORDER BY block))"""


def joined_paragraphs(blocks_: DataFrame) -> DataFrame:
    """doc_id, block, head: every paragraph that a page border broke, and the paragraph whose sentence it goes on with.

    A page's last content block and the next page's first are compared; chains run through pages that only continue.
    """
    flow = blocks_.where("kind <> 'footnote'")
    w = Window.partitionBy("doc_id").orderBy("block")
    prev = lambda c: F.lag(c).over(w)
    goes_on = (F.col("page") > prev("page")) & (F.col("kind") == "paragraph") & (prev("kind") == "paragraph") & ~prev("last").rlike(r"[.:;?!]\z") & F.col("first").rlike(r"^\p{Ll}")
    flow = flow.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    flow = flow.withColumn("head", F.last(F.when(~F.col("goes_on"), F.col("block")), ignorenulls=True).over(w))
    return flow.where("goes_on").select("doc_id", "block", "head")
