"""Queries over token classes, with their SQL. Samples: the documents' own tokens, and labels and amounts made from the sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions import tokens as tk
from leafloom.plans.registry import Registry, table

R = Registry()

_FIXED = ["•", "–", "—", "-", "*", "†", "‡‡", "§", "¶#", "◊", "■■", "n/a", "NIL", "free", "1999", "2024", "A.", "C.", "iv.", "(xii)", "xiv", "(a)", "USD", "SEC 31", "CHF 250", "5 USD", "12 bps", "3bn", "1.5m", "7/12", "- 7 -", "[4]", "|81", "0004", "1,400,5", "($3.25)", "−12.5%", "1 - 2", "5 to 6", "1,3,5", "(2)(3)", "nd", "SM", "Appendix"]
_VARIANTS = """concat(q, '.'), concat('(', q, ')'), concat(chr(97 + q % 26), ')'), concat(q, '.', n), concat('$', q, ',', lpad(p % 1000, 3, '0'), '.', lpad(p % 100, 2, '0')), concat(q, '%'), concat('EUR ', q), concat(q, '-', q + n), concat('(', q, '.', n, ')'), concat(1900 + q), concat(q, 'bp'), concat(q, 'k/share'), concat(q, ' of ', q + n), concat('Note ', q), concat(q, '*'), concat('[', q, ']')"""


def tokens(spark, sf):
    """The distinct tokens. Of a part's key the variants take its remainder by 1000 alone, so that the sales are few before they are written out.

    The count keeps what is asked of a token above the grouping: it is worked out once a token, not once for each place where the token stands.
    """
    documents = table(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "[ \n]")).alias("token")).where("token <> ''")
    sales = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_partkey") % 1000).alias("p")).distinct()
    variants = _VARIANTS.replace("lpad(p % 1000, 3", "lpad(cast(p % 1000 as string), 3").replace("lpad(p % 100, 2", "lpad(cast(p % 100 as string), 2")
    made = sales.select(F.explode(F.expr(f"array({variants})")).alias("token"))
    fixed = spark.createDataFrame([(t,) for t in _FIXED], "token string")
    every = documents.union(made).union(fixed).groupBy("token").agg(F.count("*").alias("n"))
    return every.select(F.when(F.col("n") > 0, F.col("token")).alias("token"))


_VALUES = ", ".join("('" + t + "')" for t in _FIXED)
_DUCK = _VARIANTS.replace("lpad(p % 1000, 3", "lpad((p % 1000)::VARCHAR, 3").replace("lpad(p % 100, 2", "lpad((p % 100)::VARCHAR, 2")
T = f"""WITH sales AS (SELECT DISTINCT l_quantity::INT AS q, l_linenumber AS n, l_partkey AS p FROM lineitem),
t AS (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[ \\n]')) AS token FROM documents UNION SELECT unnest([{_DUCK}]) FROM sales UNION SELECT * FROM (VALUES {_VALUES}) v(token)),
tokens AS (SELECT DISTINCT token FROM t WHERE token <> '')"""
_BULLETS = "(" + ", ".join(f"'{b}'" for b in tk.BULLETS) + ")"
_NOT_CALLS = "(" + ", ".join(f"'{b}'" for b in tk.NOT_CALLS) + ")"
#: Without lookaheads, which the other engine's expressions lack: the texts at hand part from the pattern nowhere.
_VALUE = tk.value_pattern(tk.CODES).replace("'", "''")
_STRONG = f"{tk.SYMBOL}|{tk.CODES}([^A-Za-z]|$)|%|bps?|‰|[0-9][.,''  ][0-9]|[0-9]{tk.MAGNITUDE}([^A-Za-z]|$)"
_IS_VALUE = f"(NOT regexp_full_match(trim(token), '{tk.YEAR}') AND regexp_full_match(trim(token), '{_VALUE}'))"
_ENUM = f"regexp_full_match(token, '{tk.ENUMERATOR}')"
_CORE = "trim(token, '-–—()[]|.:')"
_ROMAN = f"(length({_CORE}) BETWEEN 1 AND 6 AND regexp_full_match({_CORE}, '{tk.ROMAN}'))"
_PAGE = f"(NOT {_ENUM} AND NOT regexp_full_match({_CORE}, '{tk.YEAR}') AND (regexp_full_match({_CORE}, '{tk.PAGE_DIGITS}') OR {_ROMAN}))"


@R.add(f"{T} SELECT token FROM tokens WHERE token IN {_BULLETS}")
def bullets(spark, sf):
    return tokens(spark, sf).where(tk.is_bullet(F.col("token")))


@R.add(f"{T} SELECT token FROM tokens WHERE {_ENUM}")
def enumerators(spark, sf):
    return tokens(spark, sf).where(tk.enumerator(F.col("token")).isNotNull())


@R.add(f"{T} SELECT token FROM tokens WHERE regexp_full_match(token, '{tk.SECTION_NUMBER}') AND NOT regexp_full_match(token, '{tk.YEAR}')")
def section_numbers(spark, sf):
    return tokens(spark, sf).where(tk.section_number(F.col("token")).isNotNull())


@R.add(f"{T} SELECT token FROM tokens WHERE {_ENUM} OR regexp_full_match(token, '{tk.NOTE_MARK}')")
def note_labels(spark, sf):
    return tokens(spark, sf).where(tk.note_label(F.col("token")).isNotNull())


@R.add(f"{T} SELECT token FROM tokens WHERE regexp_full_match(token, '{tk.MARK}')")
def marks(spark, sf):
    return tokens(spark, sf).where(tk.is_mark(F.col("token")))


@R.add(f"{T}, p AS (SELECT token, array_to_string(list_filter(list_transform(regexp_split_to_array(token, ',|\\)\\(|\\s+'), lambda x: trim(x, '().')), lambda x: x <> '' AND length(x) <= 4 AND x NOT IN {_NOT_CALLS}), '|') AS parts FROM tokens) SELECT * FROM p WHERE parts <> ''")
def call_parts(spark, sf):
    return tokens(spark, sf).select("token", F.array_join(tk.call_parts(F.col("token")), "|").alias("parts")).where("parts <> ''")


@R.add(f"{T} SELECT token FROM tokens WHERE {_IS_VALUE}")
def value_tokens(spark, sf):
    return tokens(spark, sf).where(tk.is_value(F.col("token")))


@R.add(f"{T} SELECT token FROM tokens WHERE {_IS_VALUE} AND regexp_matches(token, '{_STRONG}')")
def strong_value_tokens(spark, sf):
    return tokens(spark, sf).where(tk.is_strong_value(F.col("token")))


@R.add(f"""{T}, p AS (SELECT DISTINCT concat_ws(' ', token, 'per month') AS piece, token FROM tokens WHERE {_IS_VALUE}) SELECT piece FROM p WHERE regexp_matches(token, '{_STRONG}') AND len(string_split(piece, ' ')) <= 4 AND NOT contains(token, ' ')""")
def value_pieces(spark, sf):
    pieces = tokens(spark, sf).where(tk.is_value(F.col("token")) & ~F.col("token").contains(" ")).select(F.concat_ws(" ", "token", F.lit("per month")).alias("piece")).distinct()
    return pieces.where(tk.is_value_piece(F.split("piece", " ")))


@R.add(f"""{T}, c AS (SELECT token, trim(token, '()') AS core FROM tokens),
    m AS (SELECT token, core, regexp_extract(core, '^{tk.CHART_NUMBER}$', 1) AS whole, regexp_extract(core, '^{tk.CHART_NUMBER}$', 2) AS mark, regexp_extract(core, '^{tk.CHART_NUMBER}$', 3) AS part FROM c WHERE regexp_full_match(core, '{tk.CHART_NUMBER}')),
    v AS (SELECT token, core, (CASE WHEN whole = '' THEN '0' ELSE replace(whole, ',', '') END || '.' || CASE WHEN part = '' THEN '0' ELSE part END)::DOUBLE AS v FROM m WHERE (whole <> '' OR part <> '') AND NOT (contains(whole, ',') AND mark = ','))
    SELECT token, CASE WHEN substr(core, 1, 1) IN ('-', '−') THEN -v ELSE v END AS value FROM v""")
def chart_numbers(spark, sf):
    return tokens(spark, sf).select("token", tk.chart_number(F.col("token")).alias("value")).where("value is not null")


@R.add(f"{T} SELECT token, regexp_full_match({_CORE}, '{tk.PAGE_DIGITS}') AS in_digits FROM tokens WHERE {_PAGE}")
def page_number_tokens(spark, sf):
    t = F.col("token")
    return tokens(spark, sf).where(tk.page_number_token(t)).select("token", tk.page_digits(t).alias("in_digits"))


@R.add(f"""{T} SELECT token, trim(token, '().') AS label FROM tokens WHERE trim(token, '().') <> token""")
def stripped_labels(spark, sf):
    return tokens(spark, sf).select("token", tk.strip_label(F.col("token")).alias("label")).where("label <> token")


@R.add(f"""{T} SELECT token, CASE WHEN sha256('half:documents:' || token)[1] BETWEEN '0' AND '7' THEN 'dev' ELSE 'test' END AS half FROM tokens""")
def split_half(spark, sf):
    return tokens(spark, sf).select("token", tk.half(F.lit("documents"), F.col("token")).alias("half"))


@R.add(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS folded, sha256(text) AS digest FROM documents""")
def normalize_ws_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tk.normalize_ws(F.col("text")).alias("folded"), F.sha2("text", 256).alias("digest"))


@R.add(r"""WITH k AS (SELECT doc_id, source, 'k' || sha256('paragraph' || chr(31) || trim(regexp_replace(text, '\s+', ' ', 'g')))[1:16] AS key0 FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY source, key0 ORDER BY doc_id) AS nth FROM k) SELECT doc_id, CASE WHEN nth = 1 THEN key0 ELSE key0 || ':' || nth END AS key FROM n""")
def twin_keys(spark, sf):
    from pyspark.sql import Window

    k = table(spark, sf, "documents").select("doc_id", "source", tk.content_key(F.lit("paragraph"), F.col("text")).alias("key0"))
    nth = F.row_number().over(Window.partitionBy("source", "key0").orderBy("doc_id"))
    return k.select("doc_id", F.when(nth == 1, F.col("key0")).otherwise(F.concat("key0", F.lit(":"), nth.cast("string"))).alias("key"))


@R.add(r"""SELECT doc_id, NOT regexp_matches(text, '^[ \n]|[ \n]$|[\t\r\f\v]|[ \n][ \n]') AS well_shaped FROM documents""")
def text_shapes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tk.well_shaped(F.col("text")).alias("well_shaped"))


_CALLS = """SELECT l_orderkey AS k, l_linenumber::INT AS n, l_quantity::INT AS q, concat_ws(' ', 'Fee', CASE l_quantity::INT % 9 WHEN 0 THEN '' WHEN 1 THEN 'and,' WHEN 2 THEN 'rule (a)' WHEN 3 THEN 'is' WHEN 4 THEN 'share' WHEN 5 THEN '(x y)' WHEN 6 THEN 'of the' WHEN 7 THEN '25' ELSE '…' END) || CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE '' END AS before FROM lineitem"""


@R.add(f"""WITH c AS (SELECT DISTINCT n, before FROM ({_CALLS}) UNION SELECT 2, 'two ' UNION SELECT 4, ''), p AS (SELECT n, before, rtrim(before, ' ') AS pb FROM c),
    x AS (SELECT *, pb = before AS glued, regexp_extract(pb, '([A-Za-z]+)[^A-Za-z]*$', 1) AS word, regexp_extract(pb, '\\(([^()]*)\\)$', 1) AS grp FROM p)
    SELECT n, before, CASE WHEN pb = '' THEN 'clause-initial' WHEN regexp_matches(pb, '[,;:]$') THEN 'sub-clause-enumerator' WHEN ends_with(pb, ')') AND glued AND regexp_full_match(grp, '[a-z]|[ivxl]{{1,4}}') THEN 'statutory-citation' WHEN ends_with(pb, ')') THEN NULL
        WHEN glued AND regexp_matches(pb, '[0-9]$') THEN 'attached-to-number' WHEN lower(word) = ['one', 'two', 'three', 'four', 'five', 'six', 'seven'][n] THEN 'spelled-number-gloss' WHEN word IN ({", ".join("'" + w + "'" for w in tk.FUNCTION_WORDS)}) THEN 'function-word'
        WHEN NOT regexp_matches(pb, '[\\pL\\pN_%.\\]}}]$') THEN 'no-anchor' END AS reason FROM x""")
def paren_rejections(spark, sf):
    calls = _CALLS.replace("::INT", "").replace("l_linenumber", "int(l_linenumber)").replace("l_quantity", "int(l_quantity)")
    table(spark, sf, "lineitem").createOrReplaceTempView("leafloom_lineitem")
    c = spark.sql(calls.replace("FROM lineitem", "FROM leafloom_lineitem")).select("n", "before").distinct()
    c = c.union(spark.createDataFrame([(2, "two "), (4, "")], c.schema)).distinct()
    return c.select("n", "before", tk.rejection(F.col("before"), F.col("n")).alias("reason"))


@R.add(r"""SELECT k, n, call FROM (SELECT l_orderkey AS k, l_linenumber AS n, unnest(regexp_extract_all('See footnote ' || l_linenumber || ' and Footnotes  ' || (l_partkey % 2000) || '; xfootnote 3', '(?i)\bfootnotes?\s+([0-9]{1,3})\b', 1)) AS call FROM lineitem)""")
def named_calls(spark, sf):
    text = F.concat(F.lit("See footnote "), F.col("l_linenumber").cast("string"), F.lit(" and Footnotes  "), (F.col("l_partkey") % 2000).cast("string"), F.lit("; xfootnote 3"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.explode(tk.named_calls(text)).alias("call"))


@R.add(r"""SELECT DISTINCT p_type AS title, false AS titles FROM part UNION SELECT '1. Defined Terms ' || p_size, true FROM part UNION SELECT 'Glossary of ' || p_brand, true FROM part UNION SELECT 'Definitions .... ' || p_size, false FROM part""")
def definition_titles(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    titles = F.array("p_type", F.concat(F.lit("1. Defined Terms "), size), F.concat(F.lit("Glossary of "), "p_brand"), F.concat(F.lit("Definitions .... "), size))
    return part.select(F.explode(titles).alias("title")).distinct().select("title", tk.is_definitions_title(F.col("title")).alias("titles"))


@R.add(r"""SELECT DISTINCT 'means ' || p_type AS text, true AS defines FROM part UNION SELECT 'shall mean, ' || p_type, true FROM part UNION SELECT 'mean streets ' || p_type, true FROM part UNION SELECT p_type, false FROM part UNION SELECT 'is not ' || p_type, false FROM part""")
def defining_openings(spark, sf):
    part = table(spark, sf, "part")
    texts = F.array(*(F.concat(F.lit(x), "p_type") for x in ("means ", "shall mean, ", "mean streets ", "", "is not ")))
    return part.select(F.explode(texts).alias("text")).distinct().select("text", tk.defines(F.split("text", " ")).alias("defines"))


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(t, '<([A-Za-z/!?])', '\\<\1', 'g'), '\|', '\\|', 'g') AS cell, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM (SELECT doc_id, '<b>' || text || '| a<3 & <!x' AS t FROM documents)""")
def markdown_escape(spark, sf):
    t = F.concat(F.lit("<b>"), "text", F.lit("| a<3 & <!x"))
    return table(spark, sf, "documents").select("doc_id", tk.escape_cell(t).alias("cell"), tk.escape_html(t).alias("html"))


@R.add(r"""SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(replace(a.p_name, ' ', ''), replace(b.p_name, ' ', '')) AS edits FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def glyph_edit_distance(spark, sf):
    part = table(spark, sf, "part")
    other = part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    glyphs = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return part.join(other, part.p_partkey == other.k).select(F.col("p_partkey").alias("a"), "b", F.levenshtein(glyphs("p_name"), glyphs("other")).cast("long").alias("edits"))


@R.add(r"""WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents) SELECT CASE WHEN regexp_full_match(c, '[\s\x{200b}\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]') THEN 'space' WHEN regexp_full_match(c, '[\p{Cc}\p{Cf}\p{Co}]') THEN 'invisible' ELSE 'word' END AS class, count(*) AS n FROM c GROUP BY 1""")
def char_census(spark, sf):
    c = table(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("c"))
    return c.groupBy("c").count().groupBy(tk.char_class(F.col("c")).alias("class")).agg(F.sum("count").alias("n"))
