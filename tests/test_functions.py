"""Token classes, geometry and folds against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from leafloom.functions import geometry as geo
from leafloom.functions import tokens as tk
from leafloom.operators import checks, links, prose, tables
from leafloom.sources import typeset as ts


def column(spark, values, c, kind="string"):
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", c(F.col("v")).alias("r"))
    return [r.r for r in sorted(out.collect())]


@pytest.mark.parametrize(
    ("name", "yes", "no"),
    [
        ("is_value", ["$1,234.50", "12%", "(3.5)", "CHF 250", "1 - 2", "—", "n/a", "NIL", "3bn", "5 USD/share", "−7"], ["1999", "", "LPS2", "abc", "1,23,4", "12 apples", "USDX 5"]),
        ("is_strong_value", ["$5", "12%", "1.5", "1,000", "3bn", "CHF 250"], ["5", "(47)", "1-2", "2024", "free"]),
        ("is_mark", ["*", "††", "◊", "■□"], ["", "*****", "a*"]),
        ("is_roman", ["iv", "XII", "m"], ["", "iiii", "abc", "mmmcmxc"]),
        ("page_number_token", ["7", "2/5", "[4]", "xii", "0004"], ["1999", "3.", "(4)", "12345", "word"]),
        ("well_shaped", ["a b", "a\nb", ""], [" a", "a  b", "a\tb", "a\n", "a \nb"]),
        ("is_definitions_title", ["Definitions", "1. Defined Terms", "Glossary of terms"], ["Definitions ..... 4", "a b c d e f g h glossary", ""]),
    ],
)
def test_classes(spark, name, yes, no):
    found = column(spark, yes + no, getattr(tk, name))
    assert found == [True] * len(yes) + [False] * len(no)


def test_chart_numbers(spark):
    values = ["1,400", "(12.5%)", "$3", "-7", "1,4", "1,400,5", "x", "", ".5", "−2.25"]
    assert column(spark, values, tk.chart_number) == [1400.0, 12.5, 3.0, -7.0, 1.4, None, None, None, 0.5, -2.25]


def test_line_keys(spark):
    lines = ["Page 12 of 40", "12 Fee Guide", "iv", "- 7 -", "Annual Report 2024", "1 2 3", "Part A 3 xi"]
    keys = column(spark, [x.split(" ") for x in lines], tk.line_key, "array<string>")
    assert keys == ["Page # of", "Fee Guide", "#", "- # -", "Annual Report", "# # #", "Part A"]


def test_rejections(spark):
    cases = [("", 1, "clause-initial"), ("fees, ", 1, "sub-clause-enumerator"), ("202(a)", 11, "statutory-citation"), ("aside) ", 1, None), ("202", 1, "attached-to-number"), ("two ", 2, "spelled-number-gloss"), ("of the ", 3, "function-word"), ("Fee … ", 1, "no-anchor"), ("Fee ", 1, None)]
    df = spark.createDataFrame([(i, b, n) for i, (b, n, _) in enumerate(cases)], "i int, b string, n int")
    found = [r.r for r in sorted(df.select("i", tk.rejection(F.col("b"), F.col("n")).alias("r")).collect())]
    assert found == [c[2] for c in cases]


def test_snapping_compares_with_the_last_edge_kept(spark):
    assert column(spark, [[0.0, 0.4, 0.8], [], [3.0, 1.0]], tables.snapped, "array<double>") == [[0.0, 0.8], [], [1.0, 3.0]]


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_turns_go_back(spark, rotation):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 60.0)], "x0 double, y0 double, x1 double, y1 double")
    turned = geo.turn_rect(F.lit(rotation), geo.box(), F.lit(100.0), F.lit(200.0))
    df = df.select("*", *(c.alias(f"t{n}") for c, n in zip(turned, ("x0", "y0", "x1", "y1"), strict=True)))
    back = geo.unturn_rect(F.lit(rotation), geo.box("t"), F.lit(100.0), F.lit(200.0))
    assert tuple(df.select(*back).first()) == (10.0, 20.0, 30.0, 60.0)


def test_hyphen_closes_before_a_small_letter(spark):
    docs = spark.createDataFrame([(1, "x " * 40 + "inter-\nnational")], "doc_id long, text string")
    lines = ts.prose_lines(ts.prose_words(docs))
    # the two paragraphs stand as lines of one block once the space between them is taken out
    lines = lines.withColumn("top", F.lit(90.0) + 10.8 * F.col("line")).withColumn("bottom", F.col("top") + 10).withColumn("size", F.lit(10.0)).withColumn("bold", F.lit(False))
    found = prose.blocks(lines, ts.prose_words(docs)).collect()
    assert any(re.search(r"international$", b.text) for b in found)


def test_broken_documents_are_counted(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(20)
    words = ts.prose_words(docs)
    lines = ts.prose_lines(words)
    blocks = prose.blocks(lines, words)
    found = {r.rule: r.violations for r in checks.document_checks(words.where("id <> 3"), blocks.withColumn("key", F.concat("key", F.lit("0"))), lines).collect()}
    assert found["word_ids"] > 0 and found["block_keys"] > 0 and found["text_spelling"] > 0 and found["word_partition"] == 0


def test_resolution_is_forward_only(spark):
    sites = spark.createDataFrame([(1, 1, 5, 1, "1"), (1, 2, 5, 1, "2"), (1, 3, 9, 1, "1")], "doc int, site int, `order` int, page int, label string")
    notes = spark.createDataFrame([(1, "1", 2, 1), (1, "1", 8, 2), (1, "2", 99, 40)], "doc int, label string, `order` int, page int")
    assert {r.site: r.note for r in links.resolve(sites, notes).collect()} == {1: 8, 2: 99, 3: None}


def test_a_chain_of_tables_is_followed_to_its_end(spark):
    chain = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 7, 8)], "doc int, page int, next_page int")
    assert {r.page: r.through for r in links.chains(chain).collect()} == {1: 3, 2: 3, 7: 8}
