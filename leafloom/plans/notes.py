"""Queries of glossaries, notes and calls over planted blocks, with SQL that states what each is."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.operators import notes
from leafloom.plans.registry import Registry, dealt, table, values

R = Registry()

#: Items of a document: (kind, level, text, whether it lies in a definitions section)
_SCOPES = [
    [("heading", 1, "1. Definitions", True), ("paragraph", None, "a", True), ("heading", 2, "Terms", True), ("paragraph", None, "b", True), ("heading", 1, "2. Fees", False), ("paragraph", None, "c", False)],
    [("paragraph", None, "a", False), ("heading", 2, "Glossary", True), ("heading", 3, "Abbreviations", True), ("heading", 3, "Other", True), ("heading", 2, "More", False), ("heading", 1, "Top", False)],
    [("heading", 3, "Definitions", True), ("heading", 3, "Interpretation", True), ("paragraph", None, "a", True), ("heading", 2, "Legend", True), ("heading", 3, "x", True), ("heading", 1, "y", False)],
    [("heading", 1, "Plain", False), ("paragraph", None, "Definitions", False)],
]


@R.add(f"SELECT p_partkey AS doc, s.nth, s.in_scope FROM part JOIN (VALUES {values([(i, n, x[3]) for i, items in enumerate(_SCOPES) for n, x in enumerate(items)])}) s(i, nth, in_scope) ON p_partkey % {len(_SCOPES)} = s.i")
def glossary_scopes(spark, sf):
    """Definitions sections within one another, ended by headings of their level or a higher one."""
    d = dealt(spark, sf, [([x[:3] for x in items],) for items in _SCOPES], "items array<struct<kind:string,level:int,text:string>>")
    return notes.in_scope(d.select("doc", F.posexplode("items").alias("nth", "i")).select("doc", "nth", "i.*")).select("doc", "nth", "in_scope")


def _line(text: str, bold: int = 0, italic: int = 0) -> list:
    return [(w, i < bold, i < italic) for i, w in enumerate(text.split())]


_PARTS = [(72.0, 110.0, 2), (140.0, 300.0, 5)]
_WIDE = [(72.0, 300.0, 8)]
#: (kind, in scope, first line, its fragments, the other lines' starts, words of the term)
_TERMS = [
    ("paragraph", False, _line("“Fee” means the price"), _WIDE, [], 1),
    ("paragraph", False, _line("“Fee” is high today"), _WIDE, [], 0),
    ("paragraph", True, _line("“Fee” is high today"), _WIDE, [], 1),
    ("list_item", True, _line("“Fee” means the price"), _WIDE, [], 0),
    ("paragraph", True, _line("Available Funds are those", bold=2), _WIDE, [], 2),
    ("paragraph", True, _line("Trading day of the week", italic=2), _WIDE, [], 2),
    ("paragraph", True, _line("All bold words", bold=3), _WIDE, [], 0),
    ("paragraph", False, _line("Available Funds are those", bold=2), _WIDE, [], 0),
    ("paragraph", True, _line("Base fee is what one pays"), _PARTS, [140.0, 141.0], 2),
    ("paragraph", True, _line("Base fee is what one pays"), _PARTS, [72.0], 0),
    ("paragraph", True, _line("1 Trade activity is what"), [(72.0, 78.0, 1), (140.0, 300.0, 4)], [], 0),
]


@R.add(f"SELECT p_partkey AS doc, t.term::INT AS term FROM part JOIN (VALUES {values([(i, x[5]) for i, x in enumerate(_TERMS)])}) t(i, term) ON p_partkey % {len(_TERMS)} = t.i")
def defined_terms(spark, sf):
    """Quoted, bold, italic and hanging terms, inside and outside a definitions section."""
    d = dealt(spark, sf, [x[:5] for x in _TERMS], "kind string, in_scope boolean, first array<struct<text:string,bold:boolean,italic:boolean>>, parts array<struct<x0:double,x1:double,n:bigint>>, later array<double>")
    return notes.definitions(d.withColumn("words", F.transform("first", lambda w: w.text)).withColumn("size", F.lit(10.0))).select("doc", "term")


def _cell(row: int, col: int, text: str, span: int = 1) -> tuple:
    return row, col, span, [(w, False) for w in text.split()]


#: (in scope, cells, the blocks: row, kind, label)
_GRIDS = [
    (False, [_cell(0, 0, "1"), _cell(0, 1, "The first note here"), _cell(1, 0, "(a)"), _cell(1, 1, "The second note here")], [(0, "footnote", "1"), (1, "footnote", "a")]),
    (False, [_cell(0, 0, "Fee"), _cell(0, 1, "What a client pays")], []),
    (True, [_cell(0, 0, "Fee"), _cell(0, 1, "What a client pays"), _cell(1, 0, "More words", 2)], [(0, "definition", None), (1, "heading", None)]),
    (False, [_cell(0, 0, "Glossary", 2), _cell(1, 0, "Fee"), _cell(1, 1, "What a client pays")], [(0, "heading", None), (1, "definition", None)]),
    (True, [_cell(0, 0, "Fee"), _cell(0, 1, "$5.00 for each contract")], []),
    (True, [_cell(0, 0, "$5.00"), _cell(0, 1, "What a client pays")], []),
    (False, [_cell(0, 0, "x!"), _cell(0, 1, "A marked note stands here")], [(0, "footnote", "x!")]),
    (True, [_cell(0, 0, "Only a banner", 2)], []),
]


@R.add(f"SELECT p_partkey AS doc, 0 AS tbl, g.r::INT AS \"row\", g.kind, g.label FROM part JOIN (VALUES {values([(i, *b) for i, x in enumerate(_GRIDS) for b in x[2]])}) g(i, r, kind, label) ON p_partkey % {len(_GRIDS)} = g.i")
def dissolved_grids(spark, sf):
    """Grids of labels and notes, of terms and definitions, and of fees, which stay tables."""
    d = dealt(spark, sf, [x[:2] for x in _GRIDS], "in_scope boolean, cells array<struct<row:int,col:int,col_span:int,words:array<struct<text:string,superscript:boolean>>>>")
    c = d.select("doc", F.lit(0).alias("tbl"), "in_scope", F.explode("cells").alias("c")).select("doc", "tbl", "in_scope", "c.*", F.lit(1).alias("row_span"), F.lit(2).alias("n_cols"))
    return notes.dissolved(c, d.select("doc", F.lit("x!").alias("text")))


def _sized(text: str, label: float, rest: float = 10.0, bold: bool = False, raised: bool = False) -> list:
    return [(w, label if i == 0 else rest, bold, raised and i == 0) for i, w in enumerate(text.split())]


#: (kind, first line, the note's label)
_NOTES = [
    ("paragraph", _sized("1. The note says more", 9.0), "1"),
    ("paragraph", _sized("1. The note says more", 10.0), None),
    ("paragraph", _sized("1 The note says more", 10.0), "1"),
    ("list_item", _sized("* The note says more", 10.0), "*"),
    ("heading", _sized("1 The note says more", 9.0), None),
    ("paragraph", _sized("2 The note says more", 9.0), None),
    ("paragraph", _sized("1 The note", 9.0), None),
    ("paragraph", _sized("1 The note says more", 13.0, 14.0), None),
    ("paragraph", _sized("1 The note says more", 9.0, bold=True), None),
    ("paragraph", _sized("1 The note says more", 9.0, raised=True), None),
]


@R.add(f"SELECT p_partkey AS doc, n.note FROM part JOIN (VALUES {values([(i, x[2]) for i, x in enumerate(_NOTES)])}) n(i, note) ON p_partkey % {len(_NOTES)} = n.i")
def opened_notes(spark, sf):
    """Paragraphs that called labels open, by their sizes."""
    d = dealt(spark, sf, [x[:2] for x in _NOTES], "kind string, first array<struct<text:string,size:double,bold:boolean,superscript:boolean>>")
    called = notes.call_labels(d.select("doc", F.lit("1,*").alias("text"), F.lit(True).alias("superscript")))
    return notes.notes(d.withColumn("body", F.lit(10.0)), called).select("doc", "note")


#: (cells: row, col, text; the blocks)
_LISTS = [
    ([(0, 0, "Notes:"), (1, 0, "1"), (1, 1, "first note"), (2, 0, "2."), (2, 1, "second note")], [(0, "heading", None), (1, "footnote", "1"), (2, "footnote", "2")]),
    ([(0, 0, "Fees"), (1, 0, "1"), (1, 1, "first note"), (2, 0, "2"), (2, 1, "second note")], []),
    ([(0, 0, "Notes"), (1, 0, "1"), (1, 1, "first note")], []),
    ([(0, 0, "Notes"), (1, 0, "1"), (1, 1, "first note"), (2, 0, "2"), (2, 1, "$5.00")], []),
    ([(0, 0, "Notes"), (1, 0, "1"), (1, 1, "first note"), (2, 0, "two words"), (2, 1, "second note")], []),
]


@R.add(f"SELECT p_partkey AS doc, 0 AS tbl, g.r::INT AS \"row\", g.kind, g.label FROM part JOIN (VALUES {values([(i, *b) for i, x in enumerate(_LISTS) for b in x[1]])}) g(i, r, kind, label) ON p_partkey % {len(_LISTS)} = g.i")
def note_grids(spark, sf):
    d = dealt(spark, sf, [(x[0],) for x in _LISTS], "cells array<struct<row:int,col:int,text:string>>")
    c = d.select("doc", F.lit(0).alias("tbl"), F.explode("cells").alias("c")).select("doc", "tbl", "c.row", "c.col", F.lit(1).alias("header_rows"), F.split("c.text", " ").alias("words"))
    return notes.note_grids(c)


#: Blocks of a document: (order, page, kind, label, text, superscripts by place); its notes: (label, order, page); calls: (order, label, method, status, note)
_CALLS = [
    (
        [(0, 1, "paragraph", None, "Pay 1 now 1 (2) or see footnote 3", (1, 3)), (1, 2, "paragraph", None, "Rate, (2) of 4 it", (3,)), (2, 2, "footnote", "1", "1 The note (1) itself", ()), (3, 2, "footnote", "2", "2 Another", ()), (4, 9, "footnote", "4", "4 Far off", ())],
        [(0, "1", "superscript", "resolved", 2), (0, "2", "parenthetical", "resolved", 3), (0, "3", "named", "unresolved", None), (1, "2", "parenthetical", "rejected", None), (1, "4", "superscript", "resolved", 4)],
    ),
    (
        [(0, 1, "paragraph", None, "Pay 1 now 5", (1, 3)), (1, 5, "footnote", "1", "1 The note", ()), (2, 6, "footnote", "1", "1 Again", ())],
        [(0, "1", "superscript", "unresolved", None), (0, "5", "superscript", "unresolved", None)],
    ),
]


def _sites(spark, sf):
    d = dealt(spark, sf, [(b,) for b, _ in _CALLS], "blocks array<struct<order:int,page:int,kind:string,label:string,text:string,raised:array<int>>>")
    b = d.select("doc", F.explode("blocks").alias("b")).select("doc", "b.*", F.lit(None).cast("string").alias("cell"))
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), F.array_contains("raised", i).alias("superscript"), F.col("page").alias("page")))
    printed = b.where("kind = 'footnote'").select("doc", "label", "order", "page")
    return notes.call_links(notes.calls_in(b.withColumn("words", words), printed.select("doc", "label").distinct()), printed)


@R.add(f"SELECT p_partkey AS doc, c.o::INT AS \"order\", c.label, c.method, c.status, coalesce(c.note, -1)::INT AS note FROM part JOIN (VALUES {values([(i, *c) for i, x in enumerate(_CALLS) for c in x[1]])}) c(i, o, label, method, status, note) ON p_partkey % {len(_CALLS)} = c.i")
def footnote_calls(spark, sf):
    """Calls by superscript, parenthesis and name; rejected by a convention, resolved forward, or to no note."""
    return _sites(spark, sf).select("doc", "order", "label", "method", "status", F.coalesce("note", F.lit(-1)).alias("note"))


@R.add(f"SELECT p_partkey AS doc, 1 AS page, CASE WHEN p_partkey % {len(_CALLS)} = 0 THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN p_partkey % {len(_CALLS)} = 0 THEN '3' ELSE '1, 5' END AS labels FROM part")
def unresolved_calls(spark, sf):
    return notes.unresolved(_sites(spark, sf))


@R.add("""SELECT p_partkey AS doc, r AS "row", c AS col, r < 2 AS carried, CASE r WHEN 0 THEN 'h' WHEN 1 THEN 'k' ELSE 'v' END || c AS text, round(CASE r WHEN 0 THEN 100 - 30 * s WHEN 1 THEN 100 - 20 * s WHEN 2 THEN 100 ELSE 110 END, 6)::DOUBLE AS y0, round(CASE r WHEN 0 THEN 100 - 20 * s WHEN 1 THEN 100 WHEN 2 THEN 110 ELSE 125 END, 6)::DOUBLE AS y1
    FROM (SELECT p_partkey, least(1.0, (1 + p_size % 40) / 30.0)::DOUBLE AS s FROM part), range(4) a(r), range(2) b(c)""")
def carried_headers(spark, sf):
    """Two header rows of 10 and 20 points over a table that goes on, scaled where there is less room."""
    cells = lambda names, rows: F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(1).alias("rows"), F.lit(1).alias("cols"), F.lit(f"{names[r]}{c}").alias("text")) for r in range(rows) for c in range(2)))
    edges = lambda *v: F.array(*map(F.lit, v))
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), edges(100.0, 110.0, 125.0).alias("row_edges"), (F.lit(99.0) - F.col("p_size") % 40).alias("ceiling"), cells("vv", 2).alias("cells"), edges(50.0, 60.0, 80.0, 90.0).alias("parent_edges"), F.lit(2).alias("header_rows"), cells("hkx", 3).alias("parent_cells"))
    return notes.carried(t).select("doc", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "carried", "text", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))
