"""Pages of words to a document.

Every stage claims words: furniture, ruled grids, tables found among lines, lists of notes that were set as tables, and prose.
Where stages claim one word, the first in ``STAGES`` has it; a word that none claims is a fault. What claimed words together is
a block. Blocks are put in reading order, keyed, and linked: tables that go on over a page, and calls of notes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.config import Lexicon, Profile
from leafloom.functions import tokens as tk
from leafloom.operators import furniture, grids, layout, notes, pagetables, prose, reader, ruled
from leafloom.sources.stored import kept as stored

STAGES = ("furniture", "grid", "corridor", "prose")
EDGES_APART = 3.0  # fixed value: how far the columns of tables that go on may be apart

DOC, PAGE = ["doc_id"], ["doc_id", "page"]
THING = ["doc_id", "page", "stage", "thing"]
SPOT = [*THING, "row", "col"]


@dataclass
class Document:
    """The frames of many documents."""

    words: DataFrame  # as given, with line (as the page is read), and block
    blocks: DataFrame  # doc_id, page, block, kind, label, text, key and measures; kind furniture for running heads, feet and numbers
    ledger: DataFrame  # doc_id, content_chars, furniture_chars and the counts of the pages
    findings: DataFrame  # doc_id, page, code, severity
    cells: DataFrame  # doc_id, page, block, row, col, rows, cols, text, words, box, and the table's header_rows
    links: DataFrame  # doc_id, kind, source, row, col, target, label, method, status, reason
    claims: DataFrame  # doc_id, page, id, stage, thing, row, col, nth: the one claim that each word has
    joins: DataFrame  # doc_id, block, a, b: the words between which a hyphen went
    members: DataFrame  # doc_id, block, words (ids in order), markers (raised marks)


def settled(claims: DataFrame) -> DataFrame:
    """Of each word's claims the first, by stage. claims: doc_id, page, id, stage (its place in STAGES), thing, row, col, nth."""
    order = Window.partitionBy("doc_id", "id").orderBy("stage", "thing", "row", "col")
    return claims.withColumn("first", F.row_number().over(order)).where("first = 1").drop("first")


def unclaimed(words: DataFrame, claims: DataFrame) -> DataFrame:
    """The words that no stage claims: none, if the document is whole."""
    return words.join(claims.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def _claim(words: DataFrame, stage: str, thing: str | Column, row: Column | None = None, col: Column | None = None, nth: str | Column = "place") -> DataFrame:
    none = F.lit(None).cast("long")
    pick = lambda c: (F.col(c) if isinstance(c, str) else none if c is None else c).cast("long")
    return words.select(*PAGE, "id", F.lit(STAGES.index(stage)).alias("stage"), pick(thing).alias("thing"), pick(row).alias("row"), pick(col).alias("col"), pick(nth).alias("nth"))


def measured(words: DataFrame) -> DataFrame:
    """doc_id, page, line, x0, x1, top, bottom, size, bold, n_words, text of each line."""
    tokens = F.array_sort(F.collect_list(F.struct("place", "text")))
    return words.groupBy("doc_id", "page", "line").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.median("size").alias("size"),
        (F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)) * 2 >= F.sum(F.length("text"))).alias("bold"),
        F.count("*").alias("n_words"), F.array_join(F.transform(tokens, lambda t: t.text), " ").alias("text"),
    )


def lined(words: DataFrame, bodies: DataFrame, profile: Profile) -> DataFrame:
    """words with region, line (numbered over the document in reading order) and place."""
    found = layout.page_regions(words, bodies, profile)
    order = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", "region", "line"))
    return words.join(found.select(*PAGE, "id", "region", "place", (order - 1).cast("long").alias("line")).hint("merge"), [*PAGE, "id"])


def _flags(words: DataFrame) -> DataFrame:
    for name, value in (("superscript", False), ("horizontal", True), ("italic", False)):
        if name not in words.columns:
            words = words.withColumn(name, F.lit(value))
    return words.select(*PAGE, "id", "x0", "y0", "x1", "y1", "text", "size", "bold", "superscript", "horizontal", "italic")


def assemble(words: DataFrame, pages: DataFrame, profile: Profile | None = None, lexicon: Lexicon | None = None, rules: DataFrame | None = None) -> Document:
    """words: doc_id, page, id, x0, y0, x1, y1, text, size, bold and, if known, superscript, italic, horizontal; pages: doc_id, page, height, invisible, clipped, overprinted; rules: doc_id, page, axis, at, start, end.

    Lines are found anew from the words' boxes, and raised marks from their lines where the words don't tell of them. Frames that several others are made of are stored once.
    """
    p = profile or Profile()
    known = "superscript" in words.columns
    words = _flags(words)
    drawn = rules if rules is not None else _no_rules(words)
    bodies = stored(prose.body_size(words))
    first = lined(words, bodies, p)
    if not known:
        first = reader.raised(first)
    first = stored(first)
    words = first.drop("region", "line", "place")
    lines = stored(measured(first))

    # furniture; lines that a ruled table holds are none
    keep = stored if rules is not None else (lambda df: df)  # without rules these are known to be empty when they are planned
    cells, failed = ruled.ruled_grids(drawn)
    cells = keep(cells)
    tabled = furniture.tabled_lines(first, cells.withColumn("tbl", F.col("grid")), p).withColumn("tabled", F.lit(True)).hint("merge")
    parts = prose.fragments(first.drop("id").withColumnRenamed("place", "id"), p).groupBy(*PAGE, "line").agg(F.count("*").alias("parts"))
    height = pages.select(*PAGE, F.col("height").alias("page_height")).hint("merge")
    candidates = lines.join(parts, [*PAGE, "line"]).join(height, PAGE).join(tabled, [*PAGE, "line"], "left").withColumn("tabled", F.coalesce("tabled", F.lit(False)))
    marked = stored(furniture.find_furniture(candidates, p).select(*PAGE, "line", "key", "role"))
    aside = first.join(marked.select(*PAGE, "line"), [*PAGE, "line"], "left_semi")
    content = first.join(marked.select(*PAGE, "line"), [*PAGE, "line"], "left_anti")

    # ruled grids, over what is content
    taken, inside = ruled.accepted(cells, content)
    taken, inside = keep(taken), keep(inside)

    # the rest is read anew: columns beside a grid are columns of their own
    rest = content.join(inside.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    second = stored(lined(rest.drop("region", "line", "place"), bodies, p)) if rules is not None else rest
    found = pagetables.page_tables(second.select(*PAGE, "region", "line").distinct(), second, drawn, p, inside)
    tables = stored(found.grids)
    left = second.join(stored(found.left).select(*PAGE, "line", "part"), [*PAGE, "line"])
    typed = prose.blocks(measured(left).join(left.select(*PAGE, "line", "part").distinct().hint("merge"), [*PAGE, "line"]), words, p, lexicon)

    # the ledger of claims
    in_tables = tables.select(*PAGE, "table", F.explode("cells").alias("c")).select(*PAGE, "table", "c.row", "c.col", F.posexplode("c.words").alias("place", "id"))
    ordered = F.row_number().over(Window.partitionBy(*ruled.GRID, "row", "col").orderBy("line", "place"))
    flowing = F.col("line") * 100_000 + F.col("place")
    homes = left.join(_homes(typed, left).hint("merge"), [*PAGE, "line"])
    claims = reduce(DataFrame.unionByName, [
        _claim(aside, "furniture", "line"),
        _claim(inside.withColumn("place", ordered), "grid", "grid", F.col("row"), F.col("col")),
        _claim(in_tables, "corridor", "table", F.col("row"), F.col("col")),
        _claim(homes, "prose", "block", nth=flowing),
    ])
    held = stored(settled(claims).join(words.drop("page"), ["doc_id", "id"]))
    return _linked(words, first, held, typed, marked, taken, tables, failed, found.findings, pages, bodies, p)


def _no_rules(words: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return words.limit(0).select(*PAGE, F.lit("h").alias("axis"), zero.alias("at"), zero.alias("start"), zero.alias("end"))


def _homes(typed: DataFrame, left: DataFrame) -> DataFrame:
    """page, line and block of each line of prose: a block has the lines from its first on, up to the next one's."""
    begins = typed.select("doc_id", F.col("first_line").alias("line"), "block").hint("merge")
    every = left.select(*PAGE, "line").distinct().join(begins, ["doc_id", "line"], "left")
    return every.select(*PAGE, "line", F.last("block", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line")).alias("block"))


def table_cells(held: DataFrame, taken: DataFrame, tables: DataFrame) -> DataFrame:
    """THING, row, col, rows, cols, box, words (in order), text, valued and bold of every cell, filled or not, with n_rows and header_rows of its table."""
    grid = taken.select(*PAGE, F.lit(1).alias("stage"), F.col("grid").alias("thing"), "row", "col", "rows", "cols", "x0", "y0", "x1", "y1")
    e = lambda edges, i: F.get(edges, i.cast("int"))
    size = tables.select(*PAGE, F.lit(2).alias("stage"), F.col("table").alias("thing"), "rows", "cols", "cells")
    each = size.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.size("rows") - 2)))
    own = F.filter("cells", lambda c: c.row == F.col("r"))
    spots = F.sequence(F.lit(0).cast("long"), F.size("cols").cast("long") - 2)
    free = F.filter(spots, lambda k: ~F.exists(F.col("own"), lambda c: (c.col <= k) & (k < c.col + c.cols)))
    both = each.withColumn("own", own).withColumn("all", F.concat(F.transform("own", lambda c: F.struct(c.col.alias("col"), c.cols.alias("span"))), F.transform(free, lambda k: F.struct(k.alias("col"), F.lit(1).cast("long").alias("span")))))
    corridor = both.select(*THING, F.col("r").alias("row"), "rows", "cols", F.explode("all").alias("c")).select(
        *THING, "row", F.col("c.col").alias("col"), F.lit(1).cast("long").alias("rows"), F.col("c.span").alias("cols"), e(F.col("cols"), F.col("c.col")).alias("x0"), e(F.col("rows"), F.col("row")).alias("y0"), e(F.col("cols"), F.col("c.col") + F.col("c.span")).alias("x1"), e(F.col("rows"), F.col("row") + 1).alias("y1")
    )
    word = F.struct("nth", "id", "text", "superscript", "bold", "size")
    texts = held.where("row is not null").groupBy(*SPOT).agg(F.array_sort(F.collect_list(word)).alias("held"))
    every = grid.unionByName(corridor).join(texts.hint("merge"), SPOT, "left").withColumn("held", F.coalesce("held", F.array().cast(texts.schema["held"].dataType)))
    text = F.array_join(F.transform("held", lambda w: w.text), " ")
    chars = lambda test: F.aggregate("held", F.lit(0), lambda s, w: s + F.when(test(w), F.length(w.text)).otherwise(0))
    every = every.withColumn("text", text).withColumn("valued", tk.is_strong_value(F.col("text")) | (tk.is_value(F.col("text")) & F.col("text").rlike("[0-9]"))).withColumn("bold", 2 * chars(lambda w: w.bold) >= chars(lambda w: F.lit(True)))
    role = F.struct("row", "col", "rows", (F.size("held") > 0).alias("filled"), "valued", "bold")
    roles = every.groupBy(*THING).agg(F.array_sort(F.collect_list(role)).alias("cells"), F.max(F.col("row") + F.col("rows")).alias("n_rows"))
    found = roles.select(*THING, "n_rows", grids.table_roles("cells", F.col("n_rows").cast("int")).alias("r")).select(*THING, "n_rows", F.col("r.header").cast("long").alias("header_rows"), F.transform("r.banners", lambda b: b.cast("long")).alias("banner_rows"))
    return every.join(found.hint("merge"), THING)


def _listed(cells: DataFrame) -> DataFrame:
    """THING, row, kind, label of the tables that are lists of notes: their rows become blocks."""
    c = cells.select(F.col("doc_id").alias("doc"), F.struct(*THING).alias("tbl"), "row", "col", "header_rows", F.transform("held", lambda w: w.text).alias("words"))
    return notes.note_grids(c).select("tbl.*", "row", "kind", "label")


def _linked(words, first, held, typed, marked, taken, tables, failed, told, pages, bodies, p: Profile) -> Document:
    cells = stored(table_cells(held, taken, tables))
    listed = stored(_listed(cells))
    # a row of a list is a block of its own
    one = listed.select(*THING, F.col("row").alias("part"), F.col("kind").alias("row_kind"), F.col("label").alias("row_label"))
    mine = held.withColumn("part", F.when(F.col("stage").isin(1, 2), F.col("row"))).join(one, [*THING, "part"], "left").withColumn("part", F.when(F.col("row_kind").isNotNull(), F.col("part")))
    whole = [*THING, "part"]
    order = F.struct("row", "col", "nth", "id")
    members = stored(mine.withColumn("order", order))
    w = F.struct("order", "id", "text", "superscript", "size", "bold", "italic", "page", "x0", "x1")
    g = members.groupBy(*THING, F.coalesce("part", F.lit(-1)).alias("part")).agg(
        F.array_sort(F.collect_list(w)).alias("held"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.first("row_kind", ignorenulls=True).alias("row_kind"), F.first("row_label", ignorenulls=True).alias("row_label"),
    )
    lines = cells.where("text <> ''").groupBy(*THING, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c.text), " ").alias("line"))
    table_text = lines.groupBy(*THING).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r.line), "\n").alias("table_text"))
    facts = typed.select(*PAGE, F.lit(3).alias("stage"), F.col("block").alias("thing"), "kind", "label", "size", "n_lines", "first_line", F.col("text").alias("prose_text"))
    roles = marked.select(*PAGE, F.lit(0).alias("stage"), F.col("line").alias("thing"), "role")
    d = g.join(table_text.hint("merge"), THING, "left").join(facts.hint("merge"), THING, "left").join(roles.hint("merge"), THING, "left")
    joined = F.array_join(F.transform("held", lambda x: x.text), " ")
    table = F.col("stage").isin(1, 2) & (F.col("part") < 0)
    d = d.withColumn("text", F.when(table, F.col("table_text")).otherwise(F.coalesce("prose_text", joined)))
    d = d.withColumn("kind", F.when(F.col("stage") == 0, "furniture").when(table, "table").otherwise(F.coalesce("row_kind", "kind"))).withColumn("label", F.coalesce("row_label", "label"))
    d = _as_notes(stored(d.drop("table_text", "prose_text", "row_kind", "row_label")), members, bodies)

    # reading order: content with its tables by page, furniture about it
    place = F.struct(F.col("page").alias("p"), F.col("stage").alias("s"), F.col("thing").alias("t"), F.col("part").alias("r"))
    d = d.withColumn("item", place)
    flow = F.row_number().over(Window.partitionBy(*PAGE).orderBy("thing")) - 1
    prose_, set_ = d.where("stage = 3"), d.where("stage in (1, 2)")
    nth = layout.reading_order(prose_.select(*PAGE, F.col("item").alias("id"), flow.alias("nth"), "x0", "x1", "top"), set_.select(*PAGE, F.col("item").alias("id"), "x0", F.col("top").alias("y0"), "x1"))
    content = nth.select("doc_id", "page", "id", F.lit("content").alias("role"), F.col("nth").cast("double").alias("place"))
    edge = d.where("stage = 0").select("doc_id", "page", F.col("item").alias("id"), "role", F.col("top").alias("place"))
    numbered = layout.document_order(content.unionByName(edge)).select("doc_id", F.col("id").alias("item"), F.col("nth").alias("block"))
    d = stored(d.join(numbered, ["doc_id", "item"]))

    key0 = tk.content_key(F.col("kind"), F.col("text"))
    twin = F.row_number().over(Window.partitionBy("doc_id", "key0").orderBy("block"))
    d = d.withColumn("key0", key0).withColumn("key", F.when(twin == 1, F.col("key0")).otherwise(F.concat("key0", F.lit(":"), twin.cast("string"))))
    at = lambda i: F.element_at("held", i).text
    blocks = d.select(
        "doc_id", "page", "block", "kind", "label", "size", F.coalesce("n_lines", F.lit(1)).cast("long").alias("n_lines"), F.size("held").cast("long").alias("n_words"), F.coalesce("first_line", F.when(F.col("stage") == 0, F.col("thing"))).alias("first_line"),
        "x0", "x1", "top", "bottom", at(1).alias("first"), at(-1).alias("last"), "text", "key", F.transform("held", lambda x: x.id).alias("words"), F.transform(F.filter("held", lambda x: x.superscript), lambda x: x.text).alias("markers"),
    )
    blocks = stored(blocks)
    of = d.select(*THING, "part", "block")
    in_block = cells.join(of.where("part < 0").drop("part"), THING).join(listed.select(*THING).distinct(), THING, "left_anti")
    out_cells = in_block.select(*PAGE, "block", "row", "col", "rows", "cols", "text", F.transform("held", lambda x: x.id).alias("words"), F.transform("held", lambda x: F.struct(x.text.alias("text"), x.superscript.alias("superscript"))).alias("marks"), "x0", "y0", "x1", "y1", "n_rows", "header_rows", "banner_rows")
    out_cells = stored(out_cells)
    calls, open_calls = _calls(blocks, out_cells, d)
    every_link = calls.unionByName(_continued(blocks, out_cells))
    homed = words.join(held.select("doc_id", "id", *THING[2:], "row"), ["doc_id", "id"], "left")
    listed_rows = of.where("part >= 0").withColumnsRenamed({"part": "row", "block": "row_block"})
    homed = homed.join(of.where("part < 0").drop("part"), THING, "left").join(listed_rows, [*THING, "row"], "left").withColumn("block", F.coalesce("row_block", "block")).drop("row_block", "row", "stage", "thing")
    homed = homed.join(first.select("doc_id", "id", "line", "place"), ["doc_id", "id"])
    n = F.length("text")
    chars = held.groupBy("doc_id").agg(F.sum(F.when(F.col("stage") > 0, n).otherwise(0)).alias("content_chars"), F.sum(F.when(F.col("stage") == 0, n).otherwise(0)).alias("furniture_chars"))
    counts = pages.groupBy("doc_id").agg(*(F.sum(c).alias(f"{c}_chars") for c in ("invisible", "clipped", "overprinted")))
    none = F.lit(None).cast("long")
    long = furniture.long_without(pages, marked, p).select("doc_id", none.alias("page"), F.lit("no_furniture_long_document").alias("code"), F.lit("warning").alias("severity"))
    of_page = failed.unionByName(told).unionByName(_crossed(out_cells, held)).select("doc_id", F.col("page").cast("long").alias("page"), "code", "severity")
    lost = open_calls.select("doc_id", F.col("page").cast("long").alias("page"), F.lit("call_unresolved").alias("code"), F.lit("warning").alias("severity"))
    members_ = blocks.select("doc_id", "block", "words", "markers")
    return Document(homed, blocks.drop("words", "markers"), counts.join(chars.hint("merge"), "doc_id", "left").na.fill(0), long.unionByName(of_page).unionByName(lost), out_cells, every_link, held.select(*PAGE, "id", "stage", "thing", "row", "col", "nth"), _line_joins(members, d), members_)


def _as_notes(d: DataFrame, members: DataFrame, bodies: DataFrame) -> DataFrame:
    """Paragraphs and items that a called label opens are footnotes."""
    marks = members.select(F.col("doc_id").alias("doc"), "text", "superscript")
    called = stored(notes.call_labels(marks))
    # the words of the first line: those on the line of the first word
    line = lambda x: F.floor(x.order.nth / 100_000)
    opening = F.filter("held", lambda x: line(x) == line(F.get("held", 0)))
    given = d.where("stage = 3").join(bodies, "doc_id").select(F.col("doc_id").alias("doc"), "page", "stage", "thing", "part", "kind", "body", F.transform(opening, lambda x: F.struct(x.text.alias("text"), x.size.alias("size"), x.bold.alias("bold"), x.superscript.alias("superscript"))).alias("first"))
    found = notes.notes(given, called).where("note is not null").select(F.col("doc").alias("doc_id"), "page", "stage", "thing", "part", "note")
    out = d.join(found, [*THING, "part"], "left")
    return out.withColumn("kind", F.when(F.col("note").isNotNull(), "footnote").otherwise(F.col("kind"))).withColumn("label", F.coalesce("note", "label")).drop("note")


def _calls(blocks: DataFrame, cells: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links from what calls a note to the note, and the pages with calls of none."""
    spot = F.struct("row", "col")
    none = F.lit(None).cast("struct<row:bigint,col:bigint>")
    word = lambda x: F.struct(x.text.alias("text"), x.superscript.alias("superscript"), x.page.alias("page"))
    own = d.where("kind not in ('furniture', 'table')").select(F.col("doc_id").alias("doc"), F.col("block").alias("order"), none.alias("cell"), "page", "kind", F.when(F.col("kind") == "footnote", F.col("label")).alias("label"), "text", F.transform("held", word).alias("words"))
    page = F.col("page")
    inner = cells.where("text <> ''").select(F.col("doc_id").alias("doc"), F.col("block").alias("order"), spot.alias("cell"), "page", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("label"), "text", F.transform("marks", lambda x: F.struct(x.text.alias("text"), x.superscript.alias("superscript"), page.alias("page"))).alias("words"))
    noted = blocks.where("kind = 'footnote' and label is not null").select(F.col("doc_id").alias("doc"), "label", F.col("block").alias("order"), "page")
    sites = notes.calls_in(own.unionByName(inner), noted.select("doc", "label").distinct())
    found = stored(notes.call_links(sites, noted))
    out = found.select(F.col("doc").alias("doc_id"), F.lit("footnote_call").alias("kind"), F.col("order").alias("source"), "cell.row", "cell.col", F.col("note").alias("target"), "label", "method", "status", "reason")
    return out, notes.unresolved(found).withColumnRenamed("doc", "doc_id")


def _continued(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Links from a table that is first on its page to the one that is last on the page before, where their columns agree."""
    flow = blocks.where("kind not in ('furniture', 'footnote')")
    ends = flow.groupBy(*PAGE).agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    edges = F.array_sort(F.array_union(F.collect_set("x0"), F.collect_set("x1")))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row") < F.col("header_rows"), F.struct("row", "col", "text")))), lambda h: h.text), "\t")
    facts = cells.groupBy(*PAGE, "block").agg(edges.alias("edges"), F.when(F.max("header_rows") > 0, head).alias("header"))
    # a page has one table that is first and one that is last, perhaps the same
    at = facts.join(ends.hint("merge"), PAGE).where("block = b0 or block = b1")
    last = at.where("block = b1").select("doc_id", "page", F.col("block").alias("target"), F.lit(True).alias("last"), F.lit(False).alias("first"), "edges", "header")
    nxt = at.where("block = b0").select("doc_id", (F.col("page") - 1).alias("page"), F.col("block").alias("source"), F.col("edges").alias("e"), F.col("header").alias("h"))
    aligned = (F.size("edges") == F.size("e")) & (F.array_max(F.zip_with("edges", "e", lambda a, b: F.abs(a - b))) <= EDGES_APART)
    both = last.join(nxt.hint("merge"), PAGE).where(aligned & (F.col("h").isNull() | (F.col("h") == F.coalesce("header", F.lit("")))))
    none = F.lit(None).cast("string")
    return both.select("doc_id", F.lit("continuation").alias("kind"), "source", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("col"), "target", none.alias("label"), none.alias("method"), F.lit("resolved").alias("status"), none.alias("reason"))


def _crossed(cells: DataFrame, held: DataFrame) -> DataFrame:
    """A finding for each ruled table with words that overhang their cells."""
    w = held.where("stage = 1").select(*PAGE, "id", F.col("x0").alias("w0"), F.col("x1").alias("w1"))
    each = cells.select(*PAGE, "block", "x0", "x1", F.explode("words").alias("id")).join(w, [*PAGE, "id"])
    over = each.where("w0 < x0 - 1 or w1 > x1 + 1").groupBy(*PAGE, "block").count()
    detail = F.concat(F.col("count").cast("string"), F.when(F.col("count") > 1, " words cross").otherwise(" word crosses"), F.lit(" a drawn column rule"))
    return over.select(*PAGE, F.lit("word_crosses_rule").alias("code"), F.lit("warning").alias("severity"), detail.alias("detail"))


def _line_joins(members: DataFrame, d: DataFrame) -> DataFrame:
    """doc_id, block, a, b: in prose, a line's last word that ends with a hyphen, and the next line's first in lower case."""
    prose_ = members.where("stage = 3").withColumn("line", F.floor(F.col("nth") / 100_000))
    w = Window.partitionBy(*THING).orderBy("nth")
    after = lambda c: F.lead(c).over(w)
    pairs = prose_.select(*THING, "id", "text", "line", after("id").alias("b"), after("text").alias("next"), after("line").alias("next_line"))
    cut = pairs.where((F.col("next_line") > F.col("line")) & F.col("text").rlike(r".-\z") & F.col("next").rlike(r"^\p{Ll}"))
    return cut.join(d.where("part < 0").select(*THING, "block"), THING).select("doc_id", "block", F.col("id").alias("a"), "b")


def complete(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, complete: whether nothing that was found is an error. documents: doc_id; findings: doc_id, severity."""
    broken = findings.where("severity = 'error'").select("doc_id", F.lit(False).alias("ok")).distinct()
    return documents.join(broken.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(True)).alias("complete"))


def stored_documents(document: Document, pages: DataFrame) -> DataFrame:
    """doc, document (of the type ``checks.DOCUMENT``): one row for each document, so that its constraints can be proved. pages: as for ``assemble``, with width."""
    from leafloom.operators.checks import DOCUMENT

    bands = lambda edges: F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.get(edges, i).alias("start"), F.get(edges, i + 1).alias("end")))
    c = document.cells.withColumn("cell", F.struct("row", "col", "rows", "cols", F.lit(False).alias("carried"), F.expr("cast(array() as array<struct<row:bigint,col:bigint>>)").alias("source"), "text", "words"))
    grid = c.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("cell")).alias("cells"), F.array_sort(F.array_union(F.collect_set("y0"), F.collect_set("y1"))).alias("ys"), F.array_sort(F.array_union(F.collect_set("x0"), F.collect_set("x1"))).alias("xs"), F.first("header_rows").alias("header_rows"), F.first("banner_rows").alias("banner_rows"))
    shape = F.struct((F.size("ys") - 1).cast("long").alias("n_rows"), (F.size("xs") - 1).cast("long").alias("n_cols"), bands(F.col("ys")).alias("row_bands"), bands(F.col("xs")).alias("col_bands"), "header_rows", "banner_rows", F.lit(0).alias("frame"), "cells")
    grids_ = grid.select("doc_id", "block", shape.alias("grid"))
    joins = document.joins.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("joins"))
    region = F.array(F.struct("page", F.col("x0"), F.col("top").alias("y0"), F.col("x1"), F.col("bottom").alias("y1")))
    none = F.lit(None).cast("string")
    b = document.blocks.join(document.members.hint("merge"), ["doc_id", "block"]).join(grids_.hint("merge"), ["doc_id", "block"], "left").join(joins.hint("merge"), ["doc_id", "block"], "left")
    name = lambda c: F.concat(F.lit("b"), F.col(c).cast("string"))
    pair = F.coalesce("joins", F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")).alias("joins")
    one = F.struct("block", name("block").alias("id"), "key", "kind", "text", "label", none.alias("number"), "markers", "words", pair, region.alias("regions"), "grid")
    fields = ("id", "key", "kind", "text", "label", "number", "markers", "words", "joins", "regions", "grid")
    blocks = b.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", one.alias("b")))), lambda x: F.struct(*(x.b[f].alias(f) for f in fields))).alias("blocks"))
    cell = F.when(F.col("row").isNotNull(), F.struct("row", "col"))
    link = F.struct("kind", name("source").alias("source"), cell.alias("cell"), F.when(F.col("target").isNotNull(), name("target")).alias("target"), "label", "method", "status", "reason")
    links_ = document.links.groupBy("doc_id").agg(F.collect_list(link).alias("links"))
    words = document.words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "page", "text", "superscript", "x0", "y0", "x1", "y1"))).alias("words"))
    there = document.words.groupBy(*PAGE).count()
    zero = F.lit(0).cast("long")
    layer = F.when(F.col("count").isNull(), "none").otherwise("full")
    page = F.struct(F.col("page").cast("long").alias("number"), "width", "height", layer.alias("text_layer"), zero.alias("unmapped"), *(F.col(c).cast("long").alias(c) for c in ("invisible", "clipped", "overprinted")))
    leaves = pages.join(there.hint("merge"), PAGE, "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    found = document.findings.groupBy("doc_id").agg(F.collect_list(F.struct("code", "page", none.alias("block"))).alias("findings"))
    ledger = document.ledger.select("doc_id", F.struct(*(F.col(f"{c}_chars").cast("long").alias(c) for c in ("content", "furniture", "invisible", "clipped", "overprinted"))).alias("ledger"))
    every = leaves
    for part in (words, blocks, links_, found, ledger):
        every = every.join(part.hint("merge"), "doc_id", "left")
    names = ("pages", "words", "blocks", "links", "findings")
    kinds = {f.name: f.dataType.simpleString() for f in _type_of(DOCUMENT)}
    held = F.struct(F.size("pages").cast("long").alias("declared"), *(F.coalesce(F.col(n), F.array()).cast(kinds[n]).alias(n) for n in names), "ledger")
    return every.select(F.col("doc_id").alias("doc"), held.alias("document"))


def _type_of(kind: str):
    from pyspark.sql.types import DataType

    return DataType.fromDDL(kind)
