"""Glossaries, footnotes and footnote calls: what opens a definition or a note, which grids are lists of them, and what calls them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.config import Profile
from leafloom.functions import tokens as tk
from leafloom.operators import links

# Fixed values.
LEAD_WORDS, HANGING_WORDS, HANGING_EM, HANGING_OFF, TERM_WORDS, PROSE_WORDS = 12, 8, 2.0, 2.0, 8, 3
SMALLER, NO_LARGER, NOTE_WORDS, NOTE_ROWS, LEAST_BAND = 0.92, 1.05, 3, 2, 0.05
NOTES = ["note", "notes", "footnote", "footnotes"]


def in_scope(items: DataFrame) -> DataFrame:
    """items with in_scope: whether a heading that titles definitions, with no heading of its level or a higher one since, stands before.

    items: doc, nth, kind, level (of headings), text. A scope is open at level L where the last heading of level L or higher
    titles definitions and is of level L: one window for each level that a title of the document has.
    """
    heading = F.col("kind") == "heading"
    marked = items.withColumn("titles", heading & tk.is_definitions_title(F.col("text")))
    levels = marked.where("titles").select("doc", F.col("level").alias("scope")).distinct()
    w = Window.partitionBy("doc", "scope").orderBy("nth")
    held = marked.join(levels, "doc")
    last = F.last(F.when(heading & (F.col("level") <= F.col("scope")), F.struct("level", "titles")), ignorenulls=True).over(w)
    open_ = held.select("doc", "nth", F.coalesce((last.level == F.col("scope")) & last.titles, F.lit(False)).alias("open")).groupBy("doc", "nth").agg(F.bool_or("open").alias("open"))
    return items.join(open_, ["doc", "nth"], "left").select(items["*"], F.coalesce("open", F.lit(False)).alias("in_scope"))


def lead_term(words: Column) -> Column:
    """How many first words of a line are bold, or else italic, with others after them. words: array of text, bold, italic."""

    def run(flag: str) -> Column:
        n = F.coalesce(F.array_position(F.transform(words, lambda w: w[flag]), False).cast("int"), F.lit(0)) - 1
        return F.when((n > 0) & (n <= LEAD_WORDS), n).otherwise(0)

    return F.when(run("bold") > 0, run("bold")).otherwise(run("italic"))


def hanging_term(parts: Column, size: Column, later: Column) -> Column:
    """How many words the first fragment of the first line has, where the text stands apart from it and later lines begin below the text. parts: fragments (x0, x1, n); later: the other lines' x0."""
    first, body = F.get(parts, 0), F.get(parts, 1)
    fits = (F.size(parts) >= 2) & (first.n <= HANGING_WORDS) & (body.x0 - first.x1 >= HANGING_EM * size) & F.forall(later, lambda x: F.abs(x - body.x0) <= HANGING_OFF)
    return F.when(F.coalesce(fits, F.lit(False)), first.n.cast("int")).otherwise(0)


def definitions(blocks: DataFrame) -> DataFrame:
    """blocks with term: how many words open a paragraph as a defined term, 0 for none.

    blocks: kind, in_scope, words (texts of the block), first (words of the first line: text, bold, italic), parts, size, later.
    """
    quoted = tk.quoted_term(F.col("words"))
    rest = F.slice("words", quoted + 1, F.greatest(F.size("words"), F.lit(1)))
    lead = lead_term(F.col("first"))
    hanging = hanging_term(F.col("parts"), F.col("size"), F.col("later"))
    hanging = F.when((hanging == 1) & tk.note_label(F.get("words", 0)).isNotNull(), 0).otherwise(hanging)
    n = F.when((quoted > 0) & (F.col("in_scope") | tk.defines(rest)), quoted).when(~F.col("in_scope"), 0).when(lead > 0, lead).otherwise(hanging)
    return blocks.withColumn("term", F.when((F.col("kind") == "paragraph") & (n <= F.size("first")), n).otherwise(0))


def _plain(words: Column) -> Column:
    return F.transform(F.filter(words, lambda w: ~w.superscript), lambda w: w.text)


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w.text), " ")


def dissolved(cells: DataFrame, marks: DataFrame, profile: Profile | None = None) -> DataFrame:
    """doc, tbl, row, kind, label: the blocks of grids of two columns that list notes or definitions, row by row; other grids have none.

    cells: doc, tbl, row, col, row_span, col_span, n_cols, in_scope, words (array of text, superscript); marks: doc, text (of the
    document's superscripts). A first row over both columns that titles definitions opens a scope over the grid.
    """
    p = profile or Profile()
    filled = F.col("words").isNotNull() & (F.size("words") > 0)
    grid = Window.partitionBy("doc", "tbl")
    titles = filled & (F.col("row") == 0) & (F.col("col_span") == F.col("n_cols")) & tk.is_definitions_title(_joined(F.col("words")))
    c = cells.withColumn("fits", F.bool_and((F.col("n_cols") == 2) & (F.col("row_span") == 1)).over(grid)).withColumn("scope", F.col("in_scope") | F.max(titles).over(grid)).where("fits").where(filled)
    cell = F.struct("col", "col_span", "words")
    rows = c.groupBy("doc", "tbl", "row").agg(F.array_sort(F.collect_list(cell)).alias("held"), F.bool_or("scope").alias("scope"))
    left, right = F.get("held", 0), F.get("held", 1)
    opening = F.get(left.words, 0).text
    rows = rows.withColumn("opening", opening).join(marks.select("doc", F.col("text").alias("opening"), F.lit(True).alias("marked")).distinct(), ["doc", "opening"], "left")
    text = _plain(right.words)
    prose = (F.size(text) >= PROSE_WORDS) & ~tk.is_value(F.array_join(text, " ")) & ~tk.is_strong_value(F.coalesce(F.get(text, 0), F.lit("")))
    label = tk.strip_label(F.col("opening"))
    noted = (F.size(left.words) == 1) & (label != "") & (tk.note_label(F.col("opening")).isNotNull() | F.coalesce("marked", F.lit(False)))
    valued = tk.is_value(_joined(left.words)) | F.exists(left.words, lambda w: tk.is_strong_value(w.text))
    pair = (F.size("held") == 2) & (left.col_span == 1) & (right.col_span == 1) & prose
    kind = (
        F.when((F.size("held") == 1) & (left.col_span == 2), F.when(F.size(left.words) <= p.heading_max_words, "heading"))
        .when(pair & noted, "footnote")
        .when(pair & F.col("scope") & (F.size(left.words) <= TERM_WORDS) & ~valued, "definition")
    )
    typed = rows.withColumn("kind", kind)
    whole = typed.withColumn("ok", F.bool_and(F.col("kind").isNotNull()).over(grid) & F.max(F.col("kind") != "heading").over(grid))
    return whole.where("ok").select("doc", "tbl", "row", "kind", F.when(F.col("kind") == "footnote", label).alias("label"))


def call_labels(words: DataFrame) -> DataFrame:
    """doc, label: what superscripts call, once each. words: doc, text, superscript."""
    return words.where("superscript").select("doc", F.explode(tk.call_parts(F.col("text"))).alias("label")).distinct()


def notes(blocks: DataFrame, called: DataFrame) -> DataFrame:
    """blocks with note: the label of a paragraph or list item that a called label opens as a footnote, or null.

    blocks: doc, kind, body, first (words of the first line: text, size, bold, superscript); called: doc, label.
    """
    label, rest = F.get("first", 0), F.slice("first", 2, F.greatest(F.size("first"), F.lit(1)))
    key = tk.strip_label(label.text)
    d = blocks.withColumn("key", key).join(called.select("doc", F.col("label").alias("key"), F.lit(True).alias("named")).distinct(), ["doc", "key"], "left")
    sizes = F.array_sort(F.transform(rest, lambda w: w.size))
    n = F.size(sizes)
    middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
    bare = tk.is_mark(label.text) | (tk.note_label(label.text).isNotNull() & ~label.text.rlike(r"[.)]\z"))
    sort = tk.note_label(label.text).isNotNull() | tk.is_mark(label.text) | label.text.rlike(r"^\p{L}\z")
    small = (label.size <= SMALLER * middle) | (bare & (label.size <= NO_LARGER * middle))
    bold = 2 * F.size(F.filter(rest, lambda w: w.bold)) > n
    ok = F.col("kind").isin("paragraph", "list_item") & F.col("named") & ~label.superscript & (F.col("key") != "") & sort & (n >= NOTE_WORDS) & small & (middle <= NO_LARGER * F.col("body")) & ~bold
    return d.select(blocks["*"], F.when(F.coalesce(ok, F.lit(False)), F.col("key")).alias("note"))


def note_grids(cells: DataFrame) -> DataFrame:
    """doc, tbl, row, kind, label: the blocks of tables that a notes word titles, with rows of a label and a text; other tables have none. cells: doc, tbl, row, col, header_rows, words (texts)."""
    c = cells.where(F.size("words") > 0).withColumn("text", F.array_join("words", " "))
    grid = Window.partitionBy("doc", "tbl")
    rows = c.groupBy("doc", "tbl", "row").agg(F.max("header_rows").alias("header_rows"), F.array_sort(F.collect_list(F.struct("col", "words", "text"))).alias("held"))
    head = F.col("row") < F.col("header_rows")
    said = F.array_join(F.transform("held", lambda h: h.text), " ")
    title = F.exists(F.split(said, " "), lambda w: F.lower(F.regexp_replace(w, "^:+|:+$", "")).isin(NOTES))
    left, right = F.get("held", 0), F.get("held", 1)
    label = F.get(left.words, 0)
    pair = (F.size("held") == 2) & (left.col == 0) & (right.col == 1) & (F.size(left.words) == 1) & tk.note_label(label).isNotNull() & ~tk.is_value(right.text) & (tk.strip_label(label) != "")
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(head, F.struct("row", said.alias("s")))).over(grid)), lambda x: x.s), " ")
    d = rows.withColumn("titled", F.max(head & title).over(grid) & ~tk.is_value(every)).withColumn("whole", F.bool_and(head | F.coalesce(pair, F.lit(False))).over(grid)).withColumn("body", F.count_if(~head).over(grid))
    kind = F.when(head, "heading").otherwise("footnote")
    return d.where(F.col("titled") & F.col("whole") & (F.col("body") >= NOTE_ROWS)).select("doc", "tbl", "row", kind.alias("kind"), F.when(~head, tk.strip_label(label)).alias("label"))


def calls_in(blocks: DataFrame, register: DataFrame) -> DataFrame:
    """doc, order, cell, page, label, method, reason: what may call a note, by superscript, parenthesis or name; a note doesn't call itself, and its first word is its label.

    blocks (or cells): doc, order, cell (or null), page, kind, label, text, words (array of text, superscript, page); register:
    doc, label (of the notes).
    """
    marks = F.when(F.col("kind") == "footnote", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))).otherwise(F.col("words"))
    base = ["doc", "order", "cell", "label"]
    b = blocks.withColumnRenamed("label", "own")
    raised = b.withColumn("w", F.explode(F.filter(marks, lambda w: w.superscript))).select("doc", "order", "cell", "own", F.col("w.page").alias("page"), F.explode(tk.call_parts(F.col("w.text"))).alias("label"), F.lit("superscript").alias("method"), F.lit(None).cast("string").alias("reason"))
    site = F.struct("order", "cell", "page", "own")
    level = b.select("doc", site.alias("order"), F.array_join(_plain(F.col("words")), " ").alias("text"))
    inside = links.parenthetical_calls(level, register).select("doc", "order.order", "order.cell", "order.own", "order.page", "label", F.lit("parenthetical").alias("method"), "reason")
    named = b.select("doc", "order", "cell", "own", "page", F.explode(tk.named_calls(F.col("text"))).alias("label"), F.lit("named").alias("method"), F.lit(None).cast("string").alias("reason"))
    every = raised.unionByName(inside).unionByName(named)
    return every.where(F.col("own").isNull() | (F.col("own") != F.col("label"))).select(*base, "page", "method", "reason")


def call_links(sites: DataFrame, notes_: DataFrame) -> DataFrame:
    """doc, order, cell, label, method, page, status, note, reason: one link for each label that a block or cell calls by a method, rejected, resolved or unresolved. sites: as of ``calls_in``; notes_: doc, label, order, page."""
    once = sites.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "order", "cell", "label", "method", "reason").orderBy("page"))).where("nth = 1").drop("nth")
    s = once.withColumn("site", F.struct("order", "cell", "label", "method", "reason", "page"))
    open_ = s.where("reason is null").select("doc", "site", "order", "page", "label")
    found = links.resolve(open_, notes_).select("doc", "site", "label", "note")
    out = s.join(found, ["doc", "site", "label"], "left")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("note").isNull(), "unresolved").otherwise("resolved")
    return out.select("doc", "order", "cell", "label", "method", "page", status.alias("status"), "note", "reason")


def unresolved(calls: DataFrame) -> DataFrame:
    """doc, page, n, labels: a finding for each page with calls that resolve to no note, the labels once each in order. calls: as of ``call_links``."""
    c = calls.where("status = 'unresolved'")
    first = c.groupBy("doc", "page", "label").agg(F.count("*").alias("n"), F.min(F.struct("order", "cell", "method")).alias("at"))
    return first.groupBy("doc", "page").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x.label), ", ").alias("labels"))


def carried(tables: DataFrame) -> DataFrame:
    """doc, row, col, rows, cols, carried, text, y0, y1: a table that goes on, with the header rows of the one before above its own, as high as they were there, or scaled to the room up to the ceiling.

    tables: doc, row_edges (of the table), ceiling, cells (row, col, rows, cols, text), parent_edges, header_rows, parent_cells.
    """
    k = F.col("header_rows")
    heights = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.get("parent_edges", i + 1) - F.get("parent_edges", i))
    top = F.get("row_edges", 0)
    total = F.aggregate(heights, F.lit(0.0), lambda s, h: s + h)
    scale = F.when(top - F.col("ceiling") > 0, F.least(F.lit(1.0), (top - F.col("ceiling")) / total)).otherwise(0.0)
    bands = F.transform(heights, lambda h: F.greatest(h * scale, F.lit(LEAST_BAND)))
    above = lambda i: F.aggregate(F.slice("bands", 1, i), F.lit(0.0), lambda s, h: s + h)
    d = tables.withColumn("bands", bands).withColumn("high", F.aggregate("bands", F.lit(0.0), lambda s, h: s + h))
    edges = F.concat(F.transform(F.sequence(F.lit(0), k - 1), lambda i: top - F.col("high") + above(i)), F.col("row_edges"))
    head = F.transform(F.filter("parent_cells", lambda c: c.row < k), lambda c: F.struct(c.row.alias("row"), c.col.alias("col"), F.least(c.rows, k - c.row).alias("rows"), c.cols.alias("cols"), (c.text != "").alias("carried"), c.text.alias("text")))
    body = F.transform("cells", lambda c: F.struct((c.row + k).alias("row"), c.col.alias("col"), c.rows.alias("rows"), c.cols.alias("cols"), F.lit(False).alias("carried"), c.text.alias("text")))
    out = d.withColumn("edges", edges).select("doc", "edges", F.explode(F.concat(head, body)).alias("c")).select("doc", "edges", "c.*")
    return out.select("doc", "row", "col", "rows", "cols", "carried", "text", F.get("edges", F.col("row").cast("int")).alias("y0"), F.get("edges", (F.col("row") + F.col("rows")).cast("int")).alias("y1"))
