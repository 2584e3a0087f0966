"""Markdown, HTML and dense rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import tokens as tk


def document_markdown(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown: each block in the form of its kind, parted by blank lines; furniture is left out. tables: doc_id, block, form, the blocks that are tables as pipe tables or as HTML."""
    blocks = blocks.where("kind <> 'furniture'")
    held = blocks.join(tables, ["doc_id", "block"], "left") if tables is not None else blocks.withColumn("form", F.lit(None).cast("string"))
    blocks = held.withColumnRenamed("form", "whole")
    level = F.dense_rank().over(Window.partitionBy("doc_id", F.col("kind") == "heading").orderBy(F.desc(F.round(F.col("size") * 2) / 2)))
    esc = tk.escape_tags(F.col("text"))
    b = blocks.withColumn("level", F.least(level, F.lit(6))).withColumn("esc", esc)
    b = b.withColumn("rest", tk.escape_opening(F.when(F.col("esc").contains(" "), F.expr("substr(esc, instr(esc, ' ') + 1)")).otherwise("")))
    after = F.when(F.col("rest") == "", "").otherwise(F.concat(F.lit(" "), F.col("rest")))
    form = (
        F.when(F.col("whole").isNotNull(), F.col("whole"))
        .when(F.col("kind") == "heading", F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("esc")))
        .when(F.col("kind") == "footnote", F.concat(F.lit("[^"), F.col("label"), F.lit("]:"), after))
        .when((F.col("kind") == "list_item") & tk.is_bullet(F.col("label")), F.concat(F.lit("-"), after))
        .when(F.col("kind") == "list_item", F.col("esc"))
        .otherwise(tk.escape_opening(F.col("esc")))
    )
    forms = F.array_sort(F.collect_list(F.struct("block", form.alias("md"))))
    return b.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(forms, lambda x: x.md), "\n\n"), F.lit("\n")).alias("markdown"))


def dense_rows(cells: DataFrame) -> DataFrame:
    """tbl, row, col, text, copy: every position of each cell's span; cells: tbl, row, col, row_span, col_span, text."""
    spread = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    return spread.select("tbl", F.col("r").alias("row"), F.col("c").alias("col"), "text", ((F.col("r") != F.col("row")) | (F.col("c") != F.col("col"))).alias("copy"))


def _joined(items: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x.s), sep)


def table_markdown(cells: DataFrame, header: bool = True) -> DataFrame:
    """tbl, markdown: a pipe table; a merged text stands once; with ``header`` the first row is it, else it is blank."""
    d = dense_rows(cells).withColumn("s", F.when(F.col("copy"), "").otherwise(tk.escape_cell(F.col("text"))))
    rows = d.groupBy("tbl", "row").agg(F.concat(F.lit("| "), _joined(F.collect_list(F.struct("col", "s")), " | "), F.lit(" |")).alias("s"), F.count("*").alias("n"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.first("n").cast("int")), " | "), F.lit(" |"))
    blank = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(""), F.first("n").cast("int")), " | "), F.lit(" |"))
    every = F.array_sort(F.collect_list(F.struct("row", "s")))
    text = F.transform(every, lambda x: x.s)
    whole = F.concat(F.slice(text, 1, 1), F.array(rule), F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(0)))) if header else F.concat(F.array(blank, rule), text)
    return rows.groupBy("tbl").agg(F.array_join(whole, "\n").alias("markdown"))


def table_html(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    """tbl, html: header rows in thead, spans as attributes, texts escaped; a cell that crosses the header's end is cut there."""
    end = F.col("row") + F.col("row_span")
    crosses = (F.col("row") < header_rows) & (end > header_rows)
    parts = F.when(
        crosses,
        F.array(
            F.struct(F.col("row").alias("row"), (F.lit(header_rows) - F.col("row")).cast("long").alias("rows"), F.col("text").alias("text")),
            F.struct(F.lit(header_rows).cast("long").alias("row"), (end - header_rows).cast("long").alias("rows"), F.lit("").alias("text")),
        ),
    ).otherwise(F.array(F.struct(F.col("row").alias("row"), F.col("row_span").cast("long").alias("rows"), F.col("text").alias("text"))))
    placed = cells.select("tbl", "col", "col_span", F.explode(parts).alias("p")).select("tbl", "p.row", "p.rows", "col", "col_span", "p.text")
    tag = F.when(F.col("row") < header_rows, "th").otherwise("td")
    spans = F.concat(F.when(F.col("col_span") > 1, F.concat(F.lit(' colspan="'), F.col("col_span").cast("string"), F.lit('"'))).otherwise(""), F.when(F.col("rows") > 1, F.concat(F.lit(' rowspan="'), F.col("rows").cast("string"), F.lit('"'))).otherwise(""))
    cell = F.concat(F.lit("<"), tag, spans, F.lit(">"), tk.escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    rows = placed.withColumn("s", cell).groupBy("tbl", "row").agg(F.concat(F.lit("<tr>"), _joined(F.collect_list(F.struct("col", "s")), ""), F.lit("</tr>")).alias("s"))
    rows = rows.withColumn("s", F.concat(F.when((F.col("row") == 0) & F.lit(header_rows > 0), "<thead>").otherwise(""), F.when(F.col("row") == header_rows, "<tbody>").otherwise(""), F.col("s"), F.when(F.col("row") == header_rows - 1, "</thead>").otherwise("")))
    return rows.groupBy("tbl").agg(F.concat(F.lit("<table>"), _joined(F.collect_list(F.struct("row", "s")), ""), F.when(F.max("row") >= header_rows, "</tbody>").otherwise(""), F.lit("</table>")).alias("html"))


def inspector_html(pages: DataFrame, words: DataFrame, blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, html: of each page its words and blocks as boxes, and below it the blocks' texts and what was found.

    pages: doc_id, page, width, height; words: doc_id, page, id, x0, y0, x1, y1, text; blocks: doc_id, page, block, kind, x0, y0, x1,
    y1, text; findings: doc_id, page, code, detail.
    """
    s = lambda c: F.col(c).cast("string")
    box = lambda name: F.concat(F.lit(f'<rect class="{name}" x="'), s("x0"), F.lit('" y="'), s("y0"), F.lit('" width="'), F.round(F.col("x1") - F.col("x0"), 2).cast("string"), F.lit('" height="'), F.round(F.col("y1") - F.col("y0"), 2).cast("string"), F.lit('"><title>'), tk.escape_html(F.col("text")), F.lit("</title></rect>"))
    part = lambda d, order, shown, name: d.groupBy("doc_id", "page").agg(_joined(F.collect_list(F.struct(*order, shown.alias("s"))), "").alias(name))
    drawn = part(words, ["id"], box("word"), "words").join(part(blocks, ["block"], box("block"), "boxes"), ["doc_id", "page"], "full")
    card = F.concat(F.lit('<div class="card"><b>b'), s("block"), F.lit(" "), "kind", F.lit("</b> "), tk.escape_html(F.col("text")), F.lit("</div>"))
    told = F.concat(F.lit('<div class="finding"><b>'), "code", F.lit("</b> "), tk.escape_html(F.col("detail")), F.lit("</div>"))
    d = pages.join(drawn, ["doc_id", "page"], "left").join(part(blocks, ["block"], card, "cards"), ["doc_id", "page"], "left").join(part(findings, ["code", "detail"], told, "found"), ["doc_id", "page"], "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    sheet = F.concat(F.lit('<section><svg viewBox="0 0 '), s("width"), F.lit(" "), s("height"), F.lit('">'), blank("words"), blank("boxes"), F.lit("</svg>"), blank("cards"), blank("found"), F.lit("</section>"))
    return d.groupBy("doc_id").agg(F.concat(F.lit("<!DOCTYPE html><html><body>"), _joined(F.collect_list(F.struct("page", sheet.alias("s"))), ""), F.lit("</body></html>")).alias("html"))
