"""Characters to words, paths to rules and fills, and what a page's facts say of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
GAP_MIN, GAP_MAX, OVERLAP = -1.0, 0.6, 0.3
MARK_SMALLER, MARK_RAISED = 0.92, 0.2  # of the size beside it: how small a raised mark is, and how far it stands above
SLANT, SHORT, THIN = 0.5, 2.0, 3.5
LINES_AT_ONCE = 1000


def text_layer(words: Column, unmapped: Column) -> Column:
    return F.when((words == 0) & (unmapped == 0), "none").when(unmapped > 0, "partial").otherwise("full")


def page_class(visible: Column, invisible: Column, image: Column) -> Column:
    """What a page is for a benchmark."""
    return F.when(visible < 50, "no_text").when(invisible >= visible, "ocr_layer").when(image >= 0.9, "image_backed").otherwise("born_digital")


def document_classes(pages: DataFrame) -> DataFrame:
    """doc_id, class: that of the first page that is not born digital, or born digital. pages: doc_id, page, class."""
    other = F.min_by("class", F.when(F.col("class") != "born_digital", F.col("page")))
    return pages.groupBy("doc_id").agg(F.coalesce(other, F.lit("born_digital")).alias("class"))


def numeric_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, page of the pages whose text holds at least so many numbers."""
    return pages.where(F.regexp_count("text", F.lit(r"(?U)\d[\d,.]*")) >= least).select("doc_id", "page")


def scored(documents: DataFrame, census: DataFrame, groups: list[str], others: list[str]) -> DataFrame:
    """doc_id, group, why: null for a document that is scored, or the class or 'group' that leaves it out, 'unclassified' or 'unnamed group' where it should not be there. documents: doc_id, group; census: doc_id, class."""
    why = (
        F.when(F.col("class").isNull(), "unclassified")
        .when(~F.col("group").isin(groups + others), "unnamed group")
        .when(F.col("class") != "born_digital", F.col("class"))
        .when(F.col("group").isin(others), "group")
    )
    return documents.join(census, "doc_id", "left").select("doc_id", "group", why.alias("why"))


def image_ratio(images: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, ratio: the part of a page that images cover, each cut to the page, 1 at most. images: doc_id, page, x0, y0, x1, y1; pages: doc_id, page, width, height."""
    both = pages.join(images, ["doc_id", "page"], "left")
    w = F.least("x1", "width") - F.greatest("x0", F.lit(0.0))
    h = F.least("y1", "height") - F.greatest("y0", F.lit(0.0))
    area = F.sum(F.when((w > 0) & (h > 0), w * h).otherwise(0.0))
    return both.groupBy("doc_id", "page", "width", "height").agg(area.alias("area")).select("doc_id", "page", F.least(F.lit(1.0), F.col("area") / (F.col("width") * F.col("height"))).alias("ratio"))


def upright(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words, in the frame that displays where a turned page's text is upright only there; turned tells which.

    words: doc_id, page, id, text, horizontal, diagonal, x0, y0, x1, y1; pages: doc_id, page, rotation, width, height.
    """
    from leafloom.functions import geometry as geo

    n = F.length("text")
    share = words.groupBy("doc_id", "page").agg(F.sum(n).alias("chars"), F.sum(F.when(~F.col("horizontal"), n).otherwise(0)).alias("across"))
    facts = pages.join(share, ["doc_id", "page"], "left").select("doc_id", "page", "rotation", "width", "height", F.coalesce((F.col("rotation") != 0) & (2 * F.col("across") > F.col("chars")), F.lit(False)).alias("turned"))
    box = geo.turn_rect(F.col("rotation"), geo.box(), F.col("width"), F.col("height"))
    out = words.join(facts, ["doc_id", "page"])
    turned = [F.when(F.col("turned"), t).otherwise(F.col(c)).alias(c) for t, c in zip(box, ("x0", "y0", "x1", "y1"), strict=True)]
    return out.select("doc_id", "page", "id", "text", F.when(F.col("turned"), ~F.col("horizontal") & ~F.col("diagonal")).otherwise(F.col("horizontal")).alias("horizontal"), *turned, "turned")


def drawn_spans(spans: DataFrame) -> DataFrame:
    """spans without the copies that clipping makes: unseen clipped ones of which the characters and boxes were drawn on the page.

    spans: doc_id, page, span, clipped, alpha, chars (array of c, x0, y0, x1, y1).
    """
    sign = F.transform("chars", lambda c: F.struct(c.c, *(F.round(c[n], 2) for n in ("x0", "y0", "x1", "y1"))))
    signed = spans.withColumn("sign", F.sha2(F.to_json(F.struct(sign.alias("s"))), 256)).withColumn("copy", F.col("clipped") & (F.col("alpha") == 0))
    seen = signed.where("not copy").select("doc_id", "page", "sign").distinct()
    return signed.where("copy").join(seen, ["doc_id", "page", "sign"], "left_anti").unionByName(signed.where("not copy")).drop("sign", "copy")


def read_once(words: DataFrame, em: float = 0.1) -> DataFrame:
    """words with kept: whether no earlier kept word of the page is the same and at the same place, each edge within a tenth of its size.

    words: doc_id, page, id, text, font, size, state, type3, x0, y0, x1, y1. Words that hold U+FFFD or are of a Type 3 font are kept.
    """
    alike = ["doc_id", "page", "text", "font", "size", "state"]
    plain = words.where(~F.col("type3") & ~F.contains("text", F.lit("\ufffd")))
    box = F.struct("id", "x0", "y0", "x1", "y1")

    def near(a: Column, b: Column) -> Column:
        return F.greatest(*(F.abs(a[c] - b[c]) for c in ("x0", "y0", "x1", "y1"))) <= F.lit(em) * F.col("size") + 1e-6

    ordered = plain.groupBy(*alike).agg(F.array_sort(F.collect_list(box)).alias("all"))
    start = F.array().cast("array<struct<id:bigint,x0:double,y0:double,x1:double,y1:double>>")
    kept = F.aggregate("all", start, lambda held, w: F.when(F.exists(held, lambda k: near(k, w)), held).otherwise(F.array_append(held, w)))
    ids = ordered.select(F.explode(F.transform(kept, lambda w: w.id)).alias("id"), "doc_id", "page").withColumn("own", F.lit(True))
    special = F.col("type3") | F.contains("text", F.lit("\ufffd"))
    return words.join(ids, ["doc_id", "page", "id"], "left").select(words["*"], (F.coalesce("own", F.lit(False)) | special).alias("kept"))


def page_counts(chars: DataFrame) -> DataFrame:
    """doc_id, page, invisible, unmapped, hidden, drawn: characters of each class. chars: doc_id, page, class, hidden, unclipped (read without clipping)."""
    on = ~F.col("unclipped")
    word = F.col("class") == "word"
    return chars.groupBy("doc_id", "page").agg(
        F.count_if(on & (F.col("class") == "invisible")).alias("invisible"), F.count_if(on & (F.col("class") == "no_unicode")).alias("unmapped"), F.count_if(on & word & F.col("hidden")).alias("hidden"),
        F.greatest(F.lit(0), F.count_if(~on & word) - F.count_if(on & word)).alias("clipped"),
    )


def styles(font: Column, bold_flag: Column, italic_flag: Column) -> tuple[Column, Column]:
    """Whether a span is bold and italic, by its flags or its font's name."""
    name = F.lower(font)
    return bold_flag | name.contains("bold"), italic_flag | name.contains("italic") | name.contains("oblique")


def quad_boxes(quads: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """quads with x0, y0, x1, y1 of those whose corners stand on two x and two y. quads: points (array of x, y)."""
    xs, ys = F.transform("points", lambda p: p.x), F.transform("points", lambda p: p.y)
    out = quads.select("*", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    on = lambda v, a, b: (F.abs(v - F.col(a)) <= tolerance) | (F.abs(v - F.col(b)) <= tolerance)
    return out.where(F.forall("points", lambda p: on(p.x, "x0", "x1") & on(p.y, "y0", "y1")))


def unreadable(documents: DataFrame) -> DataFrame:
    """doc_id, detail of documents that declare more pages than could be loaded. documents: doc_id, declared, loaded."""
    missing = F.col("declared") - F.col("loaded")
    s = lambda c: c.cast("string")
    detail = F.concat(s(missing), F.lit(" of "), s(F.col("declared")), F.lit(" pages are missing: "), s(F.col("loaded") + 1), F.lit("-"), s(F.col("declared")))
    return documents.where(missing > 0).select("doc_id", detail.alias("detail"))


CHAR = ["span", "char", "c", "x0", "y0", "x1", "y1", "size", "bold"]
BLANKS = [chr(c) for c in (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]  # what (?U)\s matches


def build_words(chars: DataFrame) -> DataFrame:
    """``line_words`` of characters that are rows: doc_id, page, line and CHAR and, if known, superscript."""
    known = ["superscript"] if "superscript" in chars.columns else []
    return line_words(chars.groupBy("doc_id", "page", "line").agg(F.collect_list(F.struct(*CHAR, *known)).alias("chars")))


def line_words(lines: DataFrame) -> DataFrame:
    """doc_id, page, line, word, x0, y0, x1, y1, text, size, bold: maximal runs of characters without white space that stand close.

    lines: doc_id, page, line, chars (array of CHAR and, if known, superscript), one row for each line, so that characters are not sorted
    among those of others. Runs go on over spans if the gap and the overlap allow, but not from a raised mark to the word that it opens, nor between marks and other text.
    """
    kinds = lines.schema
    keys = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("doc_id", "page", "line"))
    inner = {f.name: f.dataType.simpleString() for f in kinds["chars"].dataType.elementType}
    out = f"{keys}, word long, x0 double, y0 double, x1 double, y1 double, text string, size {inner['size']}, bold {inner['bold']}"
    return lines.select("doc_id", "page", "line", "chars").mapInArrow(_lines_words, out)


def _lines_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, LINES_AT_ONCE):
            found = _runs(batch.slice(a, LINES_AT_ONCE))
            if found is not None:
                yield found


def _runs(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """The words of lines, all lines' characters side by side."""
    lists = batch.column(3)
    row = pc.list_parent_indices(lists).to_numpy()
    if not len(row):
        return None
    flat = lists.flatten()
    of = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
    order = np.lexsort((of["char"].to_numpy(zero_copy_only=False), row))
    row = row[order]
    of = {n: v.take(pa.array(order)) for n, v in of.items()}
    x0, y0, x1, y1, size, span = (of[n].to_numpy(zero_copy_only=False) for n in ("x0", "y0", "x1", "y1", "size", "span"))
    blank = pc.is_in(of["c"], pa.array(BLANKS)).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        overlap, low, gap = np.minimum(y1[:-1], y1[1:]) - np.maximum(y0[:-1], y0[1:]), np.minimum((y1 - y0)[:-1], (y1 - y0)[1:]), x0[1:] - x1[:-1]
        far = (gap < GAP_MIN - 1e-6) | (gap > GAP_MAX + 1e-6) | (overlap < OVERLAP * low - 1e-6)
        opened = (size[:-1] <= MARK_SMALLER * size[1:]) & (y1[1:] - y1[:-1] > MARK_RAISED * size[1:])
    if "superscript" in of:
        raised_ = of["superscript"].to_numpy(zero_copy_only=False)
        opened |= (raised_[:-1] != raised_[1:]).astype(bool)
    fresh = np.append(True, row[1:] != row[:-1])
    starts = fresh.copy()
    starts[1:] |= blank[:-1] | ((span[1:] != span[:-1]) & (far | opened))
    run = np.cumsum(starts)  # over all lines
    first = np.flatnonzero(fresh)
    word = run - np.repeat(run[first] - 1, np.diff(first, append=len(row)))
    keep = np.flatnonzero(~blank & of["c"].is_valid().to_numpy(zero_copy_only=False))
    if not len(keep):
        return None
    run, x0, y0, x1, y1, span = run[keep], x0[keep], y0[keep], x1[keep], y1[keep], span[keep]
    at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    # of a run's spans the one with most characters, then the first
    by = np.lexsort((span, run))
    part = np.flatnonzero(np.append(True, (run[by][1:] != run[by][:-1]) | (span[by][1:] != span[by][:-1])))
    many = np.diff(part, append=len(by))
    best = np.lexsort((span[by[part]], -many, run[by[part]]))
    best = best[np.append(True, run[by[part]][best][1:] != run[by[part]][best][:-1])]
    main = pa.array(keep[by[part[best]]])
    c = of["c"].take(pa.array(keep)).cast(pa.large_string())
    ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    text = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(ends[at], ends[-1]).tobytes()), c.buffers()[2]])
    mine = pa.array(row[keep[at]])
    boxes = [pa.array(f.reduceat(v, at)) for f, v in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    columns = [*(batch.column(k).take(mine) for k in range(3)), pa.array(word[keep[at]]), *boxes, text.cast(pa.string()), of["size"].take(main), of["bold"].take(main)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "line", "word", "x0", "y0", "x1", "y1", "text", "size", "bold"])


def raised(words: DataFrame, smaller: float = MARK_SMALLER, lift: float = MARK_RAISED) -> DataFrame:
    """words with superscript: what is smaller than most of its line and stands clear above the line on which that stands.

    A line's size is that of most of its characters, and its foot the median foot of the words of that size, so that neither marks nor
    letters with tails move it. words: doc_id, page, line, text, size, y1.
    """
    half = (F.round(F.col("size") * 2) / 2).alias("half")
    sized = words.groupBy("doc_id", "page", "line", half).agg(F.sum(F.length("text")).alias("chars"), F.median("y1").alias("foot"))
    main = sized.groupBy("doc_id", "page", "line").agg(F.max_by(F.struct("half", "foot"), F.struct("chars", "half")).alias("main"))
    mark = (F.col("size") <= smaller * F.col("main.half")) & (F.col("main.foot") - F.col("y1") > lift * F.col("main.half"))
    return words.drop("superscript").join(main.hint("merge"), ["doc_id", "page", "line"]).withColumn("superscript", mark).drop("main")


def extract_rules(paths: DataFrame, slant: float = SLANT, short: float = SHORT, thin: float = THIN) -> DataFrame:
    """doc_id, page, axis, at, start, end, thickness: straight strokes and thin rectangles; equal ones once, the thickest.

    paths: doc_id, page, kind ('line' or 'rect'), x0, y0, x1, y1, width, stroked, filled.
    """
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))

    def rule(axis: str, at: Column, a: Column, b: Column, thick: Column) -> Column:
        return F.struct(F.lit(axis).alias("axis"), F.round(at, 2).alias("at"), F.round(F.least(a, b), 2).alias("start"), F.round(F.greatest(a, b), 2).alias("end"), F.round(thick, 2).alias("thickness"))

    x0, y0, x1, y1, width = (F.col(c) for c in ("x0", "y0", "x1", "y1", "width"))
    mid_x, mid_y = (x0 + x1) / 2, (y0 + y1) / 2
    none = F.lit(None)
    line = F.array(F.when((dy <= slant) & (dx >= short), rule("h", mid_y, x0, x1, width)).when((dx <= slant) & (dy >= short), rule("v", mid_x, y0, y1, width)))
    flat = F.when((dy <= thin) & (dx >= short) & (dx >= dy), rule("h", mid_y, x0, x1, dy)).when((dx <= thin) & (dy >= short), rule("v", mid_x, y0, y1, dx))
    edges = F.array(rule("h", y0, x0, x1, width), rule("h", y1, x0, x1, width), rule("v", x0, y0, y1, width), rule("v", x1, y0, y1, width))
    found = F.when((F.col("kind") == "line") & F.col("stroked"), line).when((F.col("kind") == "rect") & flat.isNotNull(), F.array(flat)).when((F.col("kind") == "rect") & F.col("stroked"), edges).otherwise(none)
    return paths.select("doc_id", "page", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("doc_id", "page", "r.*").groupBy("doc_id", "page", "axis", "at", "start", "end").agg(F.max("thickness").alias("thickness"))


def extract_fills(paths: DataFrame) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1 of filled rectangles thicker than a rule both ways, once each."""
    return paths.where("kind = 'rect' and filled").where((F.col("x1") - F.col("x0") > THIN) & (F.col("y1") - F.col("y0") > THIN)).select("doc_id", "page", *(F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1"))).distinct()


def page_findings(pages: DataFrame) -> DataFrame:
    """doc_id, page, code, severity: what the counts of a page give reason to say.

    pages: doc_id, page, words, unmapped, hidden_chars, visible_chars, clipped, overprinted, image_ratio; failed and type3 where known.
    """
    ocr = (F.col("hidden_chars") * 2 >= F.col("hidden_chars") + F.col("visible_chars")) & (F.col("hidden_chars") > 0) & (F.col("image_ratio") >= 0.5)
    def say(code: str, severity: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    found = F.array(
        F.when(F.col("failed"), say("unreadable_page", "error")) if "failed" in pages.columns else F.lit(None).cast("struct<code:string,severity:string>"),
        F.when((F.col("words") == 0) & (F.col("image_ratio") > 0), say("no_text_layer", "error")).when(F.col("words") == 0, say("blank_page", "info")),
        F.when((F.col("words") > 0) & (F.col("unmapped") > 0), say("partial_text_layer", "warning")),
        F.when(ocr, say("ocr_text_layer", "warning")).when(F.col("hidden_chars") > 0, say("hidden_text", "warning")),
        F.when(F.col("clipped") > 0, say("clipped_text", "info")),
        F.when(F.col("overprinted") > 0, say("overprinted_text", "info")),
        F.when(F.col("type3") > 0, say("type3_font", "warning")) if "type3" in pages.columns else F.lit(None).cast("struct<code:string,severity:string>"),
    )
    return pages.select("doc_id", "page", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("doc_id", "page", "f.code", "f.severity")


def warning_findings(warnings: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, detail: distinct warnings in the order first seen, ``most`` of them, and a count of the rest. warnings: doc_id, nth, message."""
    first = warnings.groupBy("doc_id", "message").agg(F.min("nth").alias("nth"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "message")))
    shown = ranked.where(F.col("n") <= most).select("doc_id", F.col("message").alias("detail"))
    rest = ranked.where(F.col("n") > most).groupBy("doc_id").agg(F.concat(F.count("*").cast("string"), F.lit(" more warnings")).alias("detail"))
    return shown.union(rest)


def summaries(findings: DataFrame) -> DataFrame:
    """doc_id, summary: ``code on page n``, comma-separated, in order. findings: doc_id, nth, code, page (or null)."""
    said = F.when(F.col("page").isNull(), F.col("code")).otherwise(F.concat("code", F.lit(" on page "), F.col("page").cast("string")))
    return findings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", said.alias("s")))), lambda x: x.s), ", ").alias("summary"))


def defect_summaries(defects: DataFrame, codes: list[str]) -> DataFrame:
    """doc_id, summary: how many defects, and of each code, in the codes' order. defects: doc_id, code."""
    place = F.array_position(F.array(*map(F.lit, codes)), F.col("code"))
    each = defects.groupBy("doc_id", "code").agg(F.count("*").alias("n")).withColumn("place", place)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "code", F.col("n").cast("string")).alias("s")))), lambda x: x.s), ", ")
    total = F.sum("n")
    return each.groupBy("doc_id").agg(F.concat(total.cast("string"), F.when(total == 1, " defect: ").otherwise(" defects: "), said).alias("summary"))
