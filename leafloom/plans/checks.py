"""Queries of the constraints: small documents, reports and readings, one fault in each, and SQL that states what each fault breaks."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from pyspark.sql import functions as F

from leafloom.functions import tokens as tk
from leafloom.operators import checks
from leafloom.plans.registry import Registry, spread, table

R = Registry()

_TEXTS = ["1.", "Title", "Pay", "the-", "re", "now", "1", "•", "item", "Item", "Qty", "A", "5", "(1)", "Note", "7", "B", "6", "End"]


def _document() -> dict:
    """A valid document of two pages: a heading, a paragraph with a hyphen and a call, a list item, a table that goes on, a note, furniture."""
    cells_at = {9: (10, 102), 10: (60, 102), 11: (10, 112), 12: (60, 112), 16: (10, 102), 17: (60, 102 + 10)}
    words = []
    for i, t in enumerate(_TEXTS):
        x, y = cells_at.get(i, (20 + 10 * i, 20 + 30 * (i % 2)))
        words.append({"id": i, "page": 1 if i < 16 else 2, "text": t, "superscript": i == 6, "x0": x, "y0": y, "x1": x + 8, "y1": y + 6})

    def block(k: int, kind: str, ids: list[int], text: str, **more) -> dict:
        return {"id": f"b{k}", "key": None, "kind": kind, "text": text, "label": None, "number": None, "markers": [], "words": ids, "joins": [], "regions": [{"page": words[ids[0]]["page"], "x0": 0, "y0": 0, "x1": 590, "y1": 400}], "grid": None} | more

    def cell(row: int, col: int, text: str, ids: list[int], source: list | None = None) -> dict:
        return {"row": row, "col": col, "rows": 1, "cols": 1, "carried": source is not None, "source": [{"row": r, "col": c} for r, c in source or []], "text": text, "words": ids}

    def grid(cells: list[dict]) -> dict:
        return {"n_rows": 2, "n_cols": 2, "row_bands": [{"start": 100, "end": 110}, {"start": 110, "end": 120}], "col_bands": [{"start": 0, "end": 50}, {"start": 50, "end": 100}], "header_rows": 1, "banner_rows": [], "frame": 0, "cells": cells}

    blocks = [
        block(1, "heading", [0, 1], "1. Title", number="1."),
        block(2, "paragraph", [2, 3, 4, 5, 6], "Pay there now 1", joins=[{"a": 3, "b": 4}], markers=["1"]),
        block(3, "list_item", [7, 8], "• item", label="•"),
        block(4, "table", [9, 10, 11, 12], "Item Qty\nA 5", grid=grid([cell(0, 0, "Item", [9]), cell(0, 1, "Qty", [10]), cell(1, 0, "A", [11]), cell(1, 1, "5", [12])])),
        block(5, "footnote", [13, 14], "(1) Note", label="1"),
        block(6, "furniture", [15], "7"),
        block(7, "table", [16, 17], "B 6", grid=grid([cell(0, 0, "Item", [], [(0, 0)]), cell(0, 1, "Qty", [], [(0, 1)]), cell(1, 0, "B", [16]), cell(1, 1, "6", [17])])),
        block(8, "paragraph", [18], "End"),
    ]
    words[16]["y0"], words[16]["y1"] = 112, 118
    page = lambda n: {"number": n, "width": 600, "height": 800, "text_layer": "full", "unmapped": 0, "invisible": 2, "clipped": 1, "overprinted": 0}
    links = [
        {"kind": "footnote_call", "source": "b2", "cell": None, "target": "b5", "label": "1", "method": "superscript", "status": "resolved", "reason": None},
        {"kind": "continuation", "source": "b7", "cell": None, "target": "b4", "label": None, "method": None, "status": "resolved", "reason": None},
    ]
    content = sum(len(t) for i, t in enumerate(_TEXTS) if i != 15)
    return {"declared": 2, "pages": [page(1), page(2)], "words": words, "blocks": blocks, "links": links, "findings": [{"code": "hidden_text", "page": 1, "block": "b2"}], "ledger": {"content": content, "furniture": 1, "invisible": 4, "clipped": 2, "overprinted": 0}}


def _put(*path):
    """A fault: the value at the end of the path."""
    *way, last, value = path

    def run(d: dict) -> None:
        for k in way:
            d = d[k]
        d[last] = value

    return run


def _all(*faults: Callable[[dict], None]) -> Callable[[dict], None]:
    return lambda d: [f(d) for f in faults]


def _box(word: int, **change) -> Callable[[dict], None]:
    return lambda d: d["words"][word].update(change)


_B2, _B4, _B7 = ("blocks", 1), ("blocks", 3), ("blocks", 6)
_CELLS = (*_B4, "grid", "cells")
_REGION = {"x0": 0, "y0": 0, "x1": 590, "y1": 400}

#: Each fault of a document, and the constraints that it breaks.
FAULTS: list[tuple[Callable[[dict], None], list[str]]] = [
    (lambda d: None, []),
    (_put("declared", 3), ["pages_and_words"]),
    (_put("words", 5, "id", 99), ["pages_and_words"]),
    (_put("pages", 0, "text_layer", "partial"), ["pages_and_words"]),
    (_put("pages", 1, "number", 3), ["pages_and_words"]),
    (_put("blocks", 7, "words", [18, 5]), ["word_partition", "text", "regions", "ledger"]),
    (_all(_put("blocks", 2, "words", [7]), _put("blocks", 2, "text", "•")), ["word_partition", "ledger"]),
    (_put("blocks", 2, "id", "b9"), ["block_identity"]),
    (_put("blocks", 7, "key", "twice"), ["block_keys", "block_identity"]),
    (_put("blocks", 7, "key", "wrong"), ["block_keys"]),
    (_put("links", 0, "target", "b77"), ["links"]),
    (_put("links", 1, "cell", {"row": 5, "col": 5}), ["links"]),
    (_put("links", 0, "target", "b8"), ["links"]),
    (_all(_put("links", 1, "source", "b4"), _put("links", 1, "target", "b7")), ["links", "carried"]),
    (_put("blocks", 7, "text", "Edn"), ["text"]),
    (_put(*_B2, "joins", [{"a": 4, "b": 5}]), ["text"]),
    (_put("blocks", 2, "label", "x"), ["text"]),
    (_put("blocks", 4, "label", "2"), ["text"]),
    (_put("blocks", 0, "number", "2."), ["text"]),
    (_put(*_B2, "markers", []), ["text"]),
    (_box(18, y0=500, y1=506), ["regions"]),
    (_put("blocks", 7, "regions", [{"page": 1, **_REGION}, {"page": 2, **_REGION}]), ["regions"]),
    (_box(12, x0=120, x1=128), ["cells"]),
    (_put(*_CELLS, 3, "text", "6"), ["cells"]),
    (_put(*_B7, "grid", "cells", 0, "text", "Itme"), ["carried"]),
    (_all(_put(*_B7, "grid", "cells", 0, "source", [{"row": 1, "col": 0}]), _put(*_B7, "grid", "cells", 0, "text", "A")), ["carried"]),
    (_put("findings", 0, "page", 9), ["findings"]),
    (_put("findings", 0, "block", "b99"), ["findings"]),
    (_put("ledger", "content", 1), ["ledger"]),
    (_put("ledger", "clipped", 7), ["ledger"]),
    (_put(*_B4, "grid", "row_bands", 0, "end", 112), ["grid"]),
    (_put(*_B4, "grid", "header_rows", 3), ["grid"]),
    (_put(*_B4, "grid", "banner_rows", [1, 1]), ["grid"]),
    (lambda d: d["blocks"][3]["grid"]["cells"].pop(), ["grid", "table_words"]),
    (_put(*_CELLS, 0, "cols", 2), ["grid"]),
    (_put(*_B4, "words", [10, 9, 11, 12]), ["table_words", "text"]),
    (_put(*_B7, "grid", "cells", 0, "words", [18]), ["table_words", "cell_rules"]),
    (_put(*_CELLS, 0, "source", [{"row": 0, "col": 0}]), ["cell_rules"]),
    (_put(*_CELLS, 3, "text", "5 "), ["cell_rules"]),
    (_put(*_B2, "joins", [{"a": 3, "b": 4}] * 2), ["block_shape"]),
    (_put("blocks", 7, "text", "End "), ["block_shape"]),
    (_put(*_B2, "regions", [{"page": 1, **_REGION}] * 2), ["block_shape"]),
    (_put(*_B2, "joins", [{"a": 3, "b": 4}, {"a": 8, "b": 9}]), ["block_shape", "text"]),
    (_put("links", 0, "target", None), ["link_status"]),
    (_put("links", 0, "status", "unresolved"), ["link_status"]),
    (_all(_put("links", 0, "status", "rejected"), _put("links", 0, "target", None)), ["link_status"]),
    (_put("links", 0, "label", None), ["link_status"]),
    (_put("links", 1, "method", "x"), ["link_status"]),
    (_all(_put("links", 1, "status", "unresolved"), _put("links", 1, "target", None)), ["link_status", "carried"]),
]


def _report() -> dict:
    check = {"number": 1, "status": "verified", "ink": 20, "owned": 15, "lost": 2, "outside": 1, "clipped": 1, "soft_hyphens": 0, "unmapped": 0, "declared": 0, "overflow": 3, "ligatures": 1, "overlay": 0, "overprint": 1, "rules": 4}
    none = dict.fromkeys(check, 0)
    defect = lambda code, page, **more: {"code": code, "page": page, "block": None, "cell": None, "text": ""} | more
    return {
        "checks": [check, none | {"number": 2, "status": "declared", "ink": 5, "declared": 5}, none | {"number": 3, "status": "unverified"}],
        "defects": [defect("lost", 1, text="ab"), defect("vrule", 1, block="b1", cell=[0, 1]), defect("unverified", 3)],
        "advisories": [defect("order", 1, block="b1", cell=[0, 0], text="x")],
    }


REPORT_FAULTS: list[tuple[Callable[[dict], None], list[str]]] = [
    (lambda d: None, []),
    (_put("checks", 1, "number", 5), ["page_numbers"]),
    (_put("defects", 1, "page", 9), ["page_numbers"]),
    (_put("checks", 0, "owned", 16), ["page_accounts"]),
    (_put("checks", 1, "declared", 4), ["page_accounts"]),
    (_put("checks", 2, "rules", 1), ["page_accounts"]),
    (_put("defects", 1, "block", None), ["defect_fields"]),
    (_put("defects", 1, "cell", None), ["defect_fields"]),
    (_put("defects", 0, "text", ""), ["defect_fields", "lost_chars"]),
    (lambda d: d["defects"].append(d["advisories"].pop()), ["roles"]),
    (lambda d: d["advisories"].append(d["defects"].pop(1)), ["roles"]),
    (_put("defects", 0, "text", "abc"), ["lost_chars"]),
    (lambda d: d["defects"].pop(), ["unverified_pages"]),
]

_READING = {
    "pages": [{"number": 1, "words": [0, 1, 2]}, {"number": 2, "words": []}, {"number": 3, "words": [3]}], "read": [1, 3], "findings": [{"code": "blank_page", "page": 2}],
    "grids": [{"page": 1, "frame": {"x0": 0, "y0": 0, "x1": 9, "y1": 9}, "core": {"x0": 1, "y0": 1, "x1": 8, "y1": 8}, "cells": [{"x0": 0, "y0": 0, "x1": 9, "y1": 4}]}, {"page": 3, "frame": {"x0": 0, "y0": 0, "x1": 9, "y1": 9}, "core": None, "cells": []}],
}
READING_FAULTS: list[tuple[Callable[[dict], None], list[str]]] = [
    (lambda d: None, []),
    (_put("pages", 1, "number", 4), ["reading_pages"]),
    (_put("pages", 2, "words", [4]), ["reading_words"]),
    (_put("findings", 0, "page", 4), ["reading_findings"]),
    (_put("grids", 1, "page", 2), ["lattice_pages"]),
    (_put("grids", 0, "cells", 0, "x1", 0), ["lattice_cells"]),
    (_put("grids", 0, "core", "y1", 10), ["lattice_core"]),
]


def stated(faults: list) -> str:
    """SQL: a row for each rule that the fault of each part breaks."""
    rows = ", ".join(f"({i}, '{rule}')" for i, (_, rules) in enumerate(faults) for rule in rules)
    return f"SELECT p_partkey AS doc, f.rule FROM part JOIN (VALUES {rows}) f(fault, rule) ON p_partkey % {len(faults)} = f.fault"


def faulty(spark, sf, valid: dict, faults: list, kind: str, made: Callable = lambda d: d):
    """doc, d: a document for each part, with the fault of its key. Each fault's is read (and ``made`` of what was read) once, and goes to the parts as it is; the parts are dealt over all tasks."""
    stored = []
    for fault, _ in faults:
        d = copy.deepcopy(valid)
        fault(d)
        stored.append(json.dumps(d))
    held = spark.createDataFrame(list(enumerate(stored)), "fault long, json string").select("fault", F.from_json("json", kind).alias("d"))
    parts = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_partkey") % len(faults)).alias("fault")))
    return parts.join(F.broadcast(held.select("fault", made(F.col("d")).alias("d"))), "fault").select("doc", "d")


@R.add(stated(FAULTS))
def constraint_violations(spark, sf):
    key = lambda b: tk.content_key(b.kind, b.text)
    keyed = lambda d: d.withField("blocks", F.transform(d.blocks, lambda b: b.withField("key", F.when(b.key == "twice", key(F.get(d.blocks, 1))).otherwise(F.coalesce(b.key, key(b))))))
    return checks.document_violations(faulty(spark, sf, _document(), FAULTS, checks.DOCUMENT, keyed).withColumnRenamed("d", "document"))


@R.add(stated(REPORT_FAULTS))
def report_violations(spark, sf):
    return checks.report_violations(faulty(spark, sf, _report(), REPORT_FAULTS, checks.REPORT).withColumnRenamed("d", "report"))


@R.add(stated(READING_FAULTS))
def reading_violations(spark, sf):
    return checks.reading_violations(faulty(spark, sf, _READING, READING_FAULTS, checks.READING).withColumnRenamed("d", "reading"))
