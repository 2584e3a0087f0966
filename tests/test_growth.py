"""What grows with the tables: work that must stay in proportion, and steps that must not be made twice."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafloom.config import Profile
from leafloom.functions import tokens as tk
from leafloom.operators import checks, corridor, furniture, grids, layout, links, reader, scoring, verify
from leafloom.plans import catalog
from leafloom.sources import formats, typeset


def evaluations(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_plain_marks_are_read_as_the_parser_reads_them():
    r = random.Random(5)
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", '<td colspan="2">', '<TH rowspan="3" class="a b">', "<td rowspan=2>", "<br>", "<br/>", "a &amp; b", "&lt", "&", "<", "x", "<title>", "</title>", "<!-- c -->"]
    for _ in range(3000):
        source = "".join(r.choice(pieces) for _ in range(r.randrange(12)))
        parser = formats._Events()
        parser.feed(source)
        parser.close()
        shown = lambda rows: [(w, t, dict(v) if w == "begin" else v) for w, t, v in rows if w != "data"]
        said = lambda rows: "".join(v if w == "data" else "\0" for w, _, v in rows)
        found = formats._events(source)
        assert shown(found) == shown(parser.rows) and said(found) == said(parser.rows)


def test_tables_are_read_in_well_under_a_millisecond_each():
    source = "<table>" + ("<tr>" + "<td>$1,000.00</td>" * 4 + "</tr>") * 5 + "</table>"
    cells = [{"row": k // 2, "col": k % 2, "rows": 1, "cols": 2, "text": "", "header": False} for k in range(6)]
    began = time.perf_counter()
    for _ in range(500):
        formats.cells_of_html(source)
        formats.untangle(cells)
    assert time.perf_counter() - began < 2.5  # 6 s, when each was a pandas frame


@pytest.mark.parametrize("name", ["html_table_cells", "pipe_table_cells", "block_tree_tables", "element_tables", "converter_tables"])
def test_tables_are_read_once(spark, data, name):
    assert evaluations(catalog.QUERIES[name](spark, data)) == 1


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["chart_numbers", "strong_value_tokens", "value_pieces"])
def test_tokens_are_told_apart_before_they_are_matched(spark, data, name):
    p = plan(catalog.QUERIES[name](spark, data))
    below = "".join(p.split("Aggregate")[-2:])  # the grouping of tokens, and that of the sales
    assert "RLIKE" not in below and "regexp_extract" not in below
    # a part's key is no more than its remainder when the sales are grouped
    assert "% 1000" in p[p.rindex("Aggregate") :]


def test_access_paths_are_made_without_joins_and_a_separator_is_found_once_a_file(spark, data):
    p = plan(catalog.QUERIES["access_path_rows"](spark, data))
    assert "Join" not in p
    assert not any("regexp_replace" in line for line in p.split("\n") if "Filter" in line)


def test_access_paths_of_a_long_file(spark):
    text = "\n".join(['"0";;', *(f'"a {i}";"b;c";;"d";"{i}"' for i in range(2000))])
    found = formats.access_path_rows(spark.createDataFrame([(1, text), (2, '7\n"x","1"\n\n8\n"y","2"'), (3, None)], "doc long, text string")).collect()
    assert len(found) == 2002
    assert {(r.value, tuple(map(tuple, r.dimensions))) for r in found if r.doc == 1} == {(str(i), ((f"a {i}", "b;c"), ("d",))) for i in range(2000)}
    assert [(r.tbl, r.value) for r in sorted(found, key=lambda r: r.nth) if r.doc == 2] == [(0, "1"), (1, "2")]


def test_marks_find_their_lines_as_a_search_of_all_lines_does():
    r = random.Random(6)
    profile = Profile()
    moved = 0
    for _ in range(300):
        words = []
        for i in range(r.randrange(1, 25)):
            mark = r.random() < 0.4
            x, y = r.randrange(12) * 10.0, r.randrange(14) * 5.0 + r.choice([0, -3.6, 1.5])
            words.append(layout.Word(i, x, y, x + (3 if mark else 10), y + (6.0 if mark else r.choice([9.0, 10.0, 40.0])), "a", 10.0, mark))
        found = layout.lines_of(words, profile)
        plain = layout.lines_of([layout.Word(w.id, w.x0, w.y0, w.x1, w.y1, "a", 10.0) for w in words], profile)  # no word is a mark
        line = {w.id: k for k, own in enumerate(plain) for w in own}
        home = {w.id: k for k, own in enumerate(found) for w in own}
        for m in (w for w in words if w.superscript):
            if any(w.id != m.id and line[w.id] == line[m.id] and (layout.glued(w, m) or layout.glued(m, w)) for w in words):
                continue
            near = [w for w in words if not w.superscript and line[w.id] != line[m.id] and layout.glued(w, m)]
            assert not near or any(home[w.id] == home[m.id] for w in near)
            moved += bool(near)
    assert moved > 20


def test_marks_of_a_long_page_find_their_lines_in_time():
    words = []
    for k in range(4000):
        y, end = 10.5 * k, 150.0 + 20 * (k % 2)
        words += [layout.Word(2 * k, 100.0, y, end, y + 10, "5.0%", 10.0), layout.Word(2 * k + 1, end, y - 3.6, end + 3, y + 2.4, "1", 6.0, True)]
    began = time.perf_counter()
    found = layout.lines_of(words, Profile())
    assert time.perf_counter() - began < 3  # 10 s, when each mark searched all lines
    assert [[w.id for w in line] for line in found] == [[2 * k, 2 * k + 1] for k in range(4000)]


def test_a_batch_of_pages_is_read_in_few_objects_at_a_time(monkeypatch):
    held, most = [0], [0]

    class Counted(list):
        def __init__(self, *x):
            super().__init__(*x)
            held[0] += len(self)
            most[0] = max(most[0], held[0])

        def __del__(self):
            held[0] -= len(self)

    run = grids.in_slices(lambda x: [x], pa.list_(pa.int64()))
    monkeypatch.setattr(grids, "_listed", lambda c: Counted(c.to_pylist()))
    got = run(pa.array(range(10_000)))
    assert got.to_pylist() == [[x] for x in range(10_000)] and most[0] <= 2 * grids.ROWS
    assert len(run(pa.array([], pa.int64()))) == 0


def test_equal_texts_and_boxes_meet_once(spark):
    """Five thousand tables alike: 25 million pairs, if each met each."""
    n = 5000
    t = spark.range(n).selectExpr("1 AS doc", "1 AS tbl", "1 AS page", "id AS t", "'a b c' || id % 2 AS text", "1.0D AS x0", "1.0D AS y0", "5.0D AS x1", "double(5 + id % 2) AS y1")
    f = spark.range(n).selectExpr("1 AS doc", "1 AS tbl", "1 AS page", "id AS f", "'abd' || id % 2 AS text", "2.0D AS x0", "1.0D AS y0", "6.0D AS x1", "double(5 + id % 2) AS y1")
    errors = scoring.character_errors(t, f)
    matched = scoring.best_match(t, f)
    assert {(r.chars, r.errors) for r in errors.collect()} == {(4, 1)} and errors.count() == n
    # by area, ties to the smaller found one
    assert {(r.t % 2, r.f) for r in matched.collect()} == {(0, 0), (1, 1)} and matched.count() == n
    for df in (errors, matched):
        p = plan(df)
        assert "Aggregate" in p[p.rindex("Join") :].split("Range")[0]  # both sides are grouped before they meet


def test_ink_moves_once_to_be_placed(spark):
    """One join of the ink, with its table's cells and extent by bands, and no grouping of the ink."""
    ink = spark.range(40).selectExpr("1 AS tbl", "id AS ink", "'c' AS c", "id * 5.0D AS cx", "10.0D AS cy")
    cells = spark.range(3).selectExpr("1 AS tbl", "0L AS row", "id AS col", "id * 50.0D AS x0", "0.0D AS y0", "id * 50.0D + 40 AS x1", "60.0D AS y1", "false AS carried")
    found = verify.placed(ink, cells)
    assert plan(found).count("Join") == 2
    got = {r.ink: (r.n, r.col, r.inside) for r in found.collect()}
    assert got == {k: ((1, k * 5 // 50, True) if k * 5 % 50 < 40 and k * 5 < 150 else (0, None, k * 5 < 140)) for k in range(40)}


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_set_without_a_sort_of_their_words(spark):
    odd = [(1, "a  b\n\nc,  d"), (2, None), (3, ""), (None, "x"), (4, "T\n\n\n\n" + "word, " * 40 + "\n \nz" * 130), (5, "w" * 300 + " v " + "u" * 200)]
    documents = spark.createDataFrame(odd, "doc_id long, text string")
    words = typeset.prose_words(documents)
    assert "Sort" not in executed(words) and "Window" not in executed(words) and executed(words.groupBy("doc_id", "page").count()).count("Exchange") == 2  # of texts and of lines
    import duckdb

    frame = documents.toPandas()  # noqa: F841
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    wanted = duckdb.sql(f"WITH documents AS (SELECT doc_id::BIGINT AS doc_id, text FROM frame), {typeset.PROSE_WORDS_SQL} SELECT doc_id, id, page, line, par, x0, y0, x1, y1, text, size, bold FROM words ORDER BY 1, 2").fetchall()
    assert [tuple(r) for r in words.orderBy("doc_id", "id").collect()] == wanted


def test_lines_move_once_to_be_told_as_furniture(spark, monkeypatch):
    lines = spark.createDataFrame([(d, p, p * 2 + k, ("Head 1", "body")[k], 40.0 + 50 * k, 50.0 + 50 * k, 72.0, 90.0, 1, False, 792.0) for d in (1, 2) for p in (1, 2, 3) for k in (0, 1)], "doc_id long, page long, line long, text string, top double, bottom double, x0 double, x1 double, parts long, tabled boolean, page_height double")
    seen = []
    monkeypatch.setattr(furniture, "stored", lambda df: seen.append(executed(df)) or df)
    found = furniture.find_furniture(lines.repartition(3)).collect()
    assert seen[0].count("Exchange hashpartitioning") == 1 and "Join" not in seen[0]
    assert sorted((r.doc_id, r.page, r.key, r.role) for r in found) == [(d, p, k, r) for d in (1, 2) for p in (1, 2, 3) for k, r in (("Head", "header"), ("body", "header"))]


def test_a_line_is_keyed_alike_whether_or_not_it_is_taken_apart(spark):
    r = random.Random(3)
    pieces = ["Acme", "12", "iv", "Page", "of", "é", "(3)", "X", "report7", "mix", "-", "#", "a1b2", "Ünder", "mm", "", "十二"]
    rows = [(" ".join(r.choice(pieces) for _ in range(r.randrange(1, 5))),) for _ in range(600)]
    df = spark.createDataFrame(rows, "text string").select(tk.text_key(F.col("text")).alias("a"), tk.line_key(F.split("text", " ")).alias("b"))
    assert df.where("not (a <=> b)").count() == 0


def test_words_are_looked_at_once_to_prove_their_partition(spark):
    words = spark.createDataFrame([(1, k, 1, k // 2, f"w{k}", 10.0 * k, 0.0, 10.0 * k + 5, 9.0) for k in range(6)], "doc_id long, id long, page long, line long, text string, x0 double, y0 double, x1 double, y1 double")
    block = lambda b, first, n, text: (1, b, 1, first, n, 0.0, 100.0, 0.0, 9.0, text, "k", "paragraph")
    # two blocks begin at one line; the last line is in none
    blocks = spark.createDataFrame([block(1, 0, 1, "w0 w1"), block(2, 1, 1, "w2 w3"), block(3, 1, 1, "other")], "doc_id long, block long, page long, first_line long, n_lines long, x0 double, x1 double, top double, bottom double, text string, key string, kind string")
    found = checks.document_checks(words, blocks, None)
    assert {r.rule: r.violations for r in found.collect()} == {"word_ids": 0, "word_partition": 4, "block_keys": 3, "text_spelling": 1, "region_containment": 0, "text_shape": 0}
    assert "Join" not in executed(found)  # words are joined with nothing


def test_characters_of_a_line_make_words_without_a_sort_among_lines(spark):
    r = random.Random(11)
    rows = []
    for line in range(40):
        x, drawn = 0.0, []
        for k in range(r.randrange(1, 25)):
            wide, mark = r.choice((5.0, 3.0)), r.random() < 0.2
            drawn.append((1, 1, line, k // 4, k, r.choice("ab é ,"), x, 2.0 if mark else 4.0, x + wide, 8.0 if mark else 14.0, 6.0 if mark else 10.0, r.random() < 0.5, mark))
            x += wide + r.choice((0.0, 0.0, 0.5, 3.0, -2.0))
        r.shuffle(drawn)
        rows += drawn
    names = "doc_id long, page long, line long, span long, char long, c string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, superscript boolean"
    chars = spark.createDataFrame(rows, names)
    found = sorted((w.line, w.word, w.text, w.x0, w.x1, w.y0, w.y1, w.size) for w in reader.build_words(chars).collect())
    wanted = []
    for line in range(40):
        word, last, runs = 0, None, {}
        for c in sorted((c for c in rows if c[2] == line), key=lambda c: c[4]):
            blank = c[5] in "  "
            if last is not None:
                over, low, gap = min(last[9], c[9]) - max(last[7], c[7]), min(last[9] - last[7], c[9] - c[7]), c[6] - last[8]
                near = -1 - 1e-6 <= gap <= 0.6 + 1e-6 and over >= 0.3 * low - 1e-6
                raised = last[10] <= 0.92 * c[10] and c[9] - last[9] > 0.2 * c[10]
                word += last[5] in "  " or (last[3] != c[3] and (not near or raised or last[12] != c[12]))
            else:
                word = 1
            if not blank:
                runs.setdefault(word, []).append(c)
            last = c
        for k, cs in runs.items():
            spans = sorted({c[3] for c in cs}, key=lambda s: (-sum(c[3] == s for c in cs), s))
            sizes = {c[10] for c in cs if c[3] == spans[0]}
            wanted.append((line, k, "".join(c[5] for c in cs), min(c[6] for c in cs), max(c[8] for c in cs), min(c[7] for c in cs), max(c[9] for c in cs), sizes))
    assert [f[:7] for f in found] == [w[:7] for w in sorted(wanted, key=lambda w: w[:2])]
    assert all(f[7] in w[7] for f, w in zip(found, sorted(wanted, key=lambda w: w[:2]), strict=True))
    lines = chars.groupBy("doc_id", "page", "line").agg(F.collect_list(F.struct(*reader.CHAR)).alias("chars")).localCheckpoint()
    assert "Sort" not in executed(reader.line_words(lines)) and "Exchange" not in executed(reader.line_words(lines))


def test_lines_are_joined_by_document_alone_to_be_put_in_blocks(spark, data):
    joins = [line for line in executed(catalog.QUERIES["typed_blocks"](spark, data)).splitlines() if "Join" in line]
    assert joins and all("half" not in line for line in joins)


def test_a_run_of_many_lines_needs_no_matrix_of_them():
    """Six hundred rows of ten values, each wrapped once: matrices of their pieces took over 100 MB."""
    n, columns = 1200, 10
    words = []
    for k in range(n):
        for c in range(columns if k % 2 == 0 else 1):
            words.append(layout.Word(len(words), 70.0 + 50 * c, 100.0 + 12 * k - k % 2, 100.0 + 50 * c, 110.0 + 12 * k - k % 2, "$5" if k % 2 == 0 and c else "label", 10.0))
    lines = layout.lines_of(words, Profile())
    tracemalloc.start()
    rows = corridor.Fold(lines, [("h", 5.0, 0.0, 600.0)], Profile()).rows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [[k, k + 1] for k in range(0, n, 2)] and peak < 20_000_000


def test_columns_of_arrays_are_read_as_they_are():
    one = {"id": 1, "x": 2.5, "t": "a", "b": True, "n": None, "of": [{"q": 1.0}, {"q": None}]}
    kind = pa.list_(pa.struct([("id", pa.int64()), ("x", pa.float64()), ("t", pa.string()), ("b", pa.bool_()), ("n", pa.int32()), ("of", pa.list_(pa.struct([("q", pa.float64())])))]))
    held = [[one, one | {"of": None}], None, [], [one | {"of": []}, None], [one | {"n": 3, "t": None}]] * 7
    column = pa.array(held, kind)
    for k in range(len(held)):
        assert grids._listed(column.slice(k, 9)) == held[k : k + 9]
    assert grids._listed(pa.array([], kind)) == []


def test_calls_meet_the_first_note_ahead_not_all(spark):
    """Calls and notes of a label pass each other once, in order; also where pages don't follow the order."""
    r = random.Random(3)
    sites = [(d, k, None if k % 50 == 0 else r.randrange(40), r.randrange(5), r.choice("abcd"), r.randrange(7)) for d in (1, 2) for k in range(150)] + [(3, 1, 1, 1, None, 1)]
    notes = [(d, r.choice("aaabbc"), r.randrange(40), r.randrange(5)) for d in (1, 2) for _ in range(25)] + [(1, "d", 20, 2), (3, None, 5, 1), (3, "a", None, 1)]
    notes = list({(d, label, order): page for d, label, order, page in notes}.items())
    notes = [(*key, page) for key, page in notes]
    s = spark.createDataFrame(sites, "doc long, site long, order long, page long, label string, through long")
    n = spark.createDataFrame(notes, "doc long, label string, order long, page long")
    for through in (True, False):
        got = links.resolve(s if through else s.drop("through"), n)
        wanted = {}
        for doc, site, order, page, label, last in sites:
            own = [(o, p) for d, x, o, p in notes if d == doc and x == label and label is not None and o is not None]
            first = min(((o, p) for o, p in own if order is not None and o > order and p >= page), default=None)
            end = max(page, last) if through else page
            wanted[doc, site] = first[0] if first and (len(own) == 1 or first[1] <= end + 1) else None
        assert {(x.doc, x.site): x.note for x in got.collect()} == wanted and got.count() == len(sites)
        assert plan(got).count("Join ") == 1 and "early" in plan(got)[plan(got).index("Join ") :].split("\n")[0]


def test_ink_meets_its_words_without_being_grouped(spark):
    ink = spark.range(60).selectExpr("id % 2 AS doc_id", "1 AS page", "id AS ink", "'c' AS c", "id * 5.0D AS cx", "10.0D + id % 3 * 20 AS cy")
    words = spark.range(12).selectExpr("id % 2 AS doc_id", "1 AS page", "id", "id * 25.0D AS x0", "5.0D AS y0", "id * 25.0D + 60 AS x1", "35.0D AS y1")
    found = verify.owners(ink, words)
    assert plan(found).count("Aggregate") == 1 and "ink" not in [x for x in plan(found).split("\n") if "Aggregate" in x][0]
    boxes = [(w.doc_id, w.id, w.x0, w.y0, w.x1, w.y1) for w in words.collect()]
    for i in ink.join(found, ["doc_id", "ink"]).collect():
        held = [k for d, k, x0, y0, x1, y1 in boxes if d == i.doc_id and x0 <= i.cx < x1 and y0 <= i.cy < y1]
        assert (i.n, i.word) == (len(held), held[0] if len(held) == 1 else None)
    assert found.count() == 60
