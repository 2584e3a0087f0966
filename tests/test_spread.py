"""Work in Python over all tasks, and no broadcast of what grows with the tables."""

import pytest

from leafloom.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kinds_of_sections", "folded_rows", "wrapped_corridors"])
def test_pages_are_dealt_over_all_tasks_and_never_broadcast(spark, data, name):
    p = plan(catalog.QUERIES[name](spark, data))
    assert "Broadcast" not in p
    # Spark puts no tasks together where the number of partitions was asked for
    below = p[p.index("ArrowEvalPython") :]
    assert "REPARTITION_BY_NUM" in below


def test_what_is_kept_is_joined_by_sorting(spark):
    """Pages of two words each come from a few bytes: Spark estimates them as small, whatever they have become."""
    from pyspark.sql import functions as F

    from leafloom.sources import stored

    words = stored.kept(spark.range(3).select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")))
    p = plan(words.where("k = 0").join(spark.range(3), "id"))
    assert "SortMergeJoin" in p and "Broadcast" not in p


@pytest.mark.parametrize("name", ["tabled_lines"])
def test_cells_and_lines_are_not_broadcast(spark, data, name):
    """A part's row becomes a dozen words and eight cells, of which Spark's estimate from the file tells nothing."""
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, data))


@pytest.mark.parametrize("name", ["tables_on_pages", "tables_left_as_text"])
def test_no_words_of_pages_are_broadcast(spark, data, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, data))


@pytest.mark.parametrize("name", ["constraint_violations", "report_violations", "reading_violations"])
def test_stored_documents_are_dealt_over_all_tasks_and_read_once(spark, data, name):
    """A document of each fault is read before it meets the parts, not once for each of them."""
    p = plan(catalog.QUERIES[name](spark, data))
    assert "REPARTITION_BY_NUM" in p
    assert p.index("BroadcastExchange") < p.index("from_json")
    assert "from_json" not in p[: p.index("BroadcastExchange")]


@pytest.mark.parametrize("name", ["bar_charts", "lattice_order", "chart_axes", "merged_cells", "grid_tilings", "cut_and_split", "boundary_votes", "boxes_to_cells", "table_roles", "footnote_calls"])
def test_fixtures_of_parts_are_dealt_over_all_tasks(spark, data, name):
    assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES[name](spark, data))


def test_words_of_corridors_move_by_table_alone(spark, data):
    """Once shuffled by table, words stay where they are: nothing is shuffled by lines or pieces."""
    import re

    from leafloom.operators import tables

    words = spark.range(40).selectExpr("id % 4 AS tbl", "double(id) AS x0", "double(id) AS y0", "id + 1.0D AS x1", "id + 1.0D AS y1", "string(id) AS text")
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(tables.corridor_cells(words)))
    assert moved and all(re.fullmatch(r"tbl#\d+L?, \d+", m) for m in moved)


def test_a_register_admits_labels_before_they_are_rows(spark):
    """Blocks and registers are shuffled by document alone, and rows of one label and place are told once."""
    import re

    from leafloom.operators import links

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = spark.createDataFrame([(1, 1, "Fee (3) and (4) and (3)"), (1, 1, "Fee (3) and (4) and (3)"), (2, 1, "Fee (4)"), (3, 1, "Fee (5)")], "doc long, order long, text string")
        got = links.parenthetical_calls(blocks, spark.createDataFrame([(1, "3"), (1, "3"), (2, "5"), (3, "5")], "doc long, label string"))
        assert sorted((r.doc, r.label, r.at) for r in got.collect()) == [(1, "3", 4), (1, "3", 20), (3, "5", 4)]
        assert all(re.match(r"doc#\d+L?, \d+", m) for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(got)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
