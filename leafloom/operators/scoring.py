"""Pooled and averaged metrics, clustered bootstrap intervals, and matching of tables. Undefined is null, never 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pooled(numerator: str, denominator: str) -> Column:
    return F.try_divide(F.sum(numerator), F.nullif(F.sum(denominator), F.lit(0)))


def mean_of(numerator: str, denominator: str) -> Column:
    return F.avg(F.when(F.col(denominator) != 0, F.col(numerator) / F.nullif(F.col(denominator), F.lit(0))))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 0.0).otherwise(2 * a * b / F.nullif(a + b, F.lit(0.0)))


def dice(both: str, a: str, b: str) -> Column:
    return F.try_divide(2 * F.sum(both), F.nullif(F.sum(a) + F.sum(b), F.lit(0)))


def macro(*metrics: Column) -> Column:
    total = metrics[0]
    for m in metrics[1:]:
        total = total + m
    return total / len(metrics)


def draw(key: Column, n: Column) -> Column:
    """A number under n from a digest: the same in every engine, with no generator's state."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n


HELD = 1_000_000  # documents whose counts may be broadcast, 40 bytes each


def _beside(n: int, counts: DataFrame) -> DataFrame:
    """Counts of up to ``HELD`` documents go to every draw, so that no draw is shuffled before its sums are made; more are joined."""
    return F.broadcast(counts) if n <= HELD else counts


def bootstrap(counts: DataFrame, draws: int, seed: int = 20260928) -> DataFrame:
    """draw, value: the pooled metric of each resample of the documents. counts: i (0 to n - 1), num, den."""
    n = counts.count()
    places = counts.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("slot"))
    chosen = places.withColumn("i", draw(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")), F.lit(n)))
    return chosen.join(_beside(n, counts), "i").groupBy("draw").agg(pooled("num", "den").alias("value"))


def interval(drawn: DataFrame) -> DataFrame:
    return drawn.agg(F.expr("percentile(value, 0.025)").alias("low"), F.expr("percentile(value, 0.975)").alias("high"))


def best_match(truth: DataFrame, found: DataFrame) -> DataFrame:
    """doc, t, f: for each true table the found one of largest overlap. Both: doc, page, t or f, x0, y0, x1, y1."""
    box = ("x0", "y0", "x1", "y1")
    # boxes that several tables have meet once; of found ones the first stands for all
    f = found.groupBy("doc", "page", *box).agg(F.min("f").alias("f")).select("doc", "page", "f", *(F.col(c).alias(f"f{c}") for c in box))
    w = F.least("x1", "fx1") - F.greatest("x0", "fx0")
    h = F.least("y1", "fy1") - F.greatest("y0", "fy0")
    first = F.max_by("f", F.struct(F.col("area"), -F.col("f"))).alias("f")
    met = truth.select("doc", "page", *box).distinct().join(f, ["doc", "page"]).withColumn("area", w * h).where((w > 0) & (h > 0)).groupBy("doc", "page", *box).agg(first, F.max("area").alias("area"))
    t = truth.select("doc", "page", "t", *(F.col(c).alias(f"t{c}") for c in box))
    same = [F.col(f"t{c}").eqNullSafe(F.col(c)) for c in box]
    return t.withColumnsRenamed({"doc": "doc_", "page": "page_"}).join(met, [F.col("doc_") == F.col("doc"), F.col("page_") == F.col("page"), *same]).groupBy("doc", "t").agg(first)


def top_of_group(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def character_errors(truth: DataFrame, found: DataFrame) -> DataFrame:
    """doc, t, chars, errors: the least edit distance, at most the text's length, from each true text to a found one of its document's matched table.

    truth: doc, tbl, t, text; found: doc, tbl, text.
    """
    glyphs = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    # texts that a table has several times are compared once
    said = truth.select("doc", "tbl", "t", glyphs("text").alias("said"))
    others = found.select("doc", "tbl", glyphs("text").alias("other")).distinct()
    least = said.select("doc", "tbl", "said").distinct().join(others, ["doc", "tbl"]).groupBy("doc", "tbl", "said").agg(F.min(F.levenshtein("said", "other")).alias("least"))
    long = F.length("said")
    return said.join(least, ["doc", "tbl", "said"], "left").groupBy("doc", "t").agg(F.max(long).cast("long").alias("chars"), F.min(F.least(F.coalesce("least", long), long)).cast("long").alias("errors"))


def dense_index(rows: DataFrame, key: str, name: str = "i") -> DataFrame:
    """rows with the place (from 0) of their key, which is unique: range partitions are ranked apart and set off by the sizes of those before."""
    from pyspark.sql import Window

    spread = rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    sizes = spread.groupBy("_part").count()  # a row a partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return spread.join(F.broadcast(before), "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before")


def paired(a: DataFrame, b: DataFrame, draws: int, seed: int = 20260928) -> DataFrame:
    """draw, value: the metric on a less that on b, each draw over the same resampled documents. Both: i, num, den of the same documents."""
    both = a.join(b.select("i", F.col("num").alias("num_b"), F.col("den").alias("den_b")), "i")
    n = both.count()
    places = both.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("slot"))
    chosen = places.withColumn("i", draw(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")), F.lit(n)))
    return chosen.join(_beside(n, both), "i").groupBy("draw").agg((pooled("num", "den") - pooled("num_b", "den_b")).alias("value"))


def is_finding(low: Column, high: Column) -> Column:
    """Whether a difference's interval leaves out 0."""
    return F.coalesce(~F.isnan(low) & ((low > 0) | (high < 0)), F.lit(False))


def _aligned(c: Column, anchor: Column) -> Column:
    """c stands above the anchor in a column that it covers, or left of it in a row."""
    across = (c.col < anchor.col + anchor.cols) & (anchor.col < c.col + c.cols)
    down = (c.row < anchor.row + anchor.rows) & (anchor.row < c.row + c.rows)
    return ((c.row + c.rows <= anchor.row) & across) | ((c.col + c.cols <= anchor.col) & down)


def bindings(paths: DataFrame, cells: DataFrame) -> DataFrame:
    """doc, tbl, path, value, leaf, bound: whether a table has a path's value, with the leaf of each of its dimensions above or left of it, and with the labels above these, each aligned with one below it.

    paths: doc, tbl, path, wanted (a text), dimensions (arrays of labels, outermost first); cells: doc, tbl, row, col, rows,
    cols, text. Texts are compared as they are given. A table's cells are one array.
    """
    held = cells.groupBy("doc", "tbl").agg(F.collect_list(F.struct("row", "col", "rows", "cols", "text")).alias("cells"))
    both = paths.join(held, ["doc", "tbl"], "left")
    every = F.coalesce(F.col("cells"), F.array().cast("array<struct<row:bigint,col:bigint,rows:bigint,cols:bigint,text:string>>"))

    def chain(value: Column, labels: Column) -> Column:
        """1 where the leaf is bound, 2 where all labels are, else 0."""
        leaves = F.filter(every, lambda c: (c.text == F.element_at(labels, -1)) & _aligned(c, value))

        def step(state: Column, label: Column) -> Column:
            more = F.filter(every, lambda c: (c.text == label) & F.exists(state.anchors, lambda a: _aligned(c, a)))
            return F.struct(F.concat(state.anchors, more).alias("anchors"), (state.ok & (F.size(more) > 0)).alias("ok"))

        outer = F.reverse(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
        whole = F.aggregate(outer, F.struct(leaves.alias("anchors"), F.lit(True).alias("ok")), step, lambda s: s.ok)
        return F.when(F.size(leaves) == 0, 0).when(whole, 2).otherwise(1)

    values = F.filter(every, lambda c: c.text == F.col("wanted"))
    reach = F.transform(values, lambda v: F.array_min(F.transform("dimensions", lambda d: chain(v, d))))
    best = F.coalesce(F.array_max(reach), F.lit(-1))
    return both.withColumn("best", best).select("doc", "tbl", "path", (F.col("best") >= 0).alias("value"), (F.col("best") >= 1).alias("leaf"), (F.col("best") >= 2).alias("bound"))


def binding_counts(found: DataFrame) -> DataFrame:
    """doc, paths, value, leaf, bound: counts over a document's paths; one bound in any of the tables that it is looked for in counts once."""
    best = found.groupBy("doc", "path").agg(F.bool_or("value").alias("value"), F.bool_or("leaf").alias("leaf"), F.bool_or("bound").alias("bound"))
    return best.groupBy("doc").agg(F.count("*").alias("paths"), *(F.count_if(c).alias(c) for c in ("value", "leaf", "bound")))


def access_paths(cells: DataFrame) -> DataFrame:
    """doc, tbl, row, col, value, rows, cols: each value's labels, from the outermost in: stub cells along its row, header cells up its column. cells: doc, tbl, row, col, rows, cols, text, header_rows, stub_cols."""
    held = cells.groupBy("doc", "tbl").agg(F.array_sort(F.collect_list(F.struct("row", "col", "rows", "cols", "text"))).alias("all"))
    v = cells.where("row >= header_rows and col >= stub_cols and text <> ''").select("doc", "tbl", F.struct("row", "col", "text").alias("v"), "header_rows", "stub_cols").join(held, ["doc", "tbl"])
    row, col = F.col("v.row"), F.col("v.col")
    stub = F.filter("all", lambda c: (c.col < F.col("stub_cols")) & (c.row >= F.col("header_rows")) & (c.row <= row) & (row < c.row + c.rows) & (c.text != ""))
    head = F.filter("all", lambda c: (c.row < F.col("header_rows")) & (c.col <= col) & (col < c.col + c.cols) & (c.text != ""))
    by_col = F.array_sort(F.transform(stub, lambda c: F.struct(c.col.alias("k"), c.text.alias("t"))))
    texts = lambda a: F.transform(a, lambda c: c.t)
    out = v.select("doc", "tbl", row.alias("row"), col.alias("col"), F.col("v.text").alias("value"), texts(by_col).alias("rows"), F.transform(head, lambda c: c.text).alias("cols"))
    return out.where((F.size("rows") > 0) | (F.size("cols") > 0))


def seeded(rows: DataFrame, group: list[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group (of all, if there is none), the first by a digest of seed, group and key."""
    from pyspark.sql import Window

    order = [F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(g).cast("string") for g in group), F.col(key).cast("string")), 256), F.col(key)]
    if not group:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def element_counts(samples: DataFrame, pages: DataFrame) -> DataFrame:
    """page, element, edits, length, teds, teds_n, problem: of each scored page and element the sums over its samples, 0 where it has none; samples of pages that aren't scored are told. samples: page, element, edits, length, teds (or null); pages: page, element."""
    sums = samples.groupBy("page", "element").agg(F.sum("edits").alias("edits"), F.sum("length").alias("length"), F.sum("teds").alias("teds"), F.count("teds").alias("teds_n"))
    both = pages.withColumn("scored", F.lit(True)).join(sums, ["page", "element"], "full")
    return both.select("page", "element", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("edits", "length", "teds", "teds_n")), F.when(F.col("scored").isNull(), "not scored").alias("problem"))


def document_scores(results: DataFrame, ids: DataFrame, metrics: list[str]) -> DataFrame:
    """doc, a value and a count of each metric, unscored, failed, problem: a failure counts as 0 in every metric, unless the harness itself failed; documents without a result are told.

    results: doc, success, harness (the failure is the harness's own), and the metrics; ids: doc.
    """
    d = ids.join(results.withColumn("there", F.lit(True)), "doc", "left")
    failed, own = F.col("there") & ~F.col("success"), F.coalesce("harness", F.lit(False))
    out = [F.when(F.col("success"), F.coalesce(m, F.lit(0.0))).otherwise(0.0).alias(m) for m in metrics]
    n = [F.when(F.col("success"), F.col(m).isNotNull().cast("long")).when(failed & ~own, 1).otherwise(0).cast("long").alias(f"{m}_n") for m in metrics]
    return d.select("doc", *out, *n, F.coalesce((failed & own).cast("long"), F.lit(0)).alias("unscored"), F.coalesce((failed & ~own).cast("long"), F.lit(0)).alias("failed"), F.when(F.col("there").isNull(), "no result").alias("problem"))


def test_counts(tests: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, group, tests, passed, problem: of each scored document and group of tests; tests of others don't count, documents without any are told. tests: doc, group, passed."""
    own = tests.join(ids, "doc", "left_semi").groupBy("doc", "group").agg(F.count("*").alias("tests"), F.count_if("passed").alias("passed"))
    return ids.join(own, "doc", "left").select("doc", "group", F.coalesce("tests", F.lit(0)).alias("tests"), F.coalesce("passed", F.lit(0)).alias("passed"), F.when(F.col("tests").isNull(), "no result").alias("problem"))


def differing(ours: DataFrame, theirs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """name, ours, theirs: averages that differ from the scorer's own, or that only one side has. Both: name, value."""
    both = ours.select("name", F.col("value").alias("ours")).join(theirs.select("name", F.col("value").alias("theirs")), "name", "full")
    one = F.col("ours").isNull() != F.col("theirs").isNull()
    return both.where(one | (F.abs(F.col("ours") - F.col("theirs")) > tolerance))


@dataclass(frozen=True)
class Metric:
    """What a report tells of a tool: a name, how it is made, and of which counts (num and den; num, a and b for dice) or, for harmonic and macro, of which metrics."""

    name: str
    kind: str  # pooled, mean_of, dice, harmonic or macro
    of: tuple[str, ...]


#: The report's metrics over a document's counts.
CATALOGUE = (
    Metric("structure_precision", "pooled", ("str_correct", "str_detected")),
    Metric("structure_recall", "pooled", ("str_correct", "str_gt")),
    Metric("structure_f", "harmonic", ("structure_precision", "structure_recall")),
    Metric("region_precision", "pooled", ("reg_correct", "reg_detected")),
    Metric("region_recall", "pooled", ("reg_correct", "reg_gt")),
    Metric("region_f", "harmonic", ("region_precision", "region_recall")),
    Metric("bound", "pooled", ("bound", "paths")),
    Metric("leaf_bound", "pooled", ("leaf", "paths")),
    Metric("value_recall", "pooled", ("value", "paths")),
    Metric("topology", "dice", ("top", "pred", "gt")),
    Metric("cell_error", "pooled", ("errors", "chars")),
    Metric("seconds_per_page", "mean_of", ("seconds", "pages")),
    Metric("mean_f", "macro", ("structure_f", "region_f")),
)


def report(counts: DataFrame, by: list[str], metrics: tuple[Metric, ...] = CATALOGUE) -> DataFrame:
    """The columns of ``by``, documents, and each metric: one aggregate over each of their combinations. counts: a row a document, with ``by`` and the counts."""
    made = {"pooled": pooled, "mean_of": mean_of, "dice": dice}
    plain = [m for m in metrics if m.kind in made]
    out = counts.cube(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("documents"), *(made[m.kind](*m.of).alias(m.name) for m in plain))
    for m in metrics:
        if m.kind not in made:
            out = out.withColumn(m.name, (harmonic if m.kind == "harmonic" else macro)(*(F.col(c) for c in m.of)))
    return out.select(*by, "level", "documents", *(m.name for m in metrics))
