import math

import pytest
from pyspark.sql import functions as F

from sketchgraph import reports
from sketchgraph.functions import vectors
from sketchgraph.operators import graph, linalg
from sketchgraph.operators.weighted import WeightedQueue, heaviest, positions
from sketchgraph.plans import ranker
from sketchgraph.sources import text_files

EDGES = [(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (3, 5)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src int, dst int")


def test_page_rank(spark):
    got = {r["id"]: r["rank"] for r in graph.page_rank(edges(spark, EDGES + [(1, 2)]), 0.01, 0.85).collect()}
    want = {1: 1.072071, 2: 0.787575, 3: 1.736118, 4: 0.332164, 5: 1.072071}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    fixed = graph.page_rank(edges(spark), iterations=11, normalize=True)
    assert abs(fixed.agg(F.sum("rank")).head()[0] - 1) < 1e-9


def test_isolated_and_empty(spark):
    extra = spark.createDataFrame([(9,)], "id int")
    ranks = graph.page_rank(edges(spark), 0.001, extra=extra)
    assert ranks.count() == 6 and abs(ranks.agg(F.sum("rank")).head()[0] - 6) < 1e-9
    assert graph.page_rank(edges(spark, [])).isEmpty()


def test_degrees_and_tops(spark):
    got = graph.degrees(edges(spark, EDGES + [(1, 2)]))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (2, 1, 1), (3, 2, 3), (4, 1, 0), (5, 0, 1)}
    assert graph.edge_count(edges(spark, EDGES + EDGES)).head()[0] == 6
    assert [r["id"] for r in graph.top_k(got, "in_degree", 3).collect()] == [3, 1, 2]
    assert [r["id"] for r in graph.top_k(got, "in_degree", 9, ascending=True).collect()] == [4, 1, 2, 5, 3]


def test_rankings(spark):
    ranked = ranker.rankings(edges(spark), 3)
    assert {r["list"] for r in ranked.collect()} == set("ABCDE") and ranked.count() == 15
    alike = ranker.likeness(ranked)
    assert alike.count() == 10 and alike.where("list_a = 'C' and list_b = 'D'").head()["jaccard"] == 1.0


def test_matrices(spark):
    cells = lambda rows: spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)], "row int, col int, value double")
    product = {(r["row"], r["col"]): r["value"] for r in linalg.multiply(cells([[1, 2, 3], [4, 5, 6]]), cells([[7, 8], [9, 10], [11, 12]])).collect()}
    assert product == {(0, 0): 58, (0, 1): 64, (1, 0): 139, (1, 1): 154}
    v = spark.createDataFrame([(0, 7.0), (1, 8.0), (2, 9.0)], "row int, value double")
    assert {tuple(r) for r in linalg.multiply_vector(cells([[1, 2, 3], [4, 5, 6]]), v).collect()} == {(0, 50.0), (1, 122.0)}
    assert reports.matrix_text(cells([[1, 2.5]]), 2).head()["line"] == "1.00000 2.50000"
    with pytest.raises(ValueError):
        linalg.check_shapes(2, 3)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, -5.0, 2.0], [6.0, -3.0, -2.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(vectors.l1_norm(F.col("a")), vectors.subtract(F.col("a"), F.col("b")), vectors.printed(F.col("a"))).head()
    assert row[0] == 10 and row[1] == [-5, 5, -3, 2] and row[2] == "[1.000, 2.000, -5.000, 2.000]"
    cos = spark.sql("select array(1D,2D,3D) a, array(4D,5D,6D) b, array(0D,0D,0D) z").select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z"))).head()
    assert math.isclose(cos[0], 0.974631, abs_tol=1e-5) and cos[1] == 0
    with pytest.raises(Exception):
        spark.sql("select array(1D) a, array(1D,2D) b").select(vectors.subtract(F.col("a"), F.col("b"))).collect()


def test_queue():
    q = WeightedQueue()
    for item, weight in ((1, 5), (2, 3), (5, 7), (21, 5), (36, 4)):
        q.add(item, weight)
    assert [q.extract(), q.extract()] == [(5, 7), (1, 5)] and len(q) == 3
    q.add(21, 9)
    q.add(36, 1)
    assert len(q) == 3 and q.items() == [(21, 9), (36, 4), (2, 3)]
    assert [q.extract(), q.extract(), q.extract()] == [(21, 9), (36, 4), (2, 3)]
    with pytest.raises(IndexError):
        q.extract()
    for item in (1, 2, 21, 16, 5):
        q.add(item, 5)
    assert [q.extract()[0] for _ in range(5)] == [1, 2, 21, 16, 5]


def test_queue_as_table(spark):
    items = spark.createDataFrame([("p", 1, 5.0, 1), ("p", 2, 7.0, 2), ("p", 1, 9.0, 3), ("p", 1, 9.0, 4)], "page string, item int, weight double, seq int")
    got = positions(heaviest(items, by=("page",)), ("page",)).orderBy("position").collect()
    assert [(r["item"], r["weight"], r["seq"]) for r in got] == [(1, 9.0, 3), (2, 7.0, 2)]


def test_edge_lists(spark, tmp_path):
    out = str(tmp_path / "graph")
    text_files.write_edge_list(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), 3, out)
    n, back = text_files.edge_list(spark, out)
    assert n == 3 and {tuple(r) for r in back.collect()} == {("a", "b"), ("b", "c")}


def test_edge_lists_are_sorted_by_all(spark, tmp_path):
    """One file in order, without a task that holds all rows (a window over all of them before)."""
    rows = [(f"v{i * 7919 % 1000}", f"w{i % 13}") for i in range(1000)]
    out = str(tmp_path / "graph")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("edge lists", "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text_files.write_edge_list(spark.createDataFrame(rows, "src string, dst string").repartition(8), 1013, out)
        stages = {s for j in tracker.getJobIdsForGroup("edge lists") for s in tracker.getJobInfo(j).stageIds}
        tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [p for p in (tmp_path / "graph").iterdir() if p.name.endswith(".txt")]
    assert len(files) == 1 and files[0].read_text().splitlines() == ["1013", *(f"{a} {b}" for a, b in sorted(rows))]
    assert min(tasks) > 1
    with pytest.raises(Exception):
        text_files.write_edge_list(spark.createDataFrame(rows, "src string, dst string"), 1013, out)
    text_files.write_edge_list(spark.createDataFrame([], "src string, dst string"), 0, str(tmp_path / "none"))
    assert text_files.edge_list(spark, str(tmp_path / "none"))[1].isEmpty()


def test_lines_are_numbered_without_a_shuffle_of_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    plan = text_files.numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_page_rank_by_definition(spark):
    import random

    r = random.Random(4)
    rows = [*{(r.randrange(12), 100 + r.randrange(400)) for _ in range(3000)}, *((100 + i, i % 5) for i in range(0, 400, 3))]
    ids = sorted({x for e in rows for x in e})
    outs = {i: [b for a, b in rows if a == i] for i in ids}
    want = {i: 1.0 for i in ids}
    for _ in range(3):
        dangling, total = sum(want[i] for i in ids if not outs[i]), sum(want.values())
        new = {i: 0.85 * dangling / len(ids) + 0.15 * total / len(ids) for i in ids}
        for i in ids:
            for b in outs[i]:
                new[b] += 0.85 * want[i] / len(outs[i])
        want = new
    got = {r["id"]: r["rank"] for r in graph.page_rank(edges(spark, rows), iterations=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in ids)


def test_distinct_edges_are_not_made_distinct_again(spark):
    """One exchange, that of the sums by vertex."""
    plan = graph._degrees_of_distinct(edges(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and graph._degrees_of_distinct(edges(spark)).count() == 5
