"""Issues travel spare: no lists of tokens are gathered for them, texts follow where they arrive, and no task sorts too many."""

from pyspark.sql import functions as F

from draftwell.operators import issues as iss, ordering
from draftwell.plans import catalog

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_lists_and_no_texts_travel(spark):
    analysis = catalog._analysis(spark, SF)
    assert "collect_list" not in plan_of(analysis.counted)
    placed = plan_of(analysis.issues)
    assert "collect_list" not in placed
    stored = [line for line in placed.splitlines() if "Relation" in line and "edge_ids" in line]
    assert stored and not any("message" in line or "metadata" in line for line in stored)


def test_ids_are_those_of_issues_dressed_first(spark):
    analysis = catalog._analysis(spark, SF)
    want = iss.with_ids(iss.with_sources(analysis.normalized(), analysis.edges, 1e-6))
    names = ["issue_id", "edge_ids", "message", "severity", "confidence", "layer_name", "locatable", "sources", "stable_key", "counter", "lx", F.map_entries("metadata").alias("metadata")]
    got, want = (df.select(*names).orderBy("issue_id").collect() for df in (analysis.issues, want))
    assert len(got) > 1000 and got == want


def test_more_edges_than_two_and_repeated_ids(spark):
    edges = spark.createDataFrame([(1, [1], 1, 0, True, "b"), (1, [9], 9, 1, True, "a"), (2, [2], 2, 0, True, ""), (3, [3], 3, 0, True, "c")], "edge_id bigint, pid_path array<bigint>, entity_id bigint, structural_depth int, pid_path_complete boolean, layer string")
    rows = spark.createDataFrame([("n", []), ("one", [1]), ("two", [3, 1]), ("gone", [7, 2]), ("many", [2, 3, 8, 1])], "issue_type string, edge_ids array<bigint>").withColumn("metadata", F.create_map().cast("map<string,string>"))
    got = {r.issue_type: ([t.pid_path for t in r.sources], r.layer_name, dict(r.metadata)) for r in iss.looked_up(rows, edges).collect()}
    assert got == {
        "n": ([], "Layer0", {}), "one": ([[1], [9]], "b", {}), "two": ([[3], [1], [9]], "c", {}), "gone": ([[], [2]], "Layer0", {"no_source_marker": "7"}),
        "many": ([[2], [3], [], [1], [9]], "Layer0", {"no_source_marker": "8"}),
    }


def test_a_task_sorts_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "EACH", 1000)
    got = ordering.positions(spark.range(20000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(10**9))), ["v", "id"], rows=20000)
    assert got.agg(F.count("id"), F.min("position"), F.max("position"), F.count_distinct("position")).first()[:] == (20000, 0, 19999, 20000)
    assert len(got.inputFiles()) >= 20  # one file a task
