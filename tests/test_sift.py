"""Only what may meet a claim travels, and only the detector that is asked for runs."""

from pyspark.sql import functions as F

from draftwell.operators import detectors, repair, sift, vertices
from draftwell.plans import analysis as plans, catalog

SF = "/root/testdata/sf0.001"


def test_sifted_rows_lose_none_that_is_named(spark, tmp_path):
    rows = spark.range(100_000).withColumn("t", F.concat(F.lit("p"), F.col("id")))
    few = rows.where("id % 97 = 0")
    got = sift.sifted(rows, "id", few.select(F.col("id").cast("int").alias("k")))
    assert got.join(few, "id", "left_semi").count() == few.count() and got.count() < 5000
    got = sift.sifted(rows, "t", few.select("t"))
    assert got.join(few, "t", "left_semi").count() == few.count() and got.count() < 5000
    assert sift.sifted(rows, "id", few.limit(0).select("id")).count() == 0


def test_a_full_table_loses_none(spark, monkeypatch):
    monkeypatch.setattr(sift, "BITS", 64)
    assert sift.sifted(spark.range(1000), "id", spark.range(0, 1000, 3)).join(spark.range(0, 1000, 3), "id", "left_semi").count() == 334


def test_duplicates_are_found_by_their_own_detector(spark, monkeypatch):
    whole = catalog._analysis(spark, SF)
    names = ["issue_id", "edge_ids", "message", "severity", "confidence", "layer_name", "locatable", "sources", "counter", "lx"]
    want = sorted(map(tuple, whole.issues.where("issue_type = 'duplicate_edge_candidate'").select(*names).collect()))

    def never(*_, **__):
        raise AssertionError("not needed for duplicates")

    for name in ("short", "open_ends", "gaps", "told"):
        monkeypatch.setattr(detectors, name, never)
    monkeypatch.setattr(plans, "vertices", never)
    monkeypatch.setattr(vertices, "spots", never)
    got = sorted(map(tuple, catalog._analysis(spark, SF).duplicates.select(*names).collect()))
    assert len(got) > 50 and got == want
    assert catalog.repair_audit(spark, SF).count() > 50


def test_edges_that_no_claim_names_do_not_travel(spark, monkeypatch):
    edges = catalog._analysis(spark, SF).edges
    claims = spark.createDataFrame([(1, 2, "i"), (1, 31, "j"), (5, 10**9, "k")], "id_a bigint, id_b bigint, issue_id string")
    seen = []

    def watched(pairs, near, tol, was=repair.pair_reasons):
        seen.append(near.count())
        return was(pairs, near, tol)

    monkeypatch.setattr(repair, "pair_reasons", watched)
    plan = repair.propose(edges, repair.derive(edges), catalog.T.duplicate, "snap", claims)
    assert edges.count() > 1000 and seen == [4]
    assert {r.component: (r.reason, r.issue_ids) for r in plan.skipped.collect()}["5+1000000000"] == ("no_edge_record_for_one_or_both_edge_ids", ["k"])
