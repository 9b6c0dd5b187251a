"""Buckets with their issues against a plain reading."""

import random

import pytest
from pyspark.sql import functions as F

from draftwell.functions.scalars import ISSUE_TYPES
from draftwell.operators import buckets

SCHEMA = "issue_id string, issue_type string, severity string, layer_name string, metadata map<string,string>, note string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, layer, {"k": str(i)}, f"n{k}") for k, (i, t, s, layer) in enumerate(rows)], SCHEMA)


def plain(rows, order, size, key):
    """(name, rank, count, open, chunk, ids) as a loop over sorted lists gives them."""
    high = any(r[2] == "high" for r in rows)
    out, rank = [], 0
    for name in order:
        held = sorted((r[0] or "" for r in rows if key(r) == name))
        if not held:
            continue
        rank += 1
        is_open = any(r[2] == "high" for r in rows if key(r) == name) if high else rank == 1
        out += [(name, rank, len(held), is_open, at // size, held[at : at + size]) for at in range(0, len(held), size)]
    return sorted(out, key=str)


def read(df):
    return sorted([(r.name, r["rank"], r.issue_count, r.default_open, r.chunk, [i.issue_id or "" for i in r.issues]) for r in df.collect()], key=str)


def some(n, severities, types=(*ISSUE_TYPES[:3], "zebra", "aardvark", None), seed=1):
    rng = random.Random(seed)
    rows = [(f"{rng.choice('aBz0')}|{rng.randrange(400)}|{k}", rng.choice(types), rng.choice(severities), rng.choice(["A", "B", "", None, "ghost"])) for k in range(n)]
    return rows + [("hot|%05d" % k, "short_edge", "low", "A") for k in range(n)]  # half of all rows in one bucket


@pytest.mark.parametrize("severities", [("low", "medium"), ("low", "high"), ("low", None)])
def test_buckets_equal_a_plain_reading(spark, severities):
    rows = some(150, severities)
    df = frame(spark, rows)
    order = ["open_endpoint", *[t for t in ISSUE_TYPES if t != "open_endpoint"]]
    assert read(buckets.type_buckets(df, size=7)) == plain(rows, ISSUE_TYPES, 7, lambda r: r[1])
    assert read(buckets.type_buckets(df, ["open_endpoint"], size=1000)) == plain(rows, order, 1000, lambda r: r[1])
    assert read(buckets.type_buckets(df, ["zebra"], size=64)) == plain(rows, ["zebra", *ISSUE_TYPES], 64, lambda r: r[1])
    layers = spark.createDataFrame([("B", 1), ("A", 2), ("empty", 3)], "name string, display_rank int")
    assert read(buckets.layer_buckets(df, layers, size=9)) == plain(rows, ["B", "A", "Layer0"], 9, lambda r: r[3] or "Layer0")


def test_a_registry_lists_unknown_types_last(spark):
    rows = some(60, ("low", "high"), types=(*ISSUE_TYPES[:3], "zebra", "aardvark"))
    got = read(buckets.type_buckets(frame(spark, rows), unknown=True, size=10))
    assert got == plain(rows, [*ISSUE_TYPES, "aardvark", "zebra"], 10, lambda r: r[1])


def test_an_issue_of_a_dropped_type_still_decides_what_is_open(spark):
    rows = [("1", "short_edge", "low", "A"), ("2", "zebra", "high", "ghost")]
    layers = spark.createDataFrame([("A", 1)], "name string, display_rank int")
    assert read(buckets.type_buckets(frame(spark, rows))) == [("short_edge", 1, 1, False, 0, ["1"])]
    assert read(buckets.layer_buckets(frame(spark, rows), layers)) == [("A", 1, 1, False, 0, ["1"])]


def test_odd_rows(spark):
    rows = [(None, "short_edge", None, None)] * 2 + [("x", "short_edge", "low", "A")] * 3
    chunks = buckets.type_buckets(frame(spark, rows), size=2).orderBy("chunk").collect()
    assert [[i.issue_id for i in c.issues] for c in chunks] == [[None, None], ["x", "x"], ["x"]]
    assert [c.first_position for c in chunks] == [0, 2, 4] and {i.metadata["k"] for c in chunks for i in c.issues} == {"None", "x"}
    assert sorted(i.note for c in chunks for i in c.issues) == [f"n{k}" for k in range(5)]
    nothing = frame(spark, rows).limit(0)
    layers = spark.createDataFrame([("A", 1)], "name string, display_rank int")
    assert buckets.type_buckets(nothing).count() == 0 and buckets.layer_buckets(nothing, layers).count() == 0
    with pytest.raises(ValueError):
        buckets.type_buckets(nothing, size=0)
    clash = frame(spark, rows).withColumn("rank", F.lit(9)).withColumn("chunk", F.lit("c")).withColumn("type", F.lit(1)).withColumn("name", F.lit("n"))
    assert buckets.type_buckets(clash, size=5).first().issues[0]["rank"] == 9
