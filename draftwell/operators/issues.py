"""Issues: normalised, given their sources and identifiers, validated, grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import DEFAULT_LAYER, canonical_level, display_length, pid_path_text, sanitized, severity, type_rank
from ..session import stored
from .ordering import positions

TOKEN = "struct<pid_path:array<bigint>,entity_id:bigint,nested:boolean,pid_path_complete:boolean>"


def normalized(raw: DataFrame) -> DataFrame:
    """Severity by type, levels from the fixed set, clean messages; rows without a type go."""
    return raw.where("issue_type IS NOT NULL AND issue_type <> ''").select(
        "issue_type", severity(F.col("issue_type")).alias("severity"), canonical_level(F.col("confidence")).alias("confidence"),
        F.coalesce("edge_ids", F.array().cast("array<bigint>")).alias("edge_ids"), "lx", "ly", "lz", sanitized(F.col("message")).alias("message"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), *[c for c in raw.columns if c.startswith("__")],
    )


def warnings_as_issues(warnings: DataFrame) -> DataFrame:
    """Profile warnings of known codes in the shape of normalised issues."""
    known = warnings.where(F.col("code").isin("significant_non_zero_z", "abnormal_large_coord", "deep_nesting"))
    return known.select(
        F.col("code").alias("issue_type"), F.when(F.col("severity").isin("low", "medium", "high"), F.col("severity")).otherwise(severity(F.col("code"))).alias("severity"),
        F.lit("medium").alias("confidence"), F.array().cast("array<bigint>").alias("edge_ids"), *[F.lit(None).cast("double").alias(c) for c in ("lx", "ly", "lz")],
        sanitized(F.col("message")).alias("message"), F.create_map(F.lit("code"), F.col("code")).alias("metadata"),
    )


def _key(token: Column, place: Column) -> Column:
    return F.when(F.size(token["pid_path"]) > 0, pid_path_text(token["pid_path"])).otherwise(place)


def with_sources(issues: DataFrame, edges: DataFrame, eps: float) -> DataFrame:
    """Adds ``sources``, ``layer_name`` and what follows from them: ``locatable``, ``source_entity_ids``, ``source_keys``, ``stable_key``."""
    return described(looked_up(issues, edges), eps)


def looked_up(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``sources`` (tokens in edge order, whole duplicates once) and ``layer_name``.

    Of edge ids without an edge the token is empty, and they are listed in the metadata.
    """
    return resolved(met(stored(issues.withColumn("__iid", F.monotonically_increasing_id())), edges).drop("__iid"))


def met(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``__hits``: for each of ``edge_ids`` the edges of that id, null if there is none. ``issues`` are stored, with a number ``__iid``.

    An issue goes to its first edge and, if it has two, on to the second. Of longer ones only the ids travel, and what they met
    comes back under the number of the issue.
    """
    token = F.struct("pid_path", "entity_id", (F.col("structural_depth") > 0).alias("nested"), "pid_path_complete").alias("token")
    if edges.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        info = edges.groupBy("edge_id").agg(F.collect_list(F.struct(token, "layer")).alias("hits"))
    else:  # as a rule an id has one edge, and no list is gathered
        info = edges.select("edge_id", F.array(F.struct(token, "layer")).alias("hits"))
    many = F.coalesce(F.size("edge_ids"), F.lit(0))
    at = lambda rows, i: rows.withColumn("edge_id", F.get("edge_ids", F.lit(i))).join(info, "edge_id", "left").drop("edge_id")
    one = at(issues.where(many == 1), 0).withColumn("__hits", F.array("hits")).drop("hits")
    two = at(at(issues.where(many == 2), 0).withColumnRenamed("hits", "__hit"), 1).withColumn("__hits", F.array("__hit", "hits")).drop("__hit", "hits")
    none = issues.where(many <= 0).withColumn("__hits", F.lit(None).cast(one.schema["__hits"].dataType))
    out = one.unionByName(two).unionByName(none)
    if not issues.where(many > 2).limit(1).count():
        return out
    refs = issues.where(many > 2).select("__iid", F.posexplode("edge_ids").alias("pos", "edge_id")).join(info, "edge_id", "left")
    refs = refs.groupBy("__iid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hits"))), lambda x: x["hits"]).alias("__hits"))
    return out.unionByName(issues.where(many > 2).join(refs, "__iid"))


def _met() -> Column:
    """What an issue met, in the order of its edges: ``token, missing, layer``."""
    empty = F.struct(F.array().cast("array<bigint>").alias("pid_path"), F.lit(None).cast("bigint").alias("entity_id"), F.lit(False).alias("nested"), F.lit(False).alias("pid_path_complete"))
    no_text = F.lit(None).cast("string")

    def of(hits: Column, i: Column) -> Column:
        none = F.array(F.struct(empty.alias("token"), F.get("edge_ids", i).cast("string").alias("missing"), no_text.alias("layer")))
        return F.coalesce(F.array_sort(F.transform(hits, lambda h: F.struct(F.coalesce(h["token"], empty).alias("token"), no_text.alias("missing"), h["layer"].alias("layer")))), none)

    return F.coalesce(F.flatten(F.transform("__hits", of)), F.array().cast(f"array<struct<token:{TOKEN},missing:string,layer:string>>"))


def _sources(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: x["token"]))


def resolved(issues: DataFrame) -> DataFrame:
    """``sources`` and ``layer_name`` of what was met; row by row."""
    r = F.col("__r")
    out = issues.withColumn("__r", _met()).withColumn("sources", _sources(r))
    missing = F.array_sort(F.array_compact(F.transform(r, lambda x: x["missing"])))
    out = out.withColumn("metadata", F.when(F.size(missing) > 0, F.map_concat("metadata", F.create_map(F.lit("no_source_marker"), F.array_join(missing, ",")))).otherwise(F.col("metadata")))
    layer = F.coalesce(F.nullif(F.get(F.transform(r, lambda x: x["layer"]), 0), F.lit("")), F.lit(DEFAULT_LAYER))
    return out.withColumn("layer_name", layer).drop("__r", "__hits")


def _keys(eps: float, sources: Column) -> tuple[Column, Column]:
    """(``source_keys``, ``stable_key``) of issues with sources."""
    located = F.col("lx").isNotNull()
    spot = F.concat_ws(",", *[F.floor(F.col(c) / F.lit(eps)).cast("bigint").cast("string") for c in ("lx", "ly", "lz")])
    place = F.when(located, F.concat(F.lit("geo:"), spot)).otherwise(F.lit("no-source"))
    ids = F.array_join(F.array_sort(F.col("edge_ids").cast("array<string>")), ",")
    keys = F.array_join(F.array_sort(F.transform(sources, lambda t: _key(t, place))), "+")
    return keys, F.concat(keys, F.lit("|"), F.when(located, F.concat(F.lit("loc:"), spot)).otherwise(F.lit("loc:none")), F.lit("|edges:"), ids)


def stable_key(eps: float) -> Column:
    """The stable key of issues as :func:`met` leaves them."""
    return _keys(eps, _sources(_met()))[1]


def described(issues: DataFrame, eps: float) -> DataFrame:
    """Adds what follows from the sources; row by row, so it need not travel or be stored."""
    keys, stable = _keys(eps, F.col("sources"))
    return issues.select(
        "*",
        F.exists("sources", lambda t: t["pid_path_complete"] | (~t["nested"] & t["entity_id"].isNotNull())).alias("locatable"),
        F.filter(F.transform("sources", lambda t: t["entity_id"]), lambda e: e.isNotNull()).alias("source_entity_ids"),
        keys.alias("source_keys"),
        stable.alias("stable_key"),
    )


def numbered(found: DataFrame, stable: str | Column, message: str | Column, rows: int | None = None) -> DataFrame:
    """Adds ``counter``: 1-based within the type, in the order of the stable key; equal keys are told apart by the message.

    Four types share all issues, so the counter comes from global positions and one offset a type, not from a window that
    would sort a quarter of the issues in one task.
    """
    placed = positions(found, ["issue_type", stable, message], "__pos", rows)
    first = placed.groupBy("issue_type").agg(F.min("__pos").alias("__first"))  # one row a type
    return placed.join(F.broadcast(first), "issue_type").withColumn("counter", F.col("__pos") - F.col("__first") + 1).drop("__pos", "__first")


def with_ids(found: DataFrame) -> DataFrame:
    """Adds ``counter`` and ``issue_id`` to issues that come from :func:`with_sources`."""
    return numbered(found, "stable_key", "message").withColumn("issue_id", F.concat_ws("|", "issue_type", "source_keys", F.col("counter").cast("string")))


# The keys that every issue has, in the order in which they are asked for.
REQUIRED = ["issue_id", "issue_type", "severity", "confidence", "sources", "source_entity_ids", "edge_ids", "location", "message", "metadata", "locatable", "display_length"]


def rejects(issues: DataFrame) -> DataFrame:
    """Rows that a registry does not take, with the first reason; a row that passes has none.

    A required column that is not there fails every row. ``location`` is an array of three numbers or null.
    """
    bad = lambda c: F.col(c).isNull() | ~F.col(c).isin("low", "medium", "high")
    lacking = next((k for k in REQUIRED if k not in issues.columns), None)
    if lacking:
        return issues.withColumn("reason", F.lit(f"missing key :{lacking}"))
    reason = (
        F.when(bad("severity"), F.concat(F.lit("non-canonical severity: "), F.coalesce("severity", F.lit("nil"))))
        .when(bad("confidence"), F.concat(F.lit("non-canonical confidence: "), F.coalesce("confidence", F.lit("nil"))))
        .when(F.col("issue_type").isNull() | (F.col("issue_type") == ""), "issue_type must be a non-empty String")
        .when(F.col("issue_id").isNull() | (F.col("issue_id") == ""), "issue_id must be a non-empty String")
        .when(F.col("sources").isNull(), "sources must be an Array")
        .when(F.col("source_entity_ids").isNull(), "source_entity_ids must be an Array")
        .when(F.col("edge_ids").isNull(), "edge_ids must be an Array")
        .when(F.col("message").isNull(), "message must be a String")
        .when(F.col("location").isNotNull() & (F.size("location") != 3), "location must be nil or [x, y, z]")
        .when(F.col("locatable").isNull(), "locatable must be a Boolean")
    )
    return issues.withColumn("reason", reason)


def with_display(issues: DataFrame) -> DataFrame:
    """Adds ``location`` and ``display_length``: the printed length of what was measured, an edge or a distance; null if nothing was."""
    measured = F.coalesce(F.get(F.map_values(F.map_filter("metadata", lambda k, _: k == "length")), F.lit(0)), F.get(F.map_values(F.map_filter("metadata", lambda k, _: k == "distance")), F.lit(0)))
    return issues.withColumn("location", F.when(F.col("lx").isNotNull(), F.array("lx", "ly", "lz"))).withColumn("display_length", display_length(measured.try_cast("double")))


def registry(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid issues, dropped ones with ``stage`` and ``reason``)."""
    marked = rejects(issues)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").withColumn("stage", F.lit("issue_registry.validate"))


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issue_count"), F.bool_or(F.col("severity") == "high").alias("has_high"))


def groups(issues: DataFrame, any_high: DataFrame | None = None) -> DataFrame:
    """``type, rank, issue_count, default_open``: buckets in canonical order, unknown types after them by name.

    With a high issue anywhere the buckets that hold one are open, else the first bucket.
    """
    by = summary(issues).withColumn("rank", type_rank(F.col("issue_type")))
    every = Window.partitionBy(F.lit(0))  # one row a type
    first = F.row_number().over(every.orderBy("rank", "issue_type")) == 1
    return by.select(F.col("issue_type").alias("type"), F.row_number().over(every.orderBy("rank", "issue_type")).alias("rank"), "issue_count", F.when(F.max("has_high").over(every), F.col("has_high")).otherwise(first).alias("default_open"))


def layer_groups(issues: DataFrame, layers: DataFrame) -> DataFrame:
    """``name, rank, issue_count, default_open`` for layers with issues, in the order ``display_rank`` of ``layers``.

    Issues without a layer count for the default one, which exists if there are issues; those of unknown layers go, but a
    high one among them still decides which buckets are open.
    """
    counted = issues.groupBy(F.coalesce(F.nullif("layer_name", F.lit("")), F.lit(DEFAULT_LAYER)).alias("name")).agg(F.count(F.lit(1)).alias("issue_count"), F.bool_or(F.col("severity") == "high").alias("has_high"))
    any_high = counted.agg(F.coalesce(F.bool_or("has_high"), F.lit(False)).alias("any_high"))
    known = layers.select("name", "display_rank").unionByName(counted.limit(1).select(F.lit(DEFAULT_LAYER).alias("name"), F.lit(1 << 30).alias("display_rank"))).groupBy("name").agg(F.min("display_rank").alias("display_rank"))
    rows = counted.join(known, "name").crossJoin(F.broadcast(any_high))
    order = Window.partitionBy(F.lit(0)).orderBy("display_rank", "name")  # one row a layer
    return rows.select("name", F.row_number().over(order).alias("rank"), "issue_count", F.when(F.col("any_high"), F.col("has_high")).otherwise(F.row_number().over(order) == 1).alias("default_open"))
