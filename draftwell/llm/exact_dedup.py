"""Exact deduplication by content sort.

Splitters are drawn from a sample of keys: the first ``PREFIX`` characters of the normalised text, a hash of the whole
and a hash of the identifier. They deal the texts into ranges, one task each; the hash of the identifier lets a group of
copies that holds a third of all rows cover as many ranges as its size asks for. Inside a range an external sort of the
whole texts puts equals side by side, and every row is compared with its neighbour in full: runs are what these
comparisons find, no digest decides. A run can only go on in the next range where the last text of the one and the
first of the other are equal: two rows a range are looked at again, and their texts are fetched only if prefix and hash
agree. Each run is then reduced to its best identifier and its size.

The text crosses the network once. The driver receives ``DRAWN`` keys a range, of at most 4 * ``PREFIX`` + 16 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, table

PREFIX = 24
DRAWN = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else changed."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select("id", "norm", F.substring("norm", 1, PREFIX).alias("head"), F.xxhash64("norm").alias("hash"), F.xxhash64("id").alias("spread"))


def _splitters(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> list[tuple[str, int, int]]:
    """Keys that cut ``docs`` into about ``ranges`` equal parts, from a sample of ``DRAWN`` keys a part."""
    total = docs.count()
    if ranges < 2 or total < 2:
        return []
    share = ranges * DRAWN / total
    few = docs if share >= 1 else docs.sample(share, seed=11)
    drawn = sorted(tuple(r) for r in _keyed(few, id_col, text_col).select("head", "hash", "spread").collect())
    return [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if drawn else []


def _literal(keys: list[tuple[str, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(h).alias("head"), F.lit(x).cast("bigint").alias("hash"), F.lit(s).cast("bigint").alias("spread")) for h, x, s in keys])


def _dealt(rows: DataFrame, splitters: list[tuple[str, int, int]]) -> DataFrame:
    """``rows`` with ``range``: how many splitters are not above the key. Blocks of splitters are searched first, then one block."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= F.struct("head", "hash", "spread")))
    step = max(1, round(len(splitters) ** 0.5))
    blocks = [splitters[k : k + step] for k in range(0, len(splitters), step)]
    rows = rows.withColumn("block", below(_literal([b[0] for b in blocks])))
    own = F.get(F.array(*[_literal(b) for b in blocks]), F.greatest(F.col("block"), F.lit(1)) - 1)
    return rows.withColumn("range", F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * step + below(own)).cast("int"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", partitions: int | None = None) -> DataFrame:
    """One row per input row: ``id, text_sha256, keep_id, group_size, kept, again``.

    ``keep`` is ``min`` or ``max``: which identifier of a group of equal texts stays. Null text equals the
    empty text. A null identifier loses against any other. Rows repeated with the same identifier and text
    are copies of each other: exactly one of them is kept, the others come ``again``. Empty input gives no rows. Other
    columns are not read, so their names cannot clash. A very long text is one row of a sort that spills; its key is short.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = F.max if keep == "max" else F.min
    splitters = _splitters(docs, id_col, text_col, n)
    dealt = _dealt(_keyed(docs, id_col, text_col), splitters).select("id", "norm", "head", "hash", "spread", "range").repartitionById(n, "range")
    # the order of the ranges, too: equal texts lie side by side within a range and over its borders
    line = Window.partitionBy("range").orderBy("head", "hash", "norm", "spread", "id")
    seen = dealt.select(
        "id", "range", "norm", "head", "hash", "spread", F.lag("norm").over(line).alias("before"), F.lag("id").over(line).alias("last"), F.lead("hash").over(line).alias("after"), F.row_number().over(line).alias("place")
    )
    seen = seen.withColumn("new", F.col("before").isNull() | (F.col("norm") != F.col("before")))
    edge = (F.col("place") == 1) | F.col("after").isNull()
    runs = cut(
        seen.select(
            "id", "range", "hash", "place", F.sha2("norm", 256).alias("text_sha256"), F.sum(F.col("new").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
            (~F.col("new") & F.col("last").eqNullSafe(F.col("id"))).alias("again"), F.when(edge, F.col("norm")).alias("edge"),
        )
    )
    heads = runs.groupBy("range", "run").agg(best("id").alias("head"), F.count(F.lit(1)).alias("size"))
    whole = _joined(runs)
    heads = heads.join(F.broadcast(whole), ["range", "run"], "left").withColumn("chain", F.coalesce("chain", F.struct("range", "run")))
    # Runs of a chain are at most one a range; all others are a chain of their own.
    groups = heads.groupBy("chain").agg(best("head").alias("keep_id"), F.sum("size").alias("group_size"), F.collect_list(F.struct("range", "run")).alias("parts"))
    groups = groups.select("keep_id", "group_size", F.inline("parts"))
    # The first row of the best identifier; its repeats have the same key and so the same run.
    return runs.join(groups, ["range", "run"]).select("id", "text_sha256", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("again")).alias("kept"), "again")


def _joined(runs: DataFrame) -> DataFrame:
    """``range, run, chain`` of runs that go on over borders of ranges; ``chain`` is the first of them."""
    ends = runs.where(F.col("edge").isNotNull()).select("range", "run", "place", "hash")
    # two small rows a range at most
    order = Window.orderBy("range", "place")
    light = ends.select(
        "range", "run", "place", F.lag("range").over(order).alias("last_range"), F.lag("run").over(order).alias("last_run"), F.lag("place").over(order).alias("last_place"), (F.lag("hash").over(order) == F.col("hash")).alias("alike")
    )
    ask = light.where("alike AND range <> last_range")
    texts = runs.where(F.col("edge").isNotNull()).select("range", "place", "edge")
    left = texts.select(F.col("range").alias("last_range"), F.col("place").alias("last_place"), F.col("edge").alias("last_edge"))
    met = ask.join(texts, ["range", "place"]).join(left, ["last_range", "last_place"]).where("edge = last_edge").select("range", "run", "last_range", "last_run")
    # chains of neighbours: at most one row a range
    step = Window.orderBy("range")
    flagged = met.withColumn("start", ~(F.lag("range").over(step).eqNullSafe(F.col("last_range")) & F.lag("run").over(step).eqNullSafe(F.col("last_run"))))
    number = flagged.withColumn("no", F.sum(F.col("start").cast("int")).over(step.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy("no").orderBy("range")
    chain = F.first(F.struct(F.col("last_range").alias("range"), F.col("last_run").alias("run"))).over(first)
    named = number.select("range", "run", "last_range", "last_run", chain.alias("chain"))
    heads = named.select(F.col("chain.range").alias("range"), F.col("chain.run").alias("run"), "chain")
    return named.select("range", "run", "chain").unionByName(heads).distinct()


def fresh_name(frame: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``frame`` is called so."""
    taken = {c.lower() for c in frame.columns}
    while wish in taken:
        wish += "_"
    return wish


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` without its surplus copies, all columns as they came, whatever their names.

    Groups are those of :func:`exact_groups`. Repeated rows with one identifier and one text leave one row.
    """
    groups = cut(exact_groups(docs, id_col, text_col, keep).where("NOT kept").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"), "again"))
    sha = fresh_name(docs, "__text_sha")
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    gone = groups.where("NOT again").drop("again").distinct()
    rest = marked.join(gone, marked[id_col].eqNullSafe(gone["__id"]) & (marked[sha] == gone["__sha"]), "left_anti")
    if groups.where("again").limit(1).count():
        rest = rest.dropDuplicates([id_col, sha])
    return rest.drop(sha)


def query(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
