"""Line-work derived from the star-schema tables, so that queries and their SQL twins see the same geometry.

Orders are edges, line items are faces, and region > nation > customer are the containers. Every number is an integer
expression of the keys turned into a double once, so other engines get the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table

LAYERS = ["DIM-A", "Layer0", "TEXT-N", "untagged", "XLINE", "WALL"]


def _layer(key: str):
    return F.element_at(F.array(*map(F.lit, LAYERS)), (F.col(key) % 6 + 1).cast("int"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each order; its pid path is region, nation, customer, order and misses the order for some."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("bigint").alias("n"))
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").cast("bigint").alias("r"))
    k, c = F.col("k"), F.col("c")
    x = c.cast("double") + (k % 7).cast("double") * 0.00006 + F.when(k % 1999 == 0, 2000000.0).otherwise(0.0)
    y = ((c % 3) * 4).cast("double")
    span = (k % 5 + 1).cast("double") * 0.25
    far = F.when(k % 499 == 0, 0.02).otherwise(0.0)
    flip = (F.floor(k / 30) % 2) == 1
    rows = o.join(cust, "c", "left").join(F.broadcast(nat), "n", "left").select("k", "c", "n", "r", x.alias("x"), y.alias("y"), (x + span).alias("x2"), far.alias("z2"), flip.alias("flip"))
    pick = lambda a, b: F.when(F.col("flip"), F.col(b)).otherwise(F.col(a))
    rows = rows.select(
        k.alias("edge_id"), pick("x", "x2").alias("sx"), F.col("y").alias("sy"), F.when(F.col("flip"), F.col("z2")).otherwise(0.0).alias("sz"),
        pick("x2", "x").alias("ex"), F.col("y").alias("ey"), F.when(F.col("flip"), 0.0).otherwise(F.col("z2")).alias("ez"), _layer("k").alias("layer"), k.alias("entity_id"),
        F.when(k % 97 != 0, k).alias("persistent_id"), F.array_compact(F.array(F.col("r") + 1, F.col("n") + 100, c + 1000000, F.when(k % 97 != 0, k))).alias("pid_path"),
        F.array(F.concat(F.lit("Region "), F.col("r").cast("string")), F.concat(F.lit("Nation "), F.col("n").cast("string")), F.concat(F.lit("Customer "), c.cast("string"))).alias("instance_path"),
        F.lit(3).alias("structural_depth"), (k % 97 != 0).alias("pid_path_complete"),
    )
    dx, dy, dz = (F.col(f"s{a}") - F.col(f"e{a}") for a in "xyz")
    return rows.withColumn("length", F.sqrt(dx * dx + dy * dy + dz * dz))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.select(_layer("l_orderkey").alias("layer"), (F.col("l_linenumber") % 4 + 3).cast("int").alias("outer_loop_vertex_count"), (F.col("l_linenumber") % 3).cast("int").alias("inner_loop_count"))


def visible_layers(spark: SparkSession) -> DataFrame:
    """Layer visibility as a host would report it: one hidden, one unknown."""
    rows = [(n, None if n == "XLINE" else n != "WALL") for n in LAYERS]
    return spark.createDataFrame(rows, "name string, shown boolean")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the definitions that customers of odd keys show; every fifth has none."""
    used = nodes(spark, sf_dir).where("def_id IS NOT NULL").select("def_id").distinct()
    return used.select("def_id", F.when(F.col("def_id") % 5 != 0, F.concat(F.lit("Block "), F.col("def_id").cast("string"))).alias("def_name"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container tree: regions shift by 10,000 in x, nations by 100 in y, customers double the scale and lift by z.

    Customers of odd keys are instances of a definition that holds their orders; those of remainder 3 by 4 share that of the
    customer two before them. One nation is invalid, and orders of every thirteenth key are of unknown validity.
    """
    empty = lambda: [F.lit(None).cast("double").alias(c) for c in ("sx", "sy", "sz", "ex", "ey", "ez")]
    loops = [F.lit(None).cast("int").alias("outer_loop_vertex_count"), F.lit(None).cast("int").alias("loop_count")]

    def shift(x, y, z, scale=1.0):
        s, o, i = F.lit(scale), F.lit(0.0), F.lit(1.0)
        return F.array(s, o, o, x, o, s, o, y, o, o, s, z, o, o, o, i).alias("m")

    zero = F.lit(0.0)
    long = lambda c: F.col(c).cast("bigint")
    none = F.lit(None).cast("bigint")
    base = lambda node, parent, kind, pid, name, layer, definition=none, valid=F.lit(True): [node.alias("node_id"), parent.alias("parent_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), definition.alias("def_id"), pid.alias("pid"), name.alias("name"), layer.alias("layer"), F.lit(True).alias("visible"), valid.alias("valid")]
    no_layer = F.lit(None).cast("string")
    r = table(spark, sf_dir, "region").select(*base(long("r_regionkey") + 1, none, "group", long("r_regionkey") + 1, F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")), no_layer), shift(long("r_regionkey").cast("double") * 10000.0, zero, zero), *empty(), *loops)
    n = table(spark, sf_dir, "nation").select(*base(long("n_nationkey") + 100, long("n_regionkey") + 1, "group", long("n_nationkey") + 100, F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")), no_layer, valid=F.col("n_nationkey") != 7), shift(zero, long("n_nationkey").cast("double") * 100.0, zero), *empty(), *loops)
    ck = F.col("c_custkey")
    odd = ck % 2 == 1
    definition = F.when(odd, F.when(ck % 4 == 3, ck - 2).otherwise(ck) + 5000000)
    c = table(spark, sf_dir, "customer").select(*base(ck + 1000000, long("c_nationkey") + 100, F.when(odd, "instance").otherwise("group"), ck + 1000000, F.concat(F.lit("Customer "), ck.cast("string")), no_layer, definition), shift(zero, zero, (F.col("c_custkey") % 10).cast("double"), 2.0), *empty(), *loops)
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        *base(
            k + 1000000000, F.col("o_custkey") + F.when(F.col("o_custkey") % 2 == 1, 5000000).otherwise(1000000), "edge", F.when(k % 97 != 0, k + 1000000000), F.lit(None).cast("string"), _layer("o_orderkey"),
            valid=F.when(k % 13 != 0, F.lit(True)),
        ), shift(zero, zero, zero),
        (k % 5).cast("double").alias("sx"), (k % 3).cast("double").alias("sy"), zero.alias("sz"), (k % 5 + 1).cast("double").alias("ex"), (k % 3).cast("double").alias("ey"), F.when(k % 11 == 0, F.lit(None)).otherwise(zero).cast("double").alias("ez"), *loops,
    )
    return r.unionByName(n).unionByName(c).unionByName(o)
