"""Rows that may meet a few others, told before they travel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BITS = 1 << 28  # of the table, at most: 32 MB


def sifted(rows: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the one column of ``few``, which is stored: none that is gets lost.

    A join of them is as before, but what it cannot use is not shuffled for it. The table of bits has 16 to 32 a key, ``BITS``
    at most (beyond them more rows pass), and goes out as a scalar: an array of arrays of 4,096 longs.
    """
    bits = min(max(1 << 18, 1 << (16 * few.count()).bit_length()), BITS)
    hashed = lambda value: F.xxhash64(value.cast("string"))  # noqa: E731  whatever the width of the numbers
    places = lambda h: [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]
    listed = lambda of, by: F.transform(F.sort_array(F.collect_list(F.struct(by, of))), lambda x: x[of])
    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("__p") % 64).cast("int"))
    marks = few.select(F.explode(F.array(*places(hashed(F.col(few.columns[0]))))).alias("__p")).groupBy(F.shiftright("__p", 6).alias("__w")).agg(F.bit_or(word).alias("__v"))
    words = few.sparkSession.range(bits >> 6).withColumnRenamed("id", "__w").join(marks, "__w", "left")
    words = words.select("__w", F.shiftright("__w", 12).alias("__c"), F.coalesce("__v", F.lit(0)).alias("__v"))
    whole = words.groupBy("__c").agg(listed("__v", "__w").alias("__vs")).agg(listed("__vs", "__c")).scalar()
    longs = lambda p: F.get(whole, F.shiftright(p, 18).cast("int"))
    is_set = lambda p: F.getbit(F.get(longs(p), (F.shiftright(p, 6) % 4096).cast("int")), (p % 64).cast("int")) == 1
    one, two = places(F.col("__s"))
    # by explode, so that the hash is made once, not for each of its uses
    return rows.withColumn("__s", F.explode(F.array(hashed(F.col(key))))).where(is_set(one) & is_set(two)).drop("__s")
