"""All operators on empty tables, nulls in any column, ties, repeated rows, very long texts and clashing names."""

import pytest
from pyspark.sql import functions as F

from draftwell.llm import chat, decontaminate, exact_dedup, html_text, language, piece_bpe, pseudonyms, quality, simhash, substring_dedup

LONG = "Lorem ipsum dolor 192.168.10.4 sit amet. " * 25_000
ODD = [(1, None), (1, None), (None, ""), (None, None), (2, LONG), (2, LONG), (3, LONG + "x"), (4, " \n\t "), (5, "ties"), (6, "ties"), (7, "▁ é 𝒳 \0")]
CLASH = "id int, t int, norm int, hash int, node int, fp int, key int, found int, hits int, new int, text_key int, th int, seed int, conv_id int, ids int, lang_pred int, score int"


def plain_field(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality")).where("doc_id = 1")
    return quality.fit(docs, labels)


OPERATORS = {
    "op1": (lambda d: decontaminate.contamination(d, d.limit(1).select(F.lit(1).cast("bigint").alias("item_id"), F.lit("lorem ipsum dolor 192 168 10 4 sit").alias("text"))), 2),
    "op2": (lambda d: language.identify(d, language.prototypes(d.withColumn("lang", F.lit("en")))), 11),
    "op3": (lambda d: exact_dedup.exact_groups(d), 11),
    "op4": (lambda d: substring_dedup.dedup_substrings(d), 11),
    "op5": (lambda d: html_text.extract(d, "doc_id", "text", "text"), 11),
    "op6": (lambda d: pseudonyms.pseudonymise(d), 11),
    "op8": (lambda d: piece_bpe.encode_decode(d), 11),
    "op9": (lambda d: quality.score(d, plain_field(d)), 11),
    "op10": (lambda d: simhash.near_groups(d), 11),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    run, count = OPERATORS[name]
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string").select("*", *[F.lit(9).cast(k).alias(n) for n, k in (c.split() for c in CLASH.split(", "))])
    rows = run(docs).collect()
    assert len(rows) == count
    again = run(docs.repartition(5)).collect()
    # the same rows, whatever the partitions
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert run(docs.limit(0)).count() == 0


def test_odd_turns(spark):
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", LONG), (None, 0, "odd role", ""), (2, 0, "assistant", "x")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").select("*", F.lit(1).alias("place"), F.lit(2).alias("ids"), F.lit(3).alias("loss"))
    rows = {r.conv_id: r for r in chat.digests(chat.format_turns(frame)).collect()}
    assert {k: r.n_turns for k, r in rows.items()} == {1: 3, None: 2, 2: 1} and rows[None].loss_chars == len(LONG) and rows[2].loss_chars == 1
    assert chat.digests(chat.format_turns(frame.limit(0))).count() == 0
