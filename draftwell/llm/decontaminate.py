"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only.

A seed is a fixed mask over ``SPAN`` token positions of which five count and the others are ignored, so a
replaced word under an ignored position does not break it. Every position of every training text and of every
benchmark item is hashed under each mask; equal hashes are hits, and each hit fixes an alignment (diagonal)
of item and text. The alignment is then compared token by token around the hit: a text is contaminated when,
somewhere along it, 80 % of ``WINDOW`` consecutive item tokens (of all of them, if the item is shorter) stand
at their places. The masks were chosen so that every 16 aligned tokens with three replaced ones hold a seed;
items of 10 and 11 tokens, where two replaced ones can break all three masks, are also hashed under ``MIDDLE``.

Up to ``BLOCK_SEEDS`` benchmark seeds (20 MB) are broadcast. Of a larger benchmark only a table of at most ``BITS`` bits
(32 MB) travels, in which each seed sets two: places of texts whose seed finds both set go on as four numbers, join the
seeds as a shuffled join, and the texts that do hold a seed are read a second time for their tokens. So the texts are
read twice at most, whatever the benchmark's size; too full a table lets more places through and loses none.
The tokens of items join the few hits, with or without a broadcast as their size asks for.

Items of more than ``SEGMENT`` tokens are looked for by segments of so many, which overlap so that each ``WINDOW`` lies whole in
one; a piece of a text thus never carries more than a segment on either side. The tokens that such an item has at their places
all along an alignment are counted afterwards, block by block, in the texts in which a segment was found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, table
from .exact_dedup import fresh_name

MASKS = ((0, 1, 2, 3, 5), (0, 1, 2, 4, 7), (0, 1, 3, 4, 5))
MIDDLE = (0, 1, 5, 6, 7)
SPAN = 8
MIN_ITEM = 5
WINDOW = 16
BLOCK_SEEDS = 400_000
BITS = 1 << 28
PIECE = 512
SEGMENT = 512


def tokens(text: Column) -> Column:
    """64-bit hashes of the words: runs of letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(frame: DataFrame, th: str, n: str, pos: str, masks: list[tuple[int, ...]], first: Column, last: Column) -> DataFrame:
    """``frame`` with one row per position from ``first`` to ``last`` and mask that fits there: ``pos``, ``__m`` (the mask's number), ``seed``.

    All masks of a position are hashed side by side, so each token is fetched once and the generated code stays small
    enough to be compiled. The outer explode keeps Spark from deriving a filter that would split the texts twice.
    """
    places = F.when(F.col(n) >= MIN_ITEM, F.sequence(first, last))
    rows = frame.select("*", F.explode_outer(places).alias(pos)).where(F.col(pos).isNotNull())
    hashes = [F.xxhash64(F.lit(i), *[F.get(F.col(th), F.col(pos) + o) for o in mask]).alias(f"__h{i}") for i, mask in enumerate(masks)]
    rows = rows.select("*", *hashes)
    rows = rows.select(*frame.columns, pos, F.posexplode(F.array(*[f"__h{i}" for i in range(len(masks))])).alias("__m", "seed"))
    span = F.get(F.array(*[F.lit(mask[-1] + 1) for mask in masks]), F.col("__m"))
    return rows.where(F.col(pos) + span <= F.col(n))


def _pieces(texts: DataFrame, longest: int) -> DataFrame:
    """Texts cut into pieces of ``PIECE`` positions (``first`` to ``last`` of ``th``) with ``longest`` tokens on either side.

    Every alignment of an item with a position of the piece lies inside; ``base`` is the text's place at which ``th`` begins.
    Rows per position then carry a piece, however long the text is.
    """
    start = F.sequence(F.lit(0), F.greatest(F.size("whole") - 1, F.lit(0)), F.lit(PIECE))
    low = lambda s: F.greatest(s - longest, F.lit(0))
    cut_ = F.transform(start, lambda s: F.struct(s.alias("start"), low(s).alias("base"), F.slice("whole", low(s) + 1, s - low(s) + PIECE + longest).alias("th")))
    rows = texts.select("id", "text_key", F.explode(cut_).alias("p")).select("id", "text_key", "p.base", "p.th", (F.col("p.start") - F.col("p.base")).alias("first"), F.size("p.th").alias("n"))
    return rows.withColumn("last", F.least(F.col("first") + PIECE, F.col("n")) - 1)


def _membership(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test whether a hash may be among the about ``n`` of the one column of ``hashes``: false for none that is.

    The table has 16 bits a hash, ``BITS`` at most, and comes as one scalar: an array of arrays of 4,096 longs.
    """
    bits = min(max(1 << 18, 1 << (16 * n).bit_length()), BITS)
    places = lambda h: [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]
    listed = lambda of, key: F.transform(F.sort_array(F.collect_list(F.struct(key, of))), lambda x: x[of])
    marks = hashes.select(F.explode(F.array(*places(F.col(hashes.columns[0])))).alias("p"))
    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    marks = marks.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(word).alias("v"))
    words = hashes.sparkSession.range(bits >> 6).withColumnRenamed("id", "w").join(marks, "w", "left")
    words = words.select("w", F.shiftright("w", 12).alias("c"), F.coalesce("v", F.lit(0)).alias("v"))
    whole = words.groupBy("c").agg(listed("v", "w").alias("vs")).agg(listed("vs", "c")).scalar()

    def is_set(p: Column) -> Column:
        longs = F.get(whole, F.shiftright(p, 18).cast("int"))
        return F.getbit(F.get(longs, (F.shiftright(p, 6) % 4096).cast("int")), (p % 64).cast("int")) == 1

    def may_hold(h: Column) -> Column:
        one, two = places(h)
        return is_set(one) & is_set(two)

    return may_hold


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs ``id, item_id, item_tokens, matched_tokens, overlap, doc_start, text_key`` of texts and items found in them.

    ``matched_tokens`` counts the item's tokens at their places along the best alignment, ``doc_start`` is the
    token at which the item would begin there (negative if it begins before the text), ``overlap`` their share.
    ``text_key`` tells rows apart that carry one identifier. Null texts and items are empty; empty ones and items
    of fewer than five tokens match nothing; items of 5 to 7 tokens match only whole. Repeated rows repeat nothing:
    a pair comes once. Ties between alignments go to the earlier one. Other columns are not read. A very long text is cut
    into overlapping pieces of its tokens, so that no row per position carries it.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("ith")).distinct()
    items = items.withColumn("il", F.size("ith")).where(F.col("il") >= MIN_ITEM)
    facts = items.agg(F.sum("il").alias("total"), F.max("il").alias("longest")).first()
    total, longest = facts.total or 0, max(facts.longest or 0, SPAN)
    n_seeds = total * (len(MASKS) + SPAN - MIN_ITEM)
    items = items.withColumn("key", F.xxhash64("item_id", "ith"))
    whole, large = items, longest > SEGMENT
    if large:
        items = _segments(items)
        total, longest = items.agg(F.sum("il")).first()[0], SEGMENT
        n_seeds = total * (len(MASKS) + SPAN - MIN_ITEM)
    # items of 5 to 7 tokens are whole seeds: a mask of its own for each such length that occurs
    short = sorted(r.il for r in items.where(F.col("il") < SPAN).select("il").distinct().collect())
    masks = [*MASKS, *[tuple(range(k)) for k in short]]
    own = F.col("il").between(SPAN, 1 << 30) & (F.col("__m") < len(MASKS))
    for i, k in enumerate(short):
        own = own | ((F.col("il") == k) & (F.col("__m") == len(MASKS) + i))
    if items.where(F.col("il").between(10, 11)).limit(1).count():
        own = own | (F.col("il").between(10, 11) & (F.col("__m") == len(masks)))
        masks.append(MIDDLE)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    texts = texts.select("id", F.xxhash64("t").alias("text_key"), tokens(F.col("t")).alias("whole"))
    seeds = _seeds(items, "ith", "il", "off", masks, F.lit(0), F.col("il") - 1).where(own).select("seed", "key", "off", "il")
    pieces = lambda of: _pieces(of, longest)
    places = lambda of: _seeds(pieces(of), "th", "n", "pos", masks, F.col("first"), F.col("last"))
    if n_seeds <= BLOCK_SEEDS:
        hits = places(texts).join(F.broadcast(seeds), "seed").withColumn("at", F.col("pos") - F.col("off"))
    else:
        hits = _hits_of_many(texts, cut(seeds), n_seeds, pieces, places)
    # what goes on is as long as the item, not as the text
    aligned = F.transform(F.sequence(F.lit(0), F.col("il") - 1), lambda j: F.get("th", F.col("at") + j))
    hits = hits.select("id", "text_key", "key", (F.col("base") + F.col("at")).alias("diag"), aligned.alias("aligned"))
    # many hits lie on one alignment
    lined = hits.groupBy("id", "text_key", "key", "diag").agg(F.first("aligned").alias("aligned"))
    if not large:
        return _best(_verified(lined.join(items.select("key", "item_id", "ith", "il"), "key")))
    good = cut(_verified(lined.join(items.select("key", "item_id", "ith", "il", "of", "start"), "key")))
    long = good.where("of IS NOT NULL").select("id", "text_key", F.col("of").alias("key"), (F.col("diag") - F.col("start")).alias("diag")).distinct()
    names = ["id", "text_key", "item_id", "il", "diag", "matched"]
    return _best(good.where("of IS NULL").select(*names).unionByName(_along(long, texts, whole).select(*names)))


def _segments(items: DataFrame) -> DataFrame:
    """``items`` with longer ones cut into segments: ``key, ith, il`` are the segment's, ``of`` the item's key, ``start`` its place there."""
    long = items.where(F.col("il") > SEGMENT)
    start = F.explode(F.sequence(F.lit(0), F.col("il") - WINDOW, F.lit(SEGMENT - WINDOW + 1))).alias("start")
    long = long.select("item_id", F.col("key").alias("of"), "ith", start).withColumn("ith", F.slice("ith", F.col("start") + 1, SEGMENT))
    long = long.select("item_id", "ith", F.size("ith").alias("il"), F.xxhash64("of", "start").alias("key"), "of", "start")
    rest = items.where(F.col("il") <= SEGMENT).select("item_id", "ith", "il", "key", F.lit(None).cast("bigint").alias("of"), F.lit(0).alias("start"))
    return rest.unionByName(long)


def _along(lines: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Alignments ``id, text_key, key, diag`` with ``item_id, il`` and ``matched``, the item's tokens at their places.

    Texts and items are cut into blocks of ``PIECE`` tokens; a block of an item stands in two blocks of the text at most.
    """
    block = lambda c: F.posexplode(F.transform(F.sequence(F.lit(0), F.size(c) - 1, F.lit(PIECE)), lambda s: F.slice(c, s + 1, PIECE)))
    lines = cut(lines.withColumnRenamed("id", "of").withColumnRenamed("text_key", "of_key"))
    asked = lines.select("of", "of_key").distinct()
    named = (texts["text_key"] == asked["of_key"]) & texts["id"].eqNullSafe(asked["of"])
    parts = texts.join(asked, named, "left_semi").dropDuplicates(["id", "text_key"]).select("id", "text_key", block("whole").alias("tb", "th"))
    blocks = items.where(F.col("il") > SEGMENT).select("key", "item_id", "il", block("ith").alias("ib", "part"))
    met = lines.join(blocks, "key").withColumn("place", F.col("diag") + F.col("ib") * PIECE)
    first = F.floor(F.col("place") / PIECE).cast("int")
    met = met.withColumn("at", F.explode(F.array(first, first + 1)))
    met = met.join(parts, (parts["text_key"] == met["of_key"]) & parts["id"].eqNullSafe(met["of"]) & (parts["tb"] == met["at"]))
    shift = F.col("place") - F.col("tb") * PIECE
    same = F.transform("part", lambda x, j: (F.get("th", shift + j) == x).cast("int"))
    count = F.aggregate(same, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return met.select("id", "text_key", "item_id", "il", "key", "diag", count.alias("n")).groupBy("id", "text_key", "item_id", "il", "key", "diag").agg(F.sum("n").cast("int").alias("matched"))


def _hits_of_many(texts: DataFrame, seeds: DataFrame, n_seeds: int, pieces: Callable[[DataFrame], DataFrame], places: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Alignments ``at`` of items in pieces of texts, for more seeds than are broadcast: one row an alignment, not one a hit."""
    may_hold = _membership(seeds.select("seed"), n_seeds)
    maybe = places(texts).where(may_hold(F.col("seed"))).select("id", "text_key", (F.col("base") + F.col("pos")).alias("place"), "seed")
    hits = maybe.join(seeds, "seed").groupBy("id", "text_key", "key", "il", (F.col("place") - F.col("off")).alias("diag")).agg(F.min("place").alias("place"))
    # the piece of any place on an alignment holds the whole of it
    hits = cut(hits.withColumn("start", F.col("place") - F.col("place") % PIECE).drop("place").withColumnRenamed("id", "of").withColumnRenamed("text_key", "of_key"))
    hit = _membership(hits.select("of_key"), hits.count())
    parts = pieces(texts.where(hit(F.col("text_key")))).withColumn("from", F.col("base") + F.col("first"))
    met = parts.join(hits, (parts["text_key"] == hits["of_key"]) & parts["id"].eqNullSafe(hits["of"]) & (parts["from"] == hits["start"]))
    return met.withColumn("at", F.col("diag") - F.col("base"))


def _verified(lined: DataFrame) -> DataFrame:
    lined = lined.withColumn("m", F.zip_with("aligned", "ith", lambda a, b: a.eqNullSafe(b).cast("int")))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    lined = lined.withColumn("w", F.least("il", F.lit(WINDOW))).withColumn("matched", add(F.col("m")))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("il") - F.col("w")), lambda s: add(F.slice("m", s + 1, F.col("w")))))
    return lined.withColumn("best", best).where(F.col("best") * 5 >= F.col("w") * 4)


def _best(good: DataFrame) -> DataFrame:
    """One row a text and item: the best of its alignments."""
    return (
        good.groupBy("id", "text_key", "item_id", F.col("il").alias("item_tokens"))
        .agg(F.max("matched").alias("matched_tokens"), F.min_by("diag", F.struct(-F.col("matched"), "diag")).alias("doc_start"))
        .withColumn("overlap", F.col("matched_tokens") / F.col("item_tokens"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (see :func:`contamination`); columns as they came, whatever their names."""
    bad = contamination(docs, benchmark, id_col, text_col).select(F.col("id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    key = fresh_name(docs, "__text_key")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return marked.join(bad, marked[id_col].eqNullSafe(bad["__id"]) & (marked[key] == bad["__key"]), "left_anti").drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "item_tokens", "matched_tokens", "overlap", "doc_start")
