"""Mixing sources to target weights.

Words are packed into blocks of fixed length; every source gets whole blocks.  A source has
blocks of ``block_words``, or shorter ones where it would have fewer than ``MIN_BLOCKS`` of
them.  The mix is a row of output shards of ``shard_slots`` blocks on average.

* Each source draws as many blocks as bring it closest to its target: whole epochs, and a part of
  the next one.  (With free draws a source whose target is its cap of three epochs would
  exceed the cap in half of all cases, so the totals are given.)
* The source counts of the shards are drawn multinomially given these totals: every draw of a
  source picks a shard, all alike.  The counts are written down.
* A shard's slots for a source go on with the source's index where the shards before it stop.
  Index i is block ``permutation(i mod blocks)`` of the source, where the permutation is keyed by
  source and epoch, so no block comes twice in an epoch.
* Blocks are joined to documents by index.  The result says which shards a document's
  words go to, and the mix as documents comes in the order of shards and of the slots in them.

Permutations are swap-or-not shuffles (Hoang, Morris, Rogaway, 2012): bijections on
any range, in a few JVM expressions per round, so nothing is sorted, cycled or collected.

Everything is DataFrame operations.  A source may hold any share of the rows: running
word offsets are taken in two levels (within hashed buckets of a source, then over its
buckets), counts are taken map-side first, and draws are generated in chunks that are dealt
out before they are expanded.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, shuffle_partitions, written

ROUNDS = 16
EPOCHS = 3
CHUNK = 4096
#: A source has at least so many blocks (as long as it has as many words).
MIN_BLOCKS = 64


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and ``row`` (a number of the row) of each document."""
    return docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )


def targets(sized: DataFrame, block_words: int, seed: int = 17) -> DataFrame:
    """One row per source: source_size, target, block_words, blocks, draws, all_draws.

    Sources in code-point order (null last) weigh 1, 2, 3, repeating.  A target is
    ``min(3 * size, level * weight)``, where the level makes the targets add up to the
    size of everything; sources are capped in the order of ``3 * size / weight``, so the
    level is found by running sums over the sources.  Draws are whole epochs and, of the
    next one, as many as come nearest to the target: up to the place of the short last
    block in that epoch's permutation all have ``block_words`` words.  There is a row for each
    source, so the windows over all of them hold few rows.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", F.asc_nulls_last("source"))
    every = Window.partitionBy()
    s = s.withColumn("weight", 1 + (F.row_number().over(by_name) - 1) % 3)
    s = s.withColumn("ratio", EPOCHS * F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(every))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the first source that is not capped has the level; for later ones it would be lower or equal only by what they keep
    s = s.withColumn("nth", F.row_number().over(by_ratio))
    s = s.withColumn("level", F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("nth"))).over(every))
    s = s.withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), EPOCHS * F.col("source_size").cast("double")).otherwise(F.col("level") * F.col("weight")))
    s = s.withColumn("block_words", F.greatest(F.lit(1).cast("long"), F.least(F.lit(block_words).cast("long"), F.expr(f"source_size div {MIN_BLOCKS}"))))
    s = s.withColumn("blocks", F.expr("(source_size + block_words - 1) div block_words"))
    size, blocks, length = F.greatest("source_size", F.lit(1)), F.greatest("blocks", F.lit(1).cast("long")), F.col("block_words")
    s = s.withColumn("epochs", F.floor(F.col("target") / size).cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("last", permuted(blocks - 1, blocks, F.lit(seed), F.col("source"), F.col("epochs"), inverse=True)).withColumn("short", F.col("blocks") * length - F.col("source_size"))
    near = [F.least(F.greatest(f(x / length).cast("long"), F.lit(0).cast("long")), F.col("blocks")) for x in (F.col("rest"), F.col("rest") + F.col("short")) for f in (F.floor, F.ceil)]
    words = [d * length - F.when(d > F.col("last"), F.col("short")).otherwise(0) for d in near]
    best = F.array_min(F.array(*[F.struct(F.abs(w - F.col("rest")).alias("off"), d.alias("d")) for d, w in zip(near, words, strict=True)]))
    s = s.withColumn("draws", F.col("epochs") * F.col("blocks") + best["d"])
    return s.select("source", "source_size", "target", "block_words", "blocks", "draws", F.sum("draws").over(every).alias("all_draws"))


def permuted(index: Column, size: Column, *key: Column, inverse: bool = False) -> Column:
    """The place of ``index`` in a keyed pseudorandom permutation of ``[0, size)``, or the index of a place.

    The rounds are folded by a higher-order function: as nested columns they would be
    copied into each other when a filter is pushed below them.
    """

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(2 * r, *key), size) - at, size)
        bit = F.xxhash64(2 * r + 1, F.greatest(at, other), *key).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(at)

    rounds = [F.lit(0), F.lit(ROUNDS - 1)]  # each is its own inverse
    return F.aggregate(F.sequence(*(rounds[::-1] if inverse else rounds)), index.cast("long"), turn)


def shard_counts(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """One row per shard and source of which it has blocks: shard, source, blocks, n, first.

    Each draw of a source falls into one of the shards, by a keyed hash: a source's counts are
    multinomial given its draws.  ``first`` is the source's draws in the shards before.
    """
    spark = sources.sparkSession
    chunks = sources.where("draws > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(draws - 1) div {CHUNK}"))).alias("chunk"))
    draws = chunks.repartition(shuffle_partitions(spark), "source", "chunk").select(
        "source", "blocks", F.expr(f"(all_draws + {shard_slots - 1}) div {shard_slots}").alias("shards"), F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("draws")) - 1)).alias("draw")
    )
    drawn = draws.select("source", "blocks", F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), "source", "draw"), F.col("shards")).alias("shard"))
    counts = drawn.groupBy("source", "blocks", "shard").agg(F.count("*").alias("n")).withColumn("part", F.expr(f"shard div {CHUNK}"))
    within = Window.partitionBy("source", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts, "mix-counts")
    parts = counts.groupBy("source", "part").agg(F.sum("n").alias("n")).select("source", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return counts.alias("c").join(parts.alias("p"), F.expr("c.source <=> p.source and c.part = p.part")).select("c.shard", "c.source", "c.blocks", "c.n", (F.col("before") + F.col("inside")).alias("first"))


def slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """One row per output slot: shard, slot, source, epoch, block.

    ``slot`` orders the blocks of a shard: a keyed hash of source and index, so sources are mixed within it.
    """
    spark = sources.sparkSession
    counts = shard_counts(sources, shard_slots, seed)
    chunks = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))).alias("chunk")).repartition(shuffle_partitions(spark), "shard", "source", "chunk")
    one = chunks.select("shard", "source", "blocks", F.explode(F.sequence(F.col("first") + F.col("chunk") * CHUNK, F.col("first") + F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)).alias("index"))
    one = one.withColumn("epoch", F.expr("index div blocks"))
    block = permuted(F.col("index") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source"), F.col("epoch"))
    return one.select("shard", F.xxhash64(F.lit("slot"), F.lit(seed), "source", "index").alias("slot"), "source", "epoch", block.alias("block"))


def offsets(sized: DataFrame) -> DataFrame:
    """Adds ``start``, the words of the source before the document.

    The order within a source is by hashed bucket, then doc_id.  With sqrt(rows) buckets
    neither the windows within buckets nor those over a source's buckets grow faster
    than the square root of the rows.
    """
    buckets = max(1, math.isqrt(sized.count()))
    b = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "size"), F.lit(buckets).cast("long")))
    within = Window.partitionBy("source", "bucket").orderBy(F.asc_nulls_last("doc_id"), "row").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select("source", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    b = b.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.expr("l.source <=> r.source and l.bucket = r.bucket")
    return b.alias("l").join(sums.alias("r"), same).select("l.doc_id", "l.source", "l.size", "l.row", (F.col("before") + F.col("inside")).alias("start"))


def spans(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each block that a document reaches into: row, source, block, low, high.

    ``low`` and ``high`` are word positions within the document, high excluded.  A very
    long document is first cut into chunks of blocks, dealt out, then into blocks.
    """
    spark = placed.sparkSession
    p = placed.where("size > 0").alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.block_words")
    p = p.select("*", F.expr("start div block_words").alias("b0"), F.expr("(start + size - 1) div block_words").alias("b1"))
    p = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(b1 - b0) div {CHUNK}"))).alias("part"))
    p = p.repartition(shuffle_partitions(spark), "row", "part")
    p = p.select("row", "source", "start", "size", "block_words", F.explode(F.sequence(F.col("b0") + F.col("part") * CHUNK, F.least(F.col("b0") + (F.col("part") + 1) * CHUNK - 1, F.col("b1")))).alias("block"))
    return p.select(
        "row", "source", "block",
        F.greatest(F.lit(0).cast("long"), F.col("block") * F.col("block_words") - F.col("start")).alias("low"),
        F.least(F.col("size"), (F.col("block") + 1) * F.col("block_words") - F.col("start")).alias("high"),
    )


def drawn(placed: DataFrame, sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """Each drawn piece of a document: row, low, high, epoch, shard, slot."""
    # both sides grow with the corpus, though the planner takes the slots to be as small as the sources
    a, b = spans(placed, sources).alias("a"), slots(sources, shard_slots, seed).hint("merge").alias("b")
    return a.join(b, F.expr("a.source <=> b.source and a.block = b.block")).select("a.row", "low", "high", "epoch", "shard", "slot")


def mix(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and ``shards``.

    ``shards`` has the output shards that the document's words go to, with their words there.
    Null text has size 0; a null source is a source; rows without words are never taken.
    Repeated rows count as separate documents.  An empty table gives an empty result.
    The result depends on the rows, ``seed``, the block size and the shard size alone.
    """
    sized = written(sizes(docs), "mix-sizes")
    sources = written(targets(sized, block_words, seed), "mix-sources")
    by_shard = drawn(offsets(sized), sources, shard_slots, seed).groupBy("row", "shard").agg(F.sum(F.col("high") - F.col("low")).alias("words"))
    taken = by_shard.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    s = sized.join(taken, "row", "left").alias("s")
    none = F.array().cast("array<struct<shard:bigint,words:bigint>>")
    return s.join(sources.alias("t"), F.expr("s.source <=> t.source"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_documents(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """The mix as documents with the input's columns, whatever their names.

    Each document gives a row for each epoch in which some of it is drawn, with the drawn
    words in order; a document drawn whole keeps its text as it is.  A row stands at the slot of
    its first words, so rows are spread over shards alike, however long: partitions are runs of
    shards, and within them rows are in slot order.  ``n_chars``, where there is such a column,
    follows the text.
    """
    row, at, pieces, n, first, words, place = (f"mix_{uuid.uuid4().hex}" for _ in range(7))
    rowed = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs", "snappy")
    sized = written(
        rowed.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"), F.col(row).alias("row")),
        "mix-sizes",
    )
    sources = written(targets(sized, block_words, seed), "mix-sources")
    drawn_pieces = drawn(offsets(sized), sources, shard_slots, seed)
    kept = drawn_pieces.groupBy(F.col("row").alias(at), "epoch").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias(pieces), F.sum(F.col("high") - F.col("low")).alias(n), F.min_by(F.struct("shard", "slot"), "low").alias(first)).drop("epoch")
    out = rowed.join(kept, F.col(row) == F.col(at))
    out = out.withColumn(words, F.when(F.col(n) < F.regexp_count(rowed["text"], F.lit(WORD)), F.regexp_extract_all(rowed["text"], F.lit(f"({WORD})"), F.lit(1))))
    part = F.array_join(F.flatten(F.transform(pieces, lambda p: F.slice(words, p["low"].cast("int") + 1, (p["high"] - p["low"]).cast("int")))), " ")
    out = out.withColumn("text", F.when(F.col(words).isNull(), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    parts, shards = shuffle_partitions(docs.sparkSession), F.lit(-(-(sources.agg(F.max("all_draws")).first()[0] or 1) // shard_slots))
    where = F.least(F.col(f"{first}.shard") * parts / shards, F.lit(parts - 1)).cast("int")
    out = out.select(*[f"`{c}`" for c in docs.columns], first, where.alias(place)).repartitionById(parts, F.col(place)).sortWithinPartitions(first)
    return out.select(*[f"`{c}`" for c in docs.columns])
