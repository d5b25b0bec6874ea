"""Appending to the log and reading keys back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, order: list[Column], start: int, out: str = "id") -> DataFrame:
    """Dense numbers from ``start`` on, in a total order, without gathering the rows in one task.

    Rows are range-partitioned and sorted; a row's number is its place in its partition
    plus the rows of the partitions before.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # written down, as the bounds of a range partitioning are sampled anew by every evaluation
    placed = written(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.lit(start) + F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def append_plan(batch: DataFrame, known: DataFrame, max_id: int) -> DataFrame:
    """Ids of a batch to append: known keys, and all but a key's first row, are duplicates with id 0.

    ``batch`` has seq (its order) and idempotency_key; ``known`` has idempotency_key.
    """
    # the least seq of a key by partial aggregation, so a key that is repeated very often is no task's burden
    first = batch.groupBy("idempotency_key").agg(F.min("seq").alias("_first"))
    fresh_keys = first.join(known.select("idempotency_key"), "idempotency_key", "left_anti").withColumn("_unknown", F.lit(True))
    marked = batch.join(fresh_keys, "idempotency_key", "left").withColumn("_new", F.coalesce(F.col("_unknown") & (F.col("seq") == F.col("_first")), F.lit(False)))
    fresh = numbered(marked.where("_new"), [F.col("seq")], max_id + 1)
    done = fresh.withColumn("duplicate", F.lit(False))
    again = marked.where("not _new").withColumn("id", F.lit(0).cast("long")).withColumn("duplicate", F.lit(True))
    return done.unionByName(again).drop("_first", "_unknown", "_new")


def validated(batch: DataFrame) -> DataFrame:
    """The batch with ``rejected``: why a row can't be appended, null where it can.

    One bad row costs that row: producers append the others and report it.
    """
    no_key = F.col("message_key").isNull() | (F.col("message_key") == "")
    compact = F.col("compaction_rank").isNotNull()
    reason = F.when(F.coalesce(F.col("schema_version"), F.lit(0)) < 1, "schema version below 1").when(~F.col("concurrency").isin("parallel", "exclusive", "ordered"), "unknown concurrency")
    reason = reason.when((F.col("concurrency") != "parallel") & no_key, "concurrency without key").when(compact & (F.col("concurrency") == "ordered"), "ordered and compacted").when(compact & no_key, "rank without key")
    bad_json = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
    return batch.withColumn("rejected", reason.when(bad_json, "payload is not JSON"))


def key_history(log: DataFrame, key: str, limit: int) -> DataFrame:
    """Newest messages of a key."""
    return log.where(F.col("message_key") == key).orderBy(F.desc("id")).limit(limit)


def key_window(log: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """A key's messages created in an inclusive window, newest first."""
    return log.where((F.col("message_key") == key) & F.col("created_at").between(start, end)).orderBy(F.desc("created_at"), F.desc("id"))


def message(log: DataFrame, message_id: int) -> DataFrame:
    return log.where(F.col("id") == message_id)


def presented(log: DataFrame) -> DataFrame:
    """The log as readers see it: unset keys and ranks as empty values, with a flag for compacted rows."""
    empty = F.lit("")
    return log.select(
        "id", "schema_version", F.coalesce("routing_key", empty).alias("routing_key"), F.coalesce("message_key", empty).alias("message_key"),
        F.coalesce("compaction_rank", F.lit(0).cast("long")).alias("compaction_rank"), F.col("compaction_rank").isNotNull().alias("compacted"), "payload", "created_at",
    )
