"""The registered queries ``opN_<name>`` and the SQL of those that SQL can express.

Each takes ``(spark, sf_dir)``, applies one operator with its production parameters
to the whole table, and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, gif_media, language_id, mixing, near_dedup, pii, quality, quotations, sentencepiece_fst, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encoding_digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_documents(spark, sf_dir))


def op4_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_digests(_documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


#: The key of the registered query where the session names none.  It is public: real pseudonyms need a secret one.
DEMONSTRATION_KEY = "demonstration only"


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_documents(spark, sf_dir), spark.conf.get("sluice.pii.key", DEMONSTRATION_KEY))


# further queries of the same operators, on tables that show more of them


def _quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with quotations made: each message quotes the one two turns before it (turn 1 the first), some at two levels."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    q = m.select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.col("text").alias("quoted"))
    marks = F.when(F.col("turn") % 3 == 0, "> > ").otherwise("> ")
    quote = F.concat(F.lit("On Monday x wrote:\n"), marks, F.replace("quoted", F.lit("\n"), F.concat(F.lit("\n"), marks)), F.lit("\n\n"))
    both = m.join(q, (F.col("of") == F.col("conv_id")) & (F.col("at") == F.when(F.col("turn") == 1, 0).otherwise(F.col("turn") - 2)), "left")
    return both.select("conv_id", "turn", "role", F.when(F.col("at").isNull(), F.col("text")).otherwise(F.concat(quote, "text")).alias("text"))


_QUOTING = """made AS (SELECT m.conv_id, m.turn, m.role, CASE WHEN q.turn IS NULL THEN m.text ELSE
    'On Monday x wrote:' || chr(10) || CASE WHEN m.turn % 3 = 0 THEN '> > ' ELSE '> ' END || replace(q.text, chr(10), chr(10) || CASE WHEN m.turn % 3 = 0 THEN '> > ' ELSE '> ' END) || chr(10) || chr(10) || m.text END AS text
    FROM conversations m LEFT JOIN conversations q ON q.conv_id = m.conv_id AND q.turn = CASE WHEN m.turn = 1 THEN 0 ELSE m.turn - 2 END)"""
_MADE = f"WITH {_QUOTING}," + quotations.ORACLE.replace("FROM conversations", "FROM made").replace("WITH", "", 1)


def quotations_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_ordered(_quoting(spark, sf_dir))


def quotations_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.chats(quotations.reply_ordered(_quoting(spark, sf_dir)))


_CHATS = f"""SELECT conv_id, position // {quotations.SEGMENT} AS segment, count(*) AS n_messages, string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY position) AS chat
  FROM ({_MADE}) GROUP BY 1, 2"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.targets(mixing.sizes(_documents(spark, sf_dir)), 64).select("source", "source_size", F.round("target", 3).alias("target"))


_TARGETS = """WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY 1),
  w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, sum(size) OVER () AS total FROM s),
  l AS (SELECT *, 3.0 * size / weight AS ratio, row_number() OVER o AS nth, (total - 3 * coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM w WINDOW o AS (ORDER BY 3.0 * size / weight, source NULLS LAST)),
  f AS (SELECT arg_min(level, nth) FILTER (WHERE ratio > level) AS level FROM l)
SELECT source, size AS source_size, round(CASE WHEN f.level IS NULL OR ratio <= f.level THEN 3.0 * size ELSE f.level * weight END, 3) AS target FROM l, f"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sentencepiece, op2_exact_dedup, op3_language_id, op4_chat_quotations, op5_minhash_near_dedup,
        op6_gif_media, op7_token_counts, op8_quality_classifier, op9_source_mixing, op10_pii_pseudonyms,
        quotations_made, quotations_chats, mixing_targets,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op4_chat_quotations": quotations.ORACLE, "quotations_made": _MADE, "quotations_chats": _CHATS, "mixing_targets": _TARGETS}
