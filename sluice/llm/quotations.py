"""Conversations in reply order, with quotations linked and taken out.

A line that starts with ``>`` marks (blanks between them allowed) is quoted, at as many
levels as it has marks.  Consecutive lines of one level are a passage.  Passages, their
paragraphs and their lines are normalised (lower case, runs of anything but letters and
digits as one space), hashed, and joined to the hashes of the unquoted messages of the
same conversation and of those messages' paragraphs and lines.  The *original* of a text is
the message that says it first.  A message replies to the original found at its lowest
quote level (the whole passage before its parts, the later original before the earlier),
or, without any, to the turn before.

A message may be of any length: no pattern matches a group by recursion, and the lines of a
message are taken apart once.

Within a conversation, messages are ordered by the turn they reply to, then by their own:
every message comes after the one it answers, and answers to one message stand together.

Everything is DataFrame operations.  Positions come from a range-partitioned sort and the
partitions' running counts, so a conversation of any length is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import recorded, removed, shuffle_partitions, written

#: Repeated groups are possessive: they match in a loop, where others would take a stack frame for each turn.
MARKS = r"^[ \t]*+>(?:[ \t]*+>)*+"
BLANK_LINES = r"^(?:[ \t]*+\n)++"
#: Lines that announce a quotation in the languages of common mail programs.
ANNOUNCES = r"(?i)^(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió) ?:\s*$"
SEGMENT = 64
WHOLE, PARAGRAPH, LINE = 2, 1, 0
MIN_LINE_WORDS = 3


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def unquoted(text: Column) -> Column:
    """The text without quoted lines, the lines that announce them, and blank lines at its ends; others are unchanged."""
    quoted = lambda line: F.coalesce(line.rlike(MARKS), F.lit(False))
    own = lambda lines: F.filter(lines, lambda line, i: ~quoted(line) & ~(line.rlike(ANNOUNCES) & quoted(F.get(lines, i + 1))))
    kept = F.get(F.transform(F.array(_lines(text)), lambda lines: F.array_join(own(lines), "\n")), F.lit(0))
    # the blank lines at the end are those at the start of the reversed text: both matches are tried at one place only
    without = F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(kept, BLANK_LINES, "")), BLANK_LINES, ""))
    return F.when(text.rlike(f"(?m){MARKS}"), without).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """Quoted passages of rows (row, conv_id, turn, text): row, conv_id, turn, passage, level, body."""
    some = messages.where(F.col("text").rlike(f"(?m){MARKS}"))
    lines = some.select("row", "conv_id", "turn", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.select("row", "conv_id", "turn", "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("line", MARKS + "[ \t]?", "").alias("body"))
    order = Window.partitionBy("row").orderBy("at")
    lines = lines.withColumn("new", F.when(F.lag("level").over(order) == F.col("level"), 0).otherwise(1)).withColumn("passage", F.sum("new").over(order))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n")
    return lines.where("level > 0").groupBy("row", "conv_id", "turn", "passage", "level").agg(body.alias("body"))


def units(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """The whole body, its paragraphs and its lines: kept columns, weight, norm, hash."""
    named = lambda weight, parts: F.transform(parts, lambda p: F.struct(F.lit(weight).alias("weight"), normalised(p).alias("norm")))
    parts = F.concat(named(WHOLE, F.array(body)), named(PARAGRAPH, F.split(body, r"\n[ \t]*\n")), named(LINE, F.split(body, "\n")))
    out = df.select(*keep, F.explode(parts).alias("u")).select(*keep, "u.weight", "u.norm")
    words = F.size(F.split("norm", " "))
    out = out.where((F.col("norm") != "") & ((F.col("weight") == WHOLE) | (words >= MIN_LINE_WORDS)))
    return out.withColumn("hash", F.xxhash64("norm"))


def linked(messages: DataFrame) -> DataFrame:
    """row, reply_to, n_quotes and n_linked of each row with quotations."""
    quotes = written(passages(messages), "quotes-passages")
    talks = quotes.select("conv_id").distinct()
    same = messages["conv_id"].eqNullSafe(talks["conv_id"])
    said = messages.join(talks, same, "left_semi").select("conv_id", "turn", unquoted(F.col("text")).alias("own"))
    first = units(said, "own", "conv_id", "turn").groupBy("conv_id", "hash", "norm").agg(F.min("turn").alias("said"))
    asked = units(quotes, "body", "row", "conv_id", "turn", "passage", "level").alias("q")
    on = F.expr("q.hash = o.hash and q.norm = o.norm and q.conv_id <=> o.conv_id and o.said < q.turn")
    found = asked.join(first.alias("o"), on).select("q.row", "q.passage", "q.level", "q.weight", "o.said")
    best = found.groupBy("row").agg(F.min_by("said", F.struct("level", -F.col("weight"), -F.col("said"))).alias("reply_to"), F.count_distinct("passage").alias("n_linked"))
    return quotes.groupBy("row").agg(F.count("*").alias("n_quotes")).join(best, "row", "left")


def ranked(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """``out``: place of each row among those of its group, from 0, by ``order`` (which must be total)."""
    spark = df.sparkSession
    keys = [F.asc_nulls_last(group), *order]
    at = df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    at = written(at.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")), "quotes-ranked")
    sizes = at.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    at = at.join(F.broadcast(before), "_part").withColumn("_place", F.col("_before") + F.col("_in"))  # a row for each partition
    first = at.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    return at.join(first, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, (F.col("_place") - F.col("_first")).alias(out))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per input row: conv_id, turn, role, position, reply_to, n_quotes, n_linked, text.

    Rows with a null conv_id are one conversation; null turns come last in theirs; repeated
    rows are separate messages in a fixed order.  Null text stays null and quotes nothing.
    Other columns are ignored; an empty table gives an empty result.
    """
    kinds = (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    with recorded() as made:
        rows = written(conversations.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).cast(k) for c, k in kinds]), "quotes-messages")
        both = rows.join(linked(rows), "row", "left")
    both = both.select("*", F.coalesce("reply_to", F.col("turn") - 1).alias("after"))
    placed = ranked(both, "conv_id", [F.asc_nulls_last("after"), F.asc_nulls_last("turn"), F.asc("row")], "position")
    removed(conversations.sparkSession, *made)  # what is placed is a written table of its own
    none = F.lit(0).cast("long")
    return placed.select("conv_id", "turn", "role", "position", "reply_to", F.coalesce("n_quotes", none).alias("n_quotes"), F.coalesce("n_linked", none).alias("n_linked"), unquoted(F.col("text")).alias("text"))


def chats(ordered: DataFrame, template: str = "<|%s|>\n%s\n") -> DataFrame:
    """Chat text of reply-ordered messages in segments of ``SEGMENT`` messages: conv_id, segment, n_messages, chat."""
    said = F.format_string(template, F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit("")))
    parts = ordered.select("conv_id", (F.floor(F.col("position") / SEGMENT)).alias("segment"), "position", said.alias("said"))
    chat = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "said"))), lambda x: x["said"]), "")
    return parts.groupBy("conv_id", "segment").agg(F.count("*").alias("n_messages"), chat.alias("chat"))


ORACLE = r"""
WITH lines AS (SELECT conv_id, turn, text, u.place AS place, u.line AS line, regexp_extract(u.line, '^[ \t]*>(?:[ \t]*>)*') AS marks
    FROM conversations, LATERAL (SELECT unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, unnest(range(1, 1 + len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))))) AS place) u),
 leveled AS (SELECT *, len(regexp_replace(marks, '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*>(?:[ \t]*>)*[ \t]?', '') AS body FROM lines),
 quoting AS (SELECT DISTINCT conv_id, turn FROM leveled WHERE level > 0),
 islands AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY place) AS passage FROM
    (SELECT l.*, CASE WHEN lag(level) OVER (PARTITION BY l.conv_id, l.turn ORDER BY l.place) = level THEN 0 ELSE 1 END AS fresh FROM leveled l SEMI JOIN quoting q ON l.conv_id = q.conv_id AND l.turn = q.turn)),
 passages AS (SELECT conv_id, turn, passage, level, string_agg(body, chr(10) ORDER BY place) AS body FROM islands WHERE level > 0 GROUP BY ALL),
 plain AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE level = 0 AND NOT (announces AND coalesce(next_level, 0) > 0)), ''), '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g') AS own FROM
    (SELECT *, lead(level) OVER (PARTITION BY conv_id, turn ORDER BY place) AS next_level, regexp_matches(line, '(?i)^(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió) ?:\s*$') AS announces FROM leveled) GROUP BY conv_id, turn),
 shown AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN q.turn IS NULL THEN c.text ELSE p.own END AS text FROM conversations c LEFT JOIN quoting q ON q.conv_id = c.conv_id AND q.turn = c.turn LEFT JOIN plain p ON p.conv_id = c.conv_id AND p.turn = c.turn),
 said AS (SELECT conv_id, turn, norm FROM (SELECT conv_id, turn, kind, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM
    (SELECT conv_id, turn, 2 AS kind, text AS part FROM shown UNION ALL SELECT conv_id, turn, 1, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) FROM shown UNION ALL SELECT conv_id, turn, 0, unnest(string_split(text, chr(10))) FROM shown)
    WHERE conv_id IN (SELECT conv_id FROM quoting)) WHERE norm <> '' AND (kind = 2 OR len(string_split(norm, ' ')) >= 3)),
 first_said AS (SELECT conv_id, norm, min(turn) AS said FROM said GROUP BY ALL),
 asked AS (SELECT conv_id, turn, passage, level, kind, norm FROM (SELECT conv_id, turn, passage, level, kind, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM
    (SELECT conv_id, turn, passage, level, 2 AS kind, body AS part FROM passages UNION ALL SELECT conv_id, turn, passage, level, 1, unnest(regexp_split_to_array(body, '\n[ \t]*\n')) FROM passages UNION ALL SELECT conv_id, turn, passage, level, 0, unnest(string_split(body, chr(10))) FROM passages))
    WHERE norm <> '' AND (kind = 2 OR len(string_split(norm, ' ')) >= 3)),
 found AS (SELECT a.*, f.said, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY level, kind DESC, said DESC) AS rn FROM asked a JOIN first_said f ON f.conv_id = a.conv_id AND f.norm = a.norm AND f.said < a.turn),
 best AS (SELECT conv_id, turn, min(said) FILTER (WHERE rn = 1) AS reply_to, count(DISTINCT passage) AS n_linked FROM found GROUP BY ALL),
 quotes AS (SELECT conv_id, turn, count(*) AS n_quotes FROM passages GROUP BY ALL)
SELECT s.conv_id, s.turn, s.role, row_number() OVER (PARTITION BY s.conv_id ORDER BY coalesce(b.reply_to, s.turn - 1), s.turn) - 1 AS position, b.reply_to, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, s.text
FROM shown s LEFT JOIN best b ON b.conv_id = s.conv_id AND b.turn = s.turn LEFT JOIN quotes q ON q.conv_id = s.conv_id AND q.turn = s.turn
"""
