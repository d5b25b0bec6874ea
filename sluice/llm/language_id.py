"""Language identification by words first, then shorter and shorter character n-grams.

A known word scores its log frequency in each language.  An unseen word is scored by its
character n-grams of the greatest length for which any is known, from ``LONGEST`` down to
single letters.  A text's score is the sum over its words; frequencies are smoothed, so no
language is ever ruled out by one word.

Training fits on a bounded sample: of each language the labelled rows with the smallest
keyed hashes, ``max_docs`` shared evenly among the languages (``MIN_DOCS`` each at least), so
a rare language is learned as well as a frequent one.  The counting is distributed.  Kept are
the ``max_words`` words and ``max_ngrams`` n-grams that make up the largest share of any
language.  So the model has a fixed size bound and can be sent to every worker.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import character_class, dropped, written

LONGEST = 5
MAX_TRAINING_DOCS = 8192
MIN_DOCS = 64
MAX_WORDS = 60_000
MAX_NGRAMS = 120_000
KEPT_WORDS = 200_000
UNDETERMINED = "und"
#: Runs of letters of any script; for Java, and for Python (where \w holds digits, other numbers and _ too).
_JAVA_WORDS = r"\p{L}+"
_WORDS = re.compile(rf"[^\W\d_{character_class(('Nl', 'No'))}]+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; the letters alone for n = 1."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language of words and n-grams.

    ``words[w]`` and ``ngrams[g]`` are rows of ``table``, whose columns are ``languages``.
    """

    def __init__(self, languages: list[str], words: dict[str, int], ngrams: dict[str, int], table: np.ndarray):
        self.languages, self.words, self.ngrams, self.table = languages, words, ngrams, table
        self.kept: dict[str, int] = dict(words)
        self.used = len(table)
        self.rows = np.zeros((self.used + KEPT_WORDS, len(languages)))
        self.rows[: self.used] = table

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that is not known: the mean over its longest known n-grams."""
        for n in range(LONGEST, 0, -1):
            known = [i for g in grams(word, n) if (i := self.ngrams.get(g)) is not None]
            if known:
                return self.table[known].sum(axis=0) / len(known)
        return np.zeros(len(self.languages))

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """Sum of the words' log frequencies by language, and the number of words."""
        words = _WORDS.findall(text.lower())
        total = np.zeros(len(self.languages))
        at = list(map(self.kept.get, words))
        if None in at:
            for w in [w for w, i in zip(words, at, strict=True) if i is None]:
                i = self.kept.get(w)
                if i is not None:
                    total += self.rows[i]
                    continue
                found = self.unseen(w)
                total += found
                if self.used < len(self.rows):
                    self.rows[self.used] = found
                    self.kept[w] = self.used
                    self.used += 1
            at = [i for i in at if i is not None]
        return (total + self.rows[at].sum(axis=0) if at else total), len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its posterior under equal priors (per-word evidence damped by the square root of the length)."""
        s, n = self.scores(text or "")
        if not n or not self.languages:
            return UNDETERMINED, 0.0
        z = (s - s.max()) / math.sqrt(n)
        p = np.exp(z)
        best = int(s.argmax())
        return self.languages[best], float(min(1.0, p[best] / p.sum()))


def _logs(counted: pa.Table, languages: list[str], totals: dict[str, int], first: int) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies, each mixed with a tenth of the mean over languages so that none is zero.

    They are centred: an item equally frequent everywhere scores 0.
    """
    counts = np.column_stack([counted.column(f"n{k}").to_numpy() for k in range(len(languages))]).astype(float)
    rates = counts / np.array([totals[x] for x in languages], dtype=float)
    logs = np.log(0.9 * rates + 0.1 * rates.mean(axis=1, keepdims=True))
    return {item: first + k for k, item in enumerate(counted.column("item").to_pylist())}, logs - logs.mean(axis=1, keepdims=True)


def sampled(labelled: DataFrame, max_docs: int) -> DataFrame:
    """(lang, text) of the rows to fit on, ``max_docs`` or ``MIN_DOCS`` for each language; null texts and languages are left out."""
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if sum(found.values()) > max_docs:
        each = max(MIN_DOCS, max_docs // len(found))
        # a keyed hash below the language's threshold, with room for chance, then the exact bound
        share = {x: int(min(1.0, 1.2 * each / n + 50 / n) * (1 << 30)) for x, n in found.items()}
        limits = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
        rows = rows.withColumn("hash", F.xxhash64(F.lit("language"), "doc_id", "text")).where(F.pmod("hash", F.lit(1 << 30).cast("long")) < F.element_at(limits, F.col("lang")))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30).cast("long")), "hash", "doc_id"))
        rows = rows.withColumn("nth", nth).where(F.col("nth") <= each)
    return rows.select("lang", "text")


def train(labelled: DataFrame, max_docs: int = MAX_TRAINING_DOCS, max_words: int = MAX_WORDS, max_ngrams: int = MAX_NGRAMS) -> Model:
    """Fit on (doc_id, text, lang) rows; rows with a null text or lang are not used."""
    words = sampled(labelled, max_docs).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_JAVA_WORDS})"), F.lit(1))).alias("item")).groupBy("lang", "item").count()
    words = written(words, "language-words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], {}, {}, np.zeros((0, 0)))

    def frequent(counts: DataFrame, limit: int) -> pa.Table:
        """The items of the largest shares and a column of counts for each language, in Arrow's form."""
        by = counts.groupBy("item").agg(*[F.sum(F.when(F.col("lang") == x, F.col("count")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(languages)])
        share = F.greatest(*[F.col(f"n{k}") / totals[x] for k, x in enumerate(languages)], F.lit(0.0))
        return by.orderBy(share.desc(), "item").limit(limit).toArrow()

    known, table = _logs(frequent(words, max_words), languages, totals, 0)
    marked = F.concat(F.lit("<"), "item", F.lit(">"))

    def of_length(n: int) -> Column:
        """The n-grams of an item (``grams``)."""
        text, last = (F.col("item"), F.length("item")) if n == 1 else (marked, F.length("item") + 3 - n)
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    pieces = words.select("lang", "count", F.explode(F.concat(*map(of_length, range(1, LONGEST + 1)))).alias("item")).groupBy("lang", "item").agg(F.sum("count").alias("count"))
    ngrams, more = _logs(frequent(pieces, max_ngrams), languages, totals, len(known))
    dropped(words)
    return Model(languages, known, ngrams, np.concatenate([table, more]))


def identify(docs: DataFrame, model: Model, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input's columns and the prediction; input columns of the new names give way.

    Predictions read the text alone.  A null text, or one without a letter, is ``und`` with score 0.
    """
    keep = [c for c in docs.columns if c.lower() not in (language.lower(), score.lower())]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.ngrams, model.table))

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(at).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                names=[*batch.schema.names, language, score],
            )

    at = keep.index("text")
    given = docs.select(*[F.col(f"`{c}`") for c in keep])
    return given.mapInArrow(run, f"{schema + ', ' if schema else ''}`{language}` string, `{score}` double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no training may read: crc32 of the id as text is 2 modulo 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; trained on the rows that are not held out.

    An empty table, or one without labelled rows, gives ``und`` everywhere.
    """
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
