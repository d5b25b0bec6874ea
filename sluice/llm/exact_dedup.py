"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical after each run of ASCII white space
becomes one space.  The work is done three times at different reach, always by
the same table:

1. every scan task feeds its rows to an open-addressing table that compares
   complete content, and hands on one representative per text instead of all
   copies, so a text that fills a third of the corpus leaves a task once;
2. the representatives are hash-partitioned over the cluster (the first level of
   Grace partitioning);
3. each of those partitions is partitioned further into spill files, level by
   level, until a bucket fits the table's memory, and is then resolved.

Which representative stands for which row is written to the shared folder
between 1 and 2, so a retried task can't change it.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, dropped, shuffle_partitions, written

_SPACES = b" \t\n\x0b\x0c\r"
FANOUT_BITS = 4
MAX_LEVEL = 12


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each white-space run as one space; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in _SPACES else b"") + b" ".join(words) + (b" " if raw[-1] in _SPACES else b"")


class OpenTable:
    """Open addressing with linear probing over complete contents.

    Each content has the running summary ``[smallest id, row of it, rows]``.
    A null id sorts after every other; equal ids are ordered by row.
    """

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[list] = []
        self.size = 0

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = k

    def add(self, h: int, content: bytes, doc_id: int | None, row: int, n: int) -> int:
        """Number of the content in the table."""
        mask = len(self.slots) - 1
        i = h & mask
        while (k := self.slots[i]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                best = self.best[k]
                best[2] += n
                if (doc_id is None, doc_id or 0, row) < (best[0] is None, best[0] or 0, best[1]):
                    best[0], best[1] = doc_id, row
                return k
            i = (i + 1) & mask
        k = self.slots[i] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append([doc_id, row, n])
        self.size += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k


def digest(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def hash64(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


LOCAL = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("sha", pa.binary()), ("content", pa.binary())]
)
LOCAL_SQL = "row long, doc_id long, rep long, n long, h long, sha binary, content binary"


def _local(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        row, table, first = 0, OpenTable(), []

        def representatives(table: OpenTable, first: list[int]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(first), 512):
                part = range(at, min(at + 512, len(first)))
                shas = [digest(table.contents[k]) for k in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([table.best[k][1] for k in part], pa.int64()),
                        pa.array([table.best[k][0] for k in part], pa.int64()),
                        pa.array([first[k] for k in part], pa.int64()),
                        pa.array([table.best[k][2] for k in part], pa.int64()),
                        pa.array([hash64(s) for s in shas], pa.int64()),
                        pa.array(shas, pa.binary()),
                        pa.array([table.contents[k] for k in part], pa.binary()),
                    ],
                    schema=LOCAL,
                )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            given = range(base + row, base + row + len(ids))
            rows, reps = [], []
            for doc_id, text, at in zip(ids, texts, given, strict=True):
                content = normalise(text.as_py())
                k = table.add(hash(content), content, doc_id, at, 1)
                if k == len(first):
                    first.append(at)
                rows.append(at)
                reps.append(first[k])
            row += len(ids)
            empty = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((rows, ids, reps, empty, empty, empty, empty), LOCAL.types, strict=True)], schema=LOCAL)
            if table.size > memory:
                yield from representatives(table, first)
                table, first = OpenTable(), []
        yield from representatives(table, first)

    return run


def grace(records: Iterator[tuple], memory: int, folder: str, level: int = 0) -> Iterator[tuple[int, int | None, int, int, bytes]]:
    """Resolve records ``(h, rep, doc_id, row, n, sha, content)`` within ``memory`` bytes of table.

    Yields ``(rep, keep_id, keep_row, group_size, sha)``.  Once a table is full, it and
    everything still to come goes to spill files by the next bits of the hash, and each
    file is resolved by itself.  Equal contents share all bits and add no content to a
    table, so only different texts ever force another level.
    """
    table, reps, spills = OpenTable(), [], None
    seen: list[tuple] = []
    for rec in records:
        if spills is not None:
            pickle.dump(rec, spills[(rec[0] >> (level * FANOUT_BITS)) & (2**FANOUT_BITS - 1)], protocol=5)
            continue
        h, rep, doc_id, row, n, sha, content = rec
        reps.append((rep, table.add(h, content, doc_id, row, n), sha))
        seen.append((h, rep, doc_id, row, n, sha))
        if table.size + 120 * len(reps) > memory and len(table.contents) > 1 and level < MAX_LEVEL:
            spills = [open(f"{folder}/{level}-{i}", "wb") for i in range(2**FANOUT_BITS)]  # noqa: SIM115
            for rec, (_, k, _) in zip(seen, reps, strict=True):
                pickle.dump((*rec, table.contents[k]), spills[(rec[0] >> (level * FANOUT_BITS)) & (2**FANOUT_BITS - 1)], protocol=5)
            table, reps, seen = OpenTable(), [], []
    if spills is None:
        for rep, k, sha in reps:
            best = table.best[k]
            yield rep, best[0], best[1], best[2], sha
        return
    for f in spills:
        f.close()
    for f in spills:
        yield from grace(_spilled(f.name), memory, folder, level + 1)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        Path(path).unlink()  # the space is given back when the file is closed
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


GLOBAL = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("sha", pa.binary())])
GLOBAL_SQL = "rep long, keep_id long, keep_row long, group_size long, sha binary"


def _global(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                cols = [batch.column(i) for i in range(7)]
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in cols)

        with tempfile.TemporaryDirectory() as folder:
            out: list[tuple] = []
            for rec in grace(records(), memory, folder):
                out.append(rec)
                if len(out) >= 8192:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), GLOBAL.types, strict=True)], schema=GLOBAL)


#: Dropped rows that ``deduplicated`` broadcasts at most (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def exact_dedup(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is the empty text.  A null doc_id sorts after all others; of rows that
    share text and smallest doc_id, one is kept.  An empty table gives an empty result,
    and other columns of ``docs`` are ignored.  ``memory`` bounds the bytes of one table, as far
    as ``MAX_LEVEL`` levels of 16 spill files each can separate different texts (16**12 buckets a
    task); a single text is held whole.
    """
    spark = docs.sparkSession
    local = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_local(memory), LOCAL_SQL), "dedup-local")
    reps = local.where("n is not null").select("h", "rep", "doc_id", "row", "n", "sha", "content")
    found = reps.repartition(shuffle_partitions(spark), "h").mapInArrow(_global(memory), GLOBAL_SQL)
    rows = local.where("n is null").select("row", "doc_id", "rep").join(found, "rep", "left")
    kept = F.col("row") == F.col("keep_row")
    out = written(rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")), "dedup-rows")
    dropped(local)
    return out


def deduplicated(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """The input's rows without those that ``exact_dedup`` drops.

    Rows are told apart by doc_id and text.  Of rows that repeat both, one stays.
    """
    found = exact_dedup(docs, memory)
    keys = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = written(keys, "dedup-keys")
    dropped(found)
    of_id, of_sha, of_text = (f"dedup_{uuid.uuid4().hex}" for _ in range(3))  # no input column has these names
    gone = keys.where("not kept").select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_sha))
    repeated = keys.where("kept and n > 1").limit(1).count()
    gone = F.broadcast(gone) if keys.where("not kept").count() <= BROADCAST_ROWS else gone
    sha = F.sha2(F.encode(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), f"[{SPACE}]+", " "), "UTF-8"), 256)
    hashed = docs.withColumn(of_text, sha)
    kept = hashed.join(gone, hashed["doc_id"].eqNullSafe(F.col(of_id)) & (F.col(of_text) == F.col(of_sha)), "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", of_text])
    return kept.select(*[f"`{c}`" for c in docs.columns])


ORACLE = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
"""
