"""MinHash near-duplicate detection with tensored banding.

Documents are linked when the Jaccard similarity of their sets of five-word shingles is
at least ``percent``/100.  Candidate search uses two small collections of ``SIDE`` hash
groups of two minhashes each; a table of the index is a *pair* of groups, one from each
collection, so 2 * 2 * 8 = 32 minhashes form 64 tables of four minhashes.  A pair of
similarity 0.85 misses all tables with probability 1 - (1 - (1 - 0.85**2)**8)**2 < 1e-4, one
of similarity 0.80 with probability 6e-4.

Equal sets are one node from the start.  Nodes that share a table key are linked in two
rounds, and every link is confirmed on the full sets:

* each node against three members of each of its keys (picked by salted node numbers, the
  same for all nodes of the key), the closest sketches first;
* every remaining pair across components that shares a table key, whatever their number.
  A key's nodes are cut into blocks of bounded rows and words, and pairs of blocks are dealt
  out, so no task holds a large key.  The largest component of a key is only compared with
  the nodes outside it.  Pairs are compared inside the task; only links leave it.

Copies inside one component are never expanded into pairs, and no pair across components
is left out but those whose 32 four-bit sketches differ in more than ``allowed_mismatches``
places (below 1e-6 of the pairs at the threshold).  Components are found by alternating
star contractions over written tables; nothing is collected.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, shuffle_partitions, written
from .shingles import mix, shingle_sets, slices

SIDE = 8
PER_GROUP = 2
HASHES = 2 * SIDE * PER_GROUP
CLOSEST = 4
#: Members of a key that all its nodes are compared with: those of the smallest numbers, salted.
HUBS = (0, 0x2A5F3C71D9B, 0x155AC38E264)
#: Candidate ids that are broadcast at most (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SALT = mix(np.arange(1, 2 * SIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

SIGNATURES_SQL = "doc_id long, text_hash long, n long, fp binary, a array<long>, b array<long>, x1 long, x2 long"


def _fingerprints(s: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two sums over differently mixed members, and the size."""
    full = n > 0
    sums = np.zeros((len(n), 2), dtype=np.uint64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        if full.any():
            sums[full, k] = np.add.reduceat(mix(s ^ np.uint64(salt)), at[:-1][full])
    sums = mix(sums + n[:, None].astype(np.uint64))
    raw = sums.tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(n))]


def _signatures(batches):
    for batch in batches:
        for first, data, bounds in slices(batch.column(2)):
            s, at = shingle_sets(data, bounds)
            n = np.diff(at)
            full, k = n > 0, len(n)
            mins = np.zeros((k, HASHES), dtype=np.uint64)
            if full.any():
                for h in range(HASHES):
                    mins[full, h] = np.minimum.reduceat(s * _A[h] + _B[h], at[:-1][full])
            groups = mix(mix(mins[:, 0::2]) * np.uint64(3) + mix(mins[:, 1::2] + np.uint64(1)) + _SALT)
            nibbles = (mix(mins) & np.uint64(15)).reshape(k, 2, 16)
            sketch = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
            offsets = pa.array(np.arange(k + 1, dtype=np.int32) * SIDE)
            side = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(groups[:, i * SIDE : (i + 1) * SIDE]).view(np.int64).ravel())) for i in (0, 1)]
            given = [batch.column(c).slice(first, k) for c in (0, 1)]
            columns = [*given, pa.array(n), pa.array(_fingerprints(s, at, n), pa.binary()), *side, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "fp", "a", "b", "x1", "x2"])


SETS_SQL = "fp binary, s array<long>"


def _sets(batches):
    for batch in batches:
        for _, data, bounds in slices(batch.column(0)):
            s, at = shingle_sets(data, bounds)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(s, at, np.diff(at)), pa.binary()), lists], names=["fp", "s"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text as it is, set size, set fingerprint, the two collections of hash groups, and the sketch."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(_signatures, SIGNATURES_SQL)


def mismatches(*pairs: tuple[Column, Column]) -> Column:
    """Places in which two four-bit sketches differ."""
    total = F.lit(0)
    for x, y in pairs:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def allowed_mismatches(percent: int) -> int:
    """Places in which sketches may differ: more have a probability below 1e-6 at the threshold (16 for 85, 18 for 80)."""
    p, tail = (1 - percent / 100) * 15 / 16, 0.0
    for k in range(HASHES, 0, -1):
        tail += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if tail >= 1e-6:
            return k
    return 0


#: Edges (at most 80 MB of them) that one executor task joins by union-find; beyond, stars are contracted over the cluster.
TASK_EDGES = 200_000


def _union_find(batches):
    """Node and smallest member of its component, for nodes that are not the smallest."""
    parent: dict = {}

    def top(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    found = [(x, label) for x in list(parent) if (label := top(x)) != x]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found, strict=True)], names=["node", "label"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)`` but the smallest of its component, which is the label.

    A counted, small number of edges takes one pass of union-find on an executor.  More take
    alternating large-star and small-star steps (Kiveris et al., 2014), each a minimum by key
    and a join, until the edges no longer change.
    """

    def digest(e):
        return e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "cc")
    before = digest(e)
    if before["n"] <= task_edges:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_union_find, f"node {kind}, label {kind}")
    while before["n"]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, e = e, written(small.select("e.*").where("u != v").distinct(), "cc")
        dropped(old)
        after = digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


#: Rows, and words of their sets, of a block of a key's nodes: what one comparison holds of either side.
BLOCK, BLOCK_WORDS = 256, 4_000_000


def _differ(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Places in which sketches differ, for each x and y."""
    total = np.zeros((len(x1), len(y1)), dtype=np.uint8)
    for x, y in ((x1, y1), (x2, y2)):
        d = x[:, None] ^ y[None, :]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        total += np.bitwise_count(d & np.uint64(0x1111111111111111))
    return total


class Cell:
    """The nodes of one pair of blocks of one table key; ``side`` is 0 in both blocks, 1 in the first, 2 in the second."""

    def __init__(self, rows: pa.Table):
        get = lambda name: rows.column(name).to_numpy()
        side, self.node, self.label, self.n = get("side"), get("node"), get("label"), get("n")
        self.x, self.y = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        self.sketch = [get(name).view(np.uint64) for name in ("x1", "x2")]
        self.groups = [rows.column(name).combine_chunks().flatten().to_numpy().reshape(-1, SIDE) for name in ("a", "b")]
        self.at = int(get("k")[0]), int(get("j")[0])

    def possible(self, percent: int, allowed: int) -> np.ndarray:
        """Which x may be linked to which y, for pairs across components that no earlier table has."""
        x, y = self.x, self.y
        ok = (self.label[x][:, None] != self.label[y][None, :]) & (self.node[x][:, None] != self.node[y][None, :])
        n, m = self.n[x][:, None], self.n[y][None, :]
        ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        if ok.any():
            ok &= _differ(self.sketch[0][x], self.sketch[1][x], self.sketch[0][y], self.sketch[1][y]) <= allowed
        for group, until in zip(self.groups, self.at, strict=True):
            for g in range(until if ok.any() else 0):
                ok &= group[x, g][:, None] != group[y, g][None, :]
        return ok

    def links(self, ok: np.ndarray, sets: pa.ListArray, percent: int) -> list[tuple[int, int]]:
        """Labels of components that a confirmed pair joins; pairs within what is joined already are not confirmed again."""
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while (p := parent.setdefault(c, c)) != c:
                parent[c] = c = parent[p]
            return c

        found, member = [], self.label.tolist()
        for i, row in zip(self.x.tolist(), ok, strict=True):
            mates = [j for j in self.y[np.flatnonzero(row)].tolist() if top(member[j]) != top(member[i])]
            if not mates:
                continue
            mine, theirs = sets[i].values.to_numpy().view(np.uint64), [sets[j].values.to_numpy().view(np.uint64) for j in mates]
            every = np.concatenate(theirs)
            place = np.searchsorted(mine, every)
            hit = mine[np.minimum(place, len(mine) - 1)] == every
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum([0] + [len(t) for t in theirs[:-1]]))
            for j, shared, t in zip(mates, both.tolist(), theirs, strict=True):
                if 100 * shared >= percent * (len(mine) + len(t) - shared) and top(member[i]) != top(member[j]):
                    found.append((member[i], member[j]))
                    u, v = top(member[i]), top(member[j])
                    parent[max(u, v)] = min(u, v)
        return found


def _cells(batches) -> Iterator[pa.Table]:
    """Rows of one cell at a time, from batches in which cells follow each other."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        keys = np.column_stack([rows.column(c).to_numpy() for c in CELL])
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            yield rows.slice(at, end - at)
        rest = rows.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


CELL = ("key", "ci", "cj")
ROW_SQL = "key long, ci long, cj long, side int, node long, label long, n long, x1 long, x2 long, a array<long>, b array<long>, k int, j int"


def _may_link(percent: int):
    """Rows of cells that have a possible partner in their cell."""
    allowed = allowed_mismatches(percent)

    def run(batches):
        for rows in _cells(batches):
            cell = Cell(rows)
            ok = cell.possible(percent, allowed)
            some = np.unique(np.concatenate([cell.x[ok.any(axis=1)], cell.y[ok.any(axis=0)]]))
            if len(some):
                yield from rows.take(some).combine_chunks().to_batches()

    return run


def _confirmed(percent: int):
    """Pairs of labels that confirmed links join, cell by cell."""
    allowed = allowed_mismatches(percent)

    def run(batches):
        for rows in _cells(batches):
            cell = Cell(rows)
            found = cell.links(cell.possible(percent, allowed), rows.column("s").combine_chunks(), percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    return run


class Linker:
    """The nodes that share table keys, their tables and sets, and the components found so far.

    ``moved`` is ``(node, label)`` for the nodes whose component has another label than they.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int):
        self.spark, self.percent, self.temporary = docs.sparkSession, percent, []
        self.parts = shuffle_partitions(self.spark)
        halves = nodes.select("node", "n", F.posexplode(F.concat("a", "b")).alias("k", "v"))
        often = halves.groupBy("v").count().where("count > 1").select("v")
        hits = halves.join(often, "v", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("k", "v")).alias("g"))
        sides = [F.filter("g", lambda g: g["k"] < SIDE), F.filter("g", lambda g: g["k"] >= SIDE)]
        keys = hits.select("node", "n", F.explode(sides[0]).alias("l"), sides[1].alias("r")).select("node", "n", "l", F.explode("r").alias("r"))
        keys = self.write(keys.select("node", "n", F.xxhash64("l.v", "r.v").alias("key"), F.col("l.k").alias("k"), (F.col("r.k") - SIDE).alias("j")), "near-keys")
        picks = [F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"h{i}") for i, x in enumerate(HUBS)]
        shared = keys.groupBy("key").agg(F.count("*").alias("_many"), *picks).where("_many > 1").drop("_many")
        self.tables = self.write(keys.join(shared, "key"), "near-tables")
        self.info = self.write(nodes.join(self.tables.select("node").distinct(), "node", "left_semi"), "near-nodes")
        ids = self.write(self.info.select("id"), "near-ids")
        bounded = ids.count() <= BROADCAST_IDS
        some = docs.join(F.broadcast(ids) if bounded else ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select(F.col("text").cast("string"))
        sets = some.mapInArrow(_sets, SETS_SQL).join(self.info.select("node", "fp"), "fp").select("node", "s")
        self.sets = self.write(sets.repartition(self.parts, "node").dropDuplicates(["node"]), "near-sets", "lz4")

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """A written table that goes when the links are found."""
        self.temporary.append(written(df, name, codec))
        return self.temporary[-1]

    def against_some(self) -> None:
        """Links each node to the closest of the picked members of its keys."""
        tables, info = self.tables, self.info.select("node", "n", "x1", "x2")
        pairs = tables.select(F.col("node").alias("u"), F.explode(F.array(*[f"h{i}" for i in range(len(HUBS))])).alias("v")).where("u != v").groupBy("u").agg(F.collect_set("v").alias("v"))
        pairs = pairs.alias("p").join(info.alias("x"), F.expr("p.u = x.node")).select("x.*", F.explode("p.v").alias("v")).alias("x").join(info.alias("y"), F.expr("x.v = y.node"))
        a, b = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        far = mismatches((a("x1"), b("x1")), (a("x2"), b("x2")))
        near = (100 * F.least(a("n"), b("n")) >= self.percent * F.greatest(a("n"), b("n"))) & (far <= allowed_mismatches(self.percent))
        closest = pairs.where(near).select(a("node").alias("u"), F.struct(far.alias("far"), F.col("v")).alias("c")).groupBy("u").agg(F.slice(F.sort_array(F.collect_list("c")), 1, CLOSEST).alias("c"))
        x, y = self.sets.select(F.col("node").alias("u"), F.col("s").alias("sx")), self.sets.select(F.col("node").alias("v"), F.col("s").alias("sy"))
        found = closest.join(x, "u").select("u", "sx", F.explode("c.v").alias("v")).join(y, "v")
        both = F.size(F.array_intersect("sx", "sy"))
        self.moved = self.write(components(found.where(100 * both >= self.percent * (F.size("sx") + F.size("sy") - both)).select("u", "v")), "near-moved")

    def remaining(self) -> None:
        """Links every pair across components that shares a table key."""
        rows = self.tables.select("key", "node", "n", "k", "j").join(self.moved, "node", "left").select("key", "node", "n", "k", "j", F.coalesce("label", "node").alias("label"))
        by = rows.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("words"))
        main = F.max_by(F.struct("label", "rows", "words"), F.struct("rows", "label")).alias("main")
        mixed = by.groupBy("key").agg(F.count("*").alias("labels"), F.sum("rows").alias("rows"), F.sum("words").alias("words"), main).where("labels > 1")
        blocks = lambda rows, words: F.greatest(F.ceil(rows / BLOCK), F.ceil(words / BLOCK_WORDS)).cast("long")
        mixed = mixed.select("key", blocks(F.col("rows"), F.col("words")).alias("every"), blocks(F.col("rows") - F.col("main.rows"), F.col("words") - F.col("main.words")).alias("others"), blocks(F.col("main.rows"), F.col("main.words")).alias("mains"), F.col("main.label").alias("main"))
        rows = rows.join(mixed, "key").join(self.info.select("node", "x1", "x2", "a", "b"), "node")
        one, inside = F.col("every") == 1, F.col("label") == F.col("main")
        dealt = lambda n: F.pmod(F.xxhash64("node"), n)
        block = F.when(one, 0).when(inside, F.col("others") + dealt(F.col("mains"))).otherwise(dealt(F.col("others")))
        last = F.when(one, 0).when(inside, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
        rows = rows.withColumn("block", block).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("c"))
        side = F.when(F.col("c") == F.col("block"), 0).when(F.col("c") > F.col("block"), 1).otherwise(2)
        rows = rows.select("key", F.least("c", "block").alias("ci"), F.greatest("c", "block").alias("cj"), side.alias("side"), "node", "label", "n", "x1", "x2", "a", "b", "k", "j")
        together = lambda df: df.repartition(self.parts, *CELL).sortWithinPartitions(*CELL, "node")
        possible = self.write(together(rows).mapInArrow(_may_link(self.percent), ROW_SQL), "near-cells", "lz4")
        found = together(possible.join(self.sets, "node")).mapInArrow(_confirmed(self.percent), "u long, v long")
        again = self.write(components(found).select(F.col("node").alias("label"), F.col("label").alias("to")), "near-moved-again")
        ends = self.moved.select("node", "label").union(again.select("label", "label"))  # labels themselves may move, too
        self.moved = ends.join(again, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _grouped(docs: DataFrame, percent: int, last: Callable) -> DataFrame:
    """``last`` of rows (doc_id, text_hash, n, component, component_id), written; ``component`` is null for empty sets."""
    sig = written(signatures(docs), "near-signatures")
    nodes = sig.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", "a", "b", "x1", "x2")])
    nodes = written(nodes.select("*", F.monotonically_increasing_id().alias("node")), "near-all-nodes")
    found = Linker(docs, nodes, percent)
    found.against_some()
    found.remaining()
    named = nodes.select("node", "fp", "id").join(found.moved, "node", "left").select("fp", "id", F.coalesce("label", "node").alias("component"))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    rows = sig.select("doc_id", "text_hash", "n", "fp").join(named.select("fp", "component").join(ids, "component"), "fp", "left")
    out = written(last(rows.drop("fp")), "near-result")
    for table in (sig, nodes, *found.temporary):
        dropped(table)
    return out


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null texts and texts without words have an empty set: each is its own component.
    Rows with the same words are one node, whatever their number.  A null doc_id belongs
    to a component but never names one that has another id.  Other columns are ignored;
    an empty table gives an empty result.
    """
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _grouped(docs, percent, lambda rows: rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")))


def without_near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The input's rows without near copies: of each component the row with the smallest id stays.

    Of rows that share that id, the one with the smallest hash of its text stays, and one of
    repeated rows.  All rows with empty sets stay.
    """
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")

    def leaving(rows: DataFrame) -> DataFrame:
        some = rows.where("n > 0")
        by = some.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
        stays = by.groupBy("component").agg(F.min(first).alias("stays"))
        return by.join(stays, "component").select("doc_id", "text_hash", "copies", (first == F.col("stays")).alias("stays")).where("not stays or copies > 1")

    gone = _grouped(docs, percent, leaving)
    n, (of_id, of_hash, of_text) = gone.count(), (f"near_{uuid.uuid4().hex}" for _ in range(3))
    out = docs.select("*", F.xxhash64(docs["text"].cast("string")).alias(of_text))
    gone = gone.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), "stays")
    gone = F.broadcast(gone) if n <= BROADCAST_IDS else gone
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(of_id)) & (F.col(of_text) == F.col(of_hash))
    once = out.join(gone.where("stays"), same, "left_semi").dropDuplicates(["doc_id", of_text])
    return out.join(gone, same, "left_anti").unionByName(once).drop(of_text)
