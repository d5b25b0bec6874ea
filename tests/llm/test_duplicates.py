"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import pyarrow as pa

from sluice.llm import exact_dedup, near_dedup
from sluice.llm.shingles import shingle_sets, slices, word_hashes

SPACE = re.compile("[\x20\x09-\x0d]+")


def norm(t):
    return SPACE.sub(" ", t or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return {t: (min((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}


def edge_rows():
    rng = random.Random(4)
    long = "w " * 60_000
    rows = [(10, "a b"), (3, "a \t\n b"), (7, " a b"), (8, "a b "), (9, "a\xa0b"), (1, None), (2, ""), (4, "  "), (None, "a b"), (None, "only null ids"), (11, long), (12, long), (3, "a b"), (13, "A b")]
    rows += [(100 + i, rng.choice(["hot", "hot ", "x%d" % (i % 9)])) for i in range(300)]
    return rows


def test_normalisation_is_the_regular_expression():
    for t in ("", " ", "\n\n", " a", "a ", "a\x0b\x0cb\r\n c", "\x1ca\x1d", "é  é"):
        assert exact_dedup.normalise(t) == norm(t).encode()


def check_exact(got, rows):
    want = brute_exact(rows)
    assert len(got) == len(rows)
    kept = {}
    for r, (i, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        assert r.doc_id == i
    by = {}
    for i, t in rows:
        by.setdefault((i, hashlib.sha256(norm(t).encode()).hexdigest()), []).append(norm(t))
    for r in got:
        t = by[r.doc_id, r.text_sha256][0]
        assert (r.keep_id, r.group_size) == want[t]
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[t] = kept.get(t, 0) + 1
    assert kept == dict.fromkeys(want, 1)


def test_exact_dedup(spark):
    rows = edge_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, keep_id string, row int").repartition(5)
    check_exact(exact_dedup.exact_dedup(docs).collect(), rows)
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0


def test_exact_dedup_spills_recursively(spark):
    rows = edge_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_exact(exact_dedup.exact_dedup(docs, memory=600).collect(), rows)


def test_grace_recursion_compares_contents_not_hashes(tmp_path):
    # one hash for all: no level separates them, contents still do
    recs = [(5, k, k, k, 1, b"", str(k % 7).encode()) for k in range(100)]
    out = list(exact_dedup.grace(iter(recs), 500, str(tmp_path)))
    assert sorted(x[0] for x in out) == list(range(100))
    assert all(keep == rep % 7 and n == len(range(rep % 7, 100, 7)) for rep, keep, _, n, _ in out)
    assert not list(tmp_path.iterdir())


def test_deduplicated_keeps_columns(spark):
    rows = edge_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _other string")
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns and sorted(norm(r.text) for r in got.collect()) == sorted(brute_exact(rows))


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    return [w for w in SPACE.split(low) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows, percent=85):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for k in range(len(rows)):
        i = rows[k][0]
        if sets[k] and i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(len(sets[k]), low.get(find(k)) if sets[k] else rows[k][0]) for k in range(len(rows))]


def near_rows(n=220, seed=2):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        for _ in range(n // 12):
            t = list(text)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 100)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  TWO"), (2005, "a b c d e"), (2006, "a b c d e f"), (2007, "é É é É é"), (2008, "w1 " * 30_000), (None, rows[0][1]), (2009, rows[3][1]), (2009, rows[3][1])]
    return rows


def test_shingle_kernel_counts():
    texts = [t for _, t in near_rows()]
    for at, data, bounds in slices(pa.array(texts), 700):
        s, offsets = shingle_sets(data, bounds)
        w, first = word_hashes(data, bounds)
        for k in range(len(bounds) - 1):
            assert offsets[k + 1] - offsets[k] == len(shingles(texts[at + k])) and first[k + 1] - first[k] == len(words(texts[at + k]))


def test_shingles_of_very_few_words():
    for texts in (["one"], ["one two"], ["a", "b"], ["a b c d"], ["", "x"], [""]):
        for _, data, bounds in slices(pa.array(texts)):
            s, offsets = shingle_sets(data, bounds)
            assert [offsets[k + 1] - offsets[k] for k in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_blocks_of_a_large_key_lose_no_pair(spark, monkeypatch):
    rows = near_rows(140, 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), n, str(c)) for (i, _), (n, c) in zip(rows, brute_near(rows), strict=True))
    for block, words in ((3, 10**9), (10**9, 500), (7, 2000)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_WORDS", words)
        # nothing is linked by the first round, so every link is found between blocks
        monkeypatch.setattr(near_dedup, "CLOSEST", 0 if block == 3 else 1)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_dedup(docs).collect()) == want


def test_rows_that_share_an_id_are_told_apart(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(5, " ".join(base), "x"), (5, " ".join([*base[:-1], "z"]), "y"), (5, " ".join(base), "x"), (6, " ".join(base), "x"), (7, "something else entirely here now", "q"), (7, "something else entirely here now", "q"), (None, " ".join(base), "n"), (8, "", "e"), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_id string")
    got = [(r.doc_id, r.text) for r in near_dedup.without_near_copies(docs, 80).collect()]
    assert sorted(i for i, _ in got) == [5, 7, 8, 8] and docs.columns == near_dedup.without_near_copies(docs, 80).columns


def test_near_dedup_equals_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string").repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_dedup(docs).collect())
    want = sorted((str(i), n, str(c), i == c) for (i, _), (n, c) in zip(rows, brute_near(rows), strict=True))
    assert got == want
    assert near_dedup.near_dedup(docs.where("false")).count() == 0


def test_near_copies_are_dropped(spark):
    rows = near_rows(60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.without_near_copies(docs).collect()}
    assert kept == {i for (i, _), (_, c) in zip(rows, brute_near(rows), strict=True) if i == c}


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 120], "u long, v long")
    for task_edges in (0, 1000):  # over the cluster, and in one task
        got = {r.node: r.label for r in near_dedup.components(edges, task_edges).collect()}
        assert got == {i: 0 if i <= 120 else 121 for i in range(n + 1) if i not in (0, 121)}
    assert near_dedup.components(edges.where("false")).count() == 0


def test_both_ways_of_joining_components_agree(spark, monkeypatch):
    rows = near_rows(96, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = sorted(map(str, near_dedup.near_dedup(docs).collect()))
    monkeypatch.setattr(near_dedup.components, "__defaults__", (0,))
    assert sorted(map(str, near_dedup.near_dedup(docs).collect())) == small
