"""Quality scores by co-training two views.

The text view sees what is in a document (its words, hashed into ``BUCKETS`` shares, character
classes, repetition of words and lines, word lengths); the metadata view sees what is known about it (source, language,
stated length).  Both are logistic regressions.  In each round every view labels all
unlabelled documents of which it is sure, and hands them to the *other* view; a view
that is never sure enough hands over nothing.  At the end each view is calibrated on
labelled documents that took no part in training, and the calibrated log odds are added.

Fitting reads a bounded sample of the labelled documents, the ``MAX_LABELLED`` of the smallest
keyed hashes of their ids, and *all* other documents: their features are written once,
and each Newton step is one pass over them that returns gradients and Hessians, summed by
tasks, then by ``SUMMERS`` tasks, so the driver gets a fixed number of them.  What a document was taught follows from the views of the rounds so far, so no state is kept.
Scoring reads all documents whole, in one pass, with the two weight vectors.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written
from .shingles import slices, word_hashes

MAX_LABELLED = 8192
ROUNDS = 4
STEPS = 40
CONFIDENT = 0.95
#: Most that a taught document weighs, and all taught ones of a side together for each labelled one of it.
TAUGHT_WEIGHT = 0.5
SUMMERS = 8
BUCKETS = 64
DAMPING = 4.0
SOURCES = 64
LANGUAGES = 16

_CLASSES = np.full(256, 7, dtype=np.uint8)  # 7: bytes of characters beyond ASCII
_CLASSES[:128] = 6  # controls
_CLASSES[33:127] = 5  # symbols
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"-?()")):
    _CLASSES[list(_chars)] = _i
TEXT_FEATURES = 8 + 9 + BUCKETS
META_FEATURES = SOURCES + LANGUAGES + 4


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of features for each text; null is empty."""
    out = np.zeros((len(texts), TEXT_FEATURES))
    for first, data, bounds in slices(texts):
        k = len(bounds) - 1
        size = np.diff(bounds)
        rows = np.repeat(np.arange(k), size)
        classes = np.bincount(rows * 8 + _CLASSES[data], minlength=8 * k).reshape(k, 8)
        share = classes / np.maximum(size, 1)[:, None]
        words, starts = word_hashes(data, bounds)
        n = np.diff(starts)
        of = np.repeat(np.arange(k), n)
        order = np.lexsort((words, of))
        w, t = words[order], of[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
        distinct = np.bincount(t[new], minlength=k)
        runs = np.diff(np.append(np.flatnonzero(new), len(w)))
        most = np.zeros(k)
        np.maximum.at(most, t[new], runs)
        again = np.zeros(k)
        if len(words) > 1:
            np.add.at(again, of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], 1)
        lines = np.zeros((k, 2))
        raw = data.tobytes()
        for i in range(k):
            parts = raw[bounds[i] : bounds[i + 1]].split(b"\n")
            lines[i] = len(parts), len(set(parts))
        m = np.maximum(n, 1)
        rest = [np.log1p(n), size / m, distinct / m, most / m, again / m, 1 - lines[:, 1] / lines[:, 0], lines[:, 0] / m, (distinct / m) * np.log1p(n), (share[:, 5] > 0.02).astype(float)]
        content = np.bincount(of * BUCKETS + (words >> np.uint64(58)).astype(np.int64), minlength=BUCKETS * k).reshape(k, BUCKETS)
        out[first : first + k] = np.column_stack([share, *rest, content / m[:, None]])
    return out


def meta_codes(source: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashed source and language, 0 for null."""

    def places(values: list, size: int) -> np.ndarray:
        return np.array([zlib.crc32(v.encode()) % (size - 1) + 1 if v is not None else 0 for v in values], dtype=np.int32)

    return places(source, SOURCES), places(lang, LANGUAGES)


def meta_matrix(source: np.ndarray, lang: np.ndarray, n_chars: list) -> np.ndarray:
    k = len(source)
    out = np.zeros((k, META_FEATURES))
    out[np.arange(k), source] = 1
    out[np.arange(k), SOURCES + lang] = 1
    none = np.array([n is None for n in n_chars], dtype=bool)
    length = np.log1p(np.array([max(0, n) if n is not None else 0 for n in n_chars], dtype=float))
    out[:, SOURCES + LANGUAGES :] = np.column_stack([none, length, length**2 / 10, length < 5])
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language (with a place for null), and the stated length."""
    return meta_matrix(*meta_codes(source, lang), n_chars)


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a ridge, halved where the loss would rise."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, scaling: tuple[np.ndarray, np.ndarray] | None = None):
        if scaling is None:
            scaling = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        (self.mean, self.scale), self.ridge = scaling, ridge
        self.w, self.loss = np.zeros(x.shape[1] + 1), np.inf
        z = self.z(x)
        for _ in range(STEPS if len(x) else 0):
            if self.step(*self.sums(z, y)) < 1e-6:
                break

    def z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), z])

    def sums(self, z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian over some rows."""
        o = z @ self.w
        p = _sigmoid(o)
        return float((np.logaddexp(0, o) - y * o).sum()), z.T @ (p - y), (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z

    def step(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> float:
        """Go on from the sums over all rows at ``w``; returns how far it went."""
        loss += self.ridge / 2 * float(self.w @ self.w)
        if loss > self.loss + 1e-9 * abs(loss):
            self.d = self.d / 2
        else:
            self.at, self.loss = self.w, loss
            self.d = np.linalg.solve(hessian + self.ridge * np.eye(len(self.w)), gradient + self.ridge * self.w)
        self.w = self.at - self.d
        return float(np.abs(self.d).max())

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.z(x) @ self.w, -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrained:
    """The two views with their calibrations; ``taught`` counts the labels each received."""

    def __init__(self, views: list[Logistic], calibrations: list[Logistic], prior: float, taught: list[int]):
        self.views, self.calibrations, self.prior, self.taught = views, calibrations, prior, taught

    def scores(self, *features: np.ndarray) -> list[np.ndarray]:
        """Probabilities of good quality by text, by metadata, and by both."""
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, features, strict=True)]
        return [*map(_sigmoid, odds), _sigmoid(odds[0] + odds[1] - self.prior)]


def lessons(history: list[list[np.ndarray]], z: list[np.ndarray]) -> list[np.ndarray]:
    """What each view has been taught about documents: 0, 1, or NaN for nothing.

    ``history`` has both views' weights of each round; the first sure verdict of the other view stands.
    """
    out = []
    for v in (0, 1):
        label = np.full(len(z[v]), np.nan)
        for weights in history:
            p = _sigmoid(z[1 - v] @ weights[1 - v])
            sure = np.isnan(label) & (np.maximum(p, 1 - p) >= CONFIDENT)
            label[sure] = p[sure] > 0.5
        out.append(label)
    return out


def taught_sums(history: list[list[np.ndarray]], views: list[Logistic], x: list[np.ndarray]) -> list[np.ndarray]:
    """For each view and each side (bad, good): rows taught, loss, gradient and Hessian, as one vector."""
    z = [view.z(part) for view, part in zip(views, x, strict=True)]
    out = []
    for view, part, label in zip(views, z, lessons(history, z), strict=True):
        for side in (0, 1):
            rows = part[label == side]
            loss, g, h = view.sums(rows, np.full(len(rows), float(side)))
            out.append(np.concatenate([[len(rows), loss], g, h.ravel()]))
    return out


def moments(x: list[np.ndarray]) -> list[np.ndarray]:
    """For each view: rows, sums and sums of squares of the features, as one vector."""
    return [np.concatenate([[len(part)], part.sum(axis=0), (part**2).sum(axis=0)]) for part in x]


def co_train(x: list[np.ndarray], y: np.ndarray, pool: Callable, rounds: int = ROUNDS, damped: tuple[int, int] = (0, 0)) -> CoTrained:
    """Fit on two views of labelled documents and of a pool of unlabelled ones.

    ``pool(f)`` is the sum of ``f([text features, metadata features])`` over parts of the pool.
    Every fourth labelled document is kept for calibration.  The last ``damped`` features of a
    view are scaled down by ``DAMPING``: a ridge of its square, as for many weak features.
    """
    apart = np.arange(len(y)) % 4 == 3
    train, prior, share = ~apart, 0.0, 0.5
    if len(y):
        share = float(y.mean())
        p = np.clip(share, 0.01, 0.99)
        prior = float(np.log(p / (1 - p)))
    seen, labels = [x[v][train] for v in (0, 1)], y[train]
    scaling: list = [None, None]
    if len(y):
        for v, total in enumerate(a + b for a, b in zip(moments(seen), pool(moments), strict=True)):
            mean, square = total[1:].reshape(2, -1) / total[0]
            scaling[v] = mean, np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-6)
            scaling[v][1][len(mean) - damped[v] :] *= DAMPING
    views = [Logistic(seen[v], labels, scaling=scaling[v]) for v in (0, 1)]
    z = [views[v].z(seen[v]) for v in (0, 1)]
    history, taught = [], [0, 0]
    for _ in range(rounds if len(y) else 0):
        history.append([view.w for view in views])
        for view in views:
            view.loss = np.inf  # of other rows than before
        for _ in range(STEPS):
            parts, far = pool(lambda part: taught_sums(history, views, part)), 0.0
            for v in (0, 1):
                sums = np.concatenate([part.ravel() for part in map(np.asarray, views[v].sums(z[v], labels))])
                for side, of_labels in ((0, 1 - share), (1, share)):  # in the proportion of the labels
                    n, more = parts[2 * v + side][0], parts[2 * v + side][1:]
                    sums = sums + TAUGHT_WEIGHT * min(1.0, len(labels) * of_labels / max(1.0, n)) * more
                taught[v] = int(parts[2 * v][0] + parts[2 * v + 1][0])
                k = len(views[v].w)
                far = max(far, views[v].step(sums[0], sums[1 : k + 1], sums[k + 1 :].reshape(k, k)))
            if far < 1e-6:
                break
    at = apart if apart.any() else train
    calibrations = [Logistic(views[v].odds(x[v][at])[:, None], y[at], ridge=0.1) for v in (0, 1)]
    return CoTrained(views, calibrations, prior, taught)


def _views(batch) -> list[np.ndarray]:
    """Both views' features from rows of t, s, l, n."""
    t = np.frombuffer(b"".join(batch.column("t").to_pylist()), dtype=float).reshape(-1, TEXT_FEATURES)
    return [t, meta_matrix(batch.column("s").to_numpy(), batch.column("l").to_numpy(), batch.column("n").to_pylist())]


def _pool_sums(rows: DataFrame) -> Callable:
    """Sums over written rows of features, a job for each; a task hands on fixed-size sums."""

    def pool(f: Callable) -> list[np.ndarray]:
        def summed(parts):
            total = None
            for part in parts:
                total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

        first = rows.mapInArrow(lambda batches: summed(f(_views(b)) for b in batches), "sums binary")
        second = first.repartition(SUMMERS).mapInArrow(lambda batches: summed(pickle.loads(x) for b in batches for x in b.column(0).to_pylist()), "sums binary")
        total = f([np.zeros((0, TEXT_FEATURES)), np.zeros((0, META_FEATURES))])
        for sums in second.toArrow().column("sums").to_pylist():
            total = [x + y for x, y in zip(total, pickle.loads(sums), strict=True)]
        return total

    return pool


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    """Fit on a bounded sample of ``labels`` (doc_id, quality) and on all other documents.

    Rows with a null id or quality are not used; a document with several labels has their majority,
    and of rows that share a labelled id one is fitted on.  Rows without an id are unlabelled.
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    some = written(named.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(max_labelled), "quality-labels")
    base = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang")], F.col("n_chars").cast("long"), F.col("text").cast("string"))
    labelled = base.join(F.broadcast(some), "doc_id").select(*base.columns, "y")
    unlabelled = base.join(F.broadcast(some), "doc_id", "left_anti").select("*", F.lit(None).cast("double").alias("y"))

    def features(batches):
        for b in batches:
            t, (s, l) = text_features(b.column(4)), meta_codes(b.column(1).to_pylist(), b.column(2).to_pylist())  # noqa: E741
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "y": b.column(5), "t": pa.array([r.tobytes() for r in t], pa.binary()), "s": pa.array(s), "l": pa.array(l), "n": b.column(3)})

    schema = "doc_id long, y double, t binary, s int, l int, n long"
    one = F.min(F.struct("t", "s", "l", "n", "y")).alias("one")
    rows = labelled.mapInArrow(features, schema).groupBy("doc_id").agg(one).select("doc_id", "one.*").toArrow().sort_by("doc_id")
    y = np.array(rows.column("y").to_pylist(), dtype=float)
    order = np.random.default_rng(5).permutation(len(y))
    x = [v[order] for v in _views(rows)]
    if not len(y):
        return co_train(x, y, lambda f: f(x))
    pool = written(unlabelled.mapInArrow(features, schema).select("t", "s", "l", "n"), "quality-pool")
    model = co_train(x, y[order], _pool_sums(pool), damped=(BUCKETS, 0))
    dropped(pool)
    dropped(some)
    return model


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """One row per input row: doc_id, text_score, meta_score, score (0 to 1), good.

    Null texts and metadata are scored as such: empty text, and places of their own for null
    source, language and length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            t, m = text_features(b.column(4)), meta_features(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            s = sent.value.scores(t, m)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.round(v, 9)) for v in s], pa.array(s[2] >= 0.5)], names=["doc_id", "text_score", "meta_score", "score", "good"])

    base = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang")], F.col("n_chars").cast("long"), F.col("text").cast("string"))
    return base.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, good boolean")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model fitted on the given labels.

    Without usable labels every score is 0.5; an empty table gives an empty result.
    """
    return score(docs, fit(docs, labels))
