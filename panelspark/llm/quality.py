"""Quality classifier by co-training.

Two views of a document: its content (which words and separators occur) and
its metadata (source, language, length and layout: shares of capitals,
symbols and digits, line and word lengths, repetition).  Each view has a
logistic regression.  Over a few rounds each labels the unlabelled documents
that it is surest of, for the other to learn from.  The two are then
calibrated and combined on held-out labelled rows, and all documents are
scored in one pass.

Two targets are learnt this way, low quality and toxicity; a document is
rejected if either is more likely than not.

Training takes at most ``labelled_rows`` labelled and ``pool_rows``
unlabelled documents (lowest id hashes); scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.frames import col, prepare
from panelspark.llm.kernels import ALNUM, Words, mix, slices, text_buffers

LABELLED_ROWS = 6000
POOL_ROWS = 3000
ROUNDS = 3
CONTENT_DIMS = 1 << 18
META_DIMS = 1 << 12
HEADS = (4, 6)       # word beginnings (bytes) that are features besides whole words
SURE = 0.97          # probability from which a pseudo-label is passed on
EXCHANGE = 200       # pseudo-labels per class, view and round at most
THRESHOLD = 0.5
META_COLUMNS = ("source", "lang")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = ~ALNUM & ~_SPACE


def _unique_pairs(row: np.ndarray, hashes: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) with feature = hash modulo dims, ordered by row."""
    pair = np.unique(row.astype(np.int64) * dims + (hashes % np.uint64(dims)).astype(np.int64))
    return pair // dims, pair % dims


def content_features(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words, their heads, and separators that occur, and whether a word follows itself, as (row, feature)."""
    gaps = Words(data, offsets, ~ALNUM)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    heads = [words.heads(k) for k in HEADS]
    rows = np.concatenate([words.text, gaps.text, words.text[same], *[t for _, t in heads]])
    marks = np.concatenate([words.hash, mix(gaps.hash + np.uint64(1)), np.full(int(same.sum()), 3, np.uint64),
                            *[h for h, _ in heads]])
    return _unique_pairs(rows, marks, CONTENT_DIMS)


def meta_features(data: np.ndarray, offsets: np.ndarray, words: Words, columns: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Source, language, length and layout in steps, as (row, feature)."""
    n = words.n_texts
    lo = int(offsets[0])
    raw = data[lo:int(offsets[-1])]
    at = (offsets - lo).astype(np.int64)
    length = np.diff(at)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask[raw], out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    size = np.maximum(length, 1)
    n_words = np.maximum(words.count, 1)
    row, _ = _unique_pairs(words.text, words.hash, 1 << 24)
    distinct = np.bincount(row, minlength=n)
    lines = count(np.arange(256) == 10) + 1
    steps = {
        "length": np.log2(size + 1), "words": np.log2(n_words),
        "upper": 12 * count(_UPPER) / size, "symbol": 20 * count(_SYMBOL) / size, "digit": 20 * count(_DIGIT) / size,
        "wordlen": 2 * (words.end - words.start).sum() / n_words if n == 0 else
                   np.minimum(2 * np.bincount(words.text, weights=words.end - words.start, minlength=n) / n_words, 40),
        "distinct": 10 * distinct / n_words, "lines": np.log2(lines), "linelen": np.log2(size / lines + 1),
        "bars": 20 * count(np.arange(256) == 124) / size,
    }
    rows, marks = [], []
    for k, (name, value) in enumerate(steps.items()):
        rows.append(np.arange(n))
        marks.append(mix(np.floor(value).astype(np.uint64) * np.uint64(64) + np.uint64(k + 1)))
    for k, (name, values) in enumerate(sorted(columns.items())):
        rows.append(np.arange(n))
        w = Words(*text_buffers(pa.array([f"{name}={v}" for v in values], pa.large_string())), np.ones(256, bool))
        marks.append(mix(w.hash + np.uint64(k)))
    return _unique_pairs(np.concatenate(rows), np.concatenate(marks), META_DIMS)


class View:
    """Logistic regression over sets of features, trained by full-batch Adagrad.

    A feature's value is the size of its log count ratio between the classes,
    so that rare telling words outweigh the many common ones.
    """

    def __init__(self, dims: int, l2: float):
        self.w, self.b, self.l2 = np.zeros(dims, np.float64), 0.0, l2
        self.value = np.ones(dims, np.float64)

    @staticmethod
    def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=n)

    def logit(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return self._sums((self.w * self.value)[feature], row, n) + self.b

    def fit(self, row: np.ndarray, feature: np.ndarray, y: np.ndarray, steps: int, rate: float = 0.15) -> None:
        n = len(y)
        if not n:
            return
        hot = np.bincount(feature, weights=y[row], minlength=len(self.w))
        cold = np.bincount(feature, minlength=len(self.w)) - hot
        self.value = np.abs(np.log((hot + 0.5) / (y.sum() + 1)) - np.log((cold + 0.5) / ((1 - y).sum() + 1)))
        self.value[(hot + cold < 3) | (self.value < 0.5)] = 0.0
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5
        # only features with a value can change: work on those, renumbered
        used = np.flatnonzero(self.value)
        slot = np.zeros(len(self.w), np.int64)
        slot[used] = np.arange(len(used))
        live = self.value[feature] > 0
        row, feature = row[live], slot[feature[live]]
        w, value = self.w[used], self.value[used]
        g_w, g_b = np.full(len(used), 1e-8), 1e-8
        for _ in range(steps):
            z = self._sums((w * value)[feature], row, n) + self.b
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            d = weight * (p - y) / n
            grad = value * np.bincount(feature, weights=d[row], minlength=len(w)) + self.l2 * w / n
            g_w += grad * grad
            w -= rate * grad / np.sqrt(g_w)
            db = d.sum()
            g_b += db * db
            self.b -= rate * db / np.sqrt(g_b)
        self.w[used] = w


def _take(view: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows, renumbered."""
    row, feature = view
    first = np.searchsorted(row, rows)
    count = np.searchsorted(row, rows, side="right") - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return np.repeat(np.arange(len(rows)), count), feature[at]


class CoTrained:
    """Two views of one target and their calibrated combination."""

    def __init__(self):
        self.views = (View(CONTENT_DIMS, 1.0), View(META_DIMS, 1.0))
        self.mixer = np.array([0.0, 0.0, -30.0])   # untrained: never the target

    def train(self, data: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = ROUNDS) -> None:
        """``y``: 1, 0 or -1 (unlabelled) for each row of the two views."""
        known = np.flatnonzero(y >= 0)
        if len(np.unique(y[known])) < 2:
            if len(known) and y[known[0]] == 1:
                self.mixer = np.array([0.0, 0.0, 30.0])
            return
        held, learn = known[::5], np.setdiff1d(known, known[::5])
        if len(np.unique(y[held])) < 2 or len(np.unique(y[learn])) < 2:
            held = learn = known
        pool = np.flatnonzero(y < 0)
        own = [(learn, y[learn].astype(float)) for _ in self.views]
        for r in range(rounds):
            for view, (rows, target), x in zip(self.views, own, data):
                view.fit(*_take(x, rows), target, steps=120 if r == 0 else 40)
            if r == rounds - 1 or not len(pool):
                continue
            given = np.zeros(len(y), bool)
            for v, (view, x) in enumerate(zip(self.views, data)):
                p = 1 / (1 + np.exp(-np.clip(view.logit(*_take(x, pool), len(pool)), -30, 30)))
                sure = []
                for label, q in ((1.0, p), (0.0, 1 - p)):
                    best = np.argsort(-q, kind="stable")[:EXCHANGE]
                    sure += [(i, label) for i in pool[best[q[best] >= SURE]]]
                if sure:
                    ids = np.array([i for i, _ in sure])
                    given[ids] = True
                    rows, target = own[1 - v]
                    own[1 - v] = (np.concatenate([rows, ids]), np.concatenate([target, [t for _, t in sure]]))
            pool = pool[~given[pool]]
        z = self._logits([_take(x, held) for x in data], len(held))
        m = View(3, 0.1)
        for _ in range(400):   # the mixer: calibration of both views at once, on held-out labels
            p = 1 / (1 + np.exp(-np.clip(z @ m.w, -30, 30)))
            m.w -= 0.5 * (z.T @ (p - y[held])) / len(held)
            m.w[:2] = np.maximum(m.w[:2], 0.0)
        self.mixer = m.w

    def _logits(self, data, n: int) -> np.ndarray:
        z = [np.clip(v.logit(*x, n), -8, 8) for v, x in zip(self.views, data)]
        return np.stack([*z, np.ones(n)], 1)

    def probability(self, data, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(data, n) @ self.mixer, -30, 30)))


def _views(data: np.ndarray, offsets: np.ndarray, columns: dict[str, list]):
    words = Words(data, offsets, ALNUM)
    return content_features(data, offsets, words), meta_features(data, offsets, words, columns)


def train_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label_key: str = "doc_id",
                  quality: str = "quality", toxic: str = "toxic", labelled_rows: int = LABELLED_ROWS,
                  pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> dict[str, CoTrained]:
    """The two co-trained targets, ``bad`` (quality 0) and ``toxic``."""
    prepare(docs.sparkSession)
    meta = [c for c in META_COLUMNS if c in docs.columns]
    marks = (labels.filter(col(label_key).isNotNull()).groupBy(col(label_key).alias("k"))
             .agg(F.max(1 - col(quality).cast("int")).alias("bad"), F.max(col(toxic).cast("int")).alias("tox")))
    place = F.xxhash64("k")
    marks = marks.orderBy(place, "k").limit(labelled_rows)
    spare = (docs.select(col(key).alias("k")).filter(F.col("k").isNotNull())
             .orderBy(place, "k").limit(pool_rows).distinct())
    # both sides are bounded by their row limits
    wanted = marks.join(spare.withColumn("pool", F.lit(1)), "k", "full").select("k", "bad", "tox")
    rows = (docs.select(col(key).alias("k"), col(text).cast("string").alias("t"), *[col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta)])
            .join(F.broadcast(wanted), "k"))

    def extract(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            for i, j in slices(offsets):
                columns = {c: b.column(2 + m).slice(i, j - i).to_pylist() for m, c in enumerate(meta)}
                c, m = _views(data, offsets[i:j + 1], columns)
                split = [np.split(f.astype(np.int32), np.searchsorted(r, np.arange(1, j - i))) for r, f in (c, m)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in split[0]], pa.binary()), pa.array([x.tobytes() for x in split[1]], pa.binary()),
                     b.column(0).slice(i, j - i).cast(pa.string()),
                     *[b.column(2 + len(meta) + q).slice(i, j - i) for q in range(2)]], names=["c", "m", "k", "bad", "tox"])

    schema = T.StructType([T.StructField("c", T.BinaryType()), T.StructField("m", T.BinaryType()), T.StructField("k", T.StringType()),
                           T.StructField("bad", T.IntegerType()), T.StructField("tox", T.IntegerType())])
    got = sorted(rows.mapInArrow(extract, schema).collect(), key=lambda r: (r["k"], r["c"]))
    data = []
    for name in ("c", "m"):
        parts = [np.frombuffer(r[name], np.int32) for r in got]
        data.append((np.repeat(np.arange(len(got)), [len(p) for p in parts]),
                     np.concatenate(parts) if parts else np.zeros(0, np.int32)))
    models = {}
    for name, column in (("bad", "bad"), ("toxic", "tox")):
        y = np.array([-1 if r[column] is None else min(max(r[column], 0), 1) for r in got], dtype=np.int64)
        models[name] = CoTrained()
        models[name].train(data, y, rounds)
    return models


def _score(models, data, offsets, columns, threshold):
    views = _views(data, offsets, columns)
    n = len(offsets) - 1
    bad, toxic = (models[k].probability(views, n) for k in ("bad", "toxic"))
    return bad, toxic, (bad < threshold) & (toxic < threshold)


def _over_batches(docs: DataFrame, labels: DataFrame, text: str, threshold: float, train: dict):
    prepare(docs.sparkSession)
    models = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, text, **train))
    meta = [c for c in META_COLUMNS if c in docs.columns]

    def score(column: pa.Array, columns: dict[str, pa.Array]):
        data, offsets = text_buffers(column)
        parts = [_score(models.value, data, offsets[i:j + 1],
                        {c: v.slice(i, j - i).to_pylist() for c, v in columns.items()}, threshold) for i, j in slices(offsets)]
        return [np.concatenate(x) if parts else np.zeros(0) for x in zip(*parts)] if parts else [np.zeros(0)] * 3
    return meta, score


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                  threshold: float = THRESHOLD, **train) -> DataFrame:
    """Per document row: its key, ``p_bad``, ``p_toxic``, ``score`` (chance of being good) and ``keep``.

    Null and empty texts have no content features and are judged by their
    metadata; null metadata is a value of its own, missing metadata columns
    are left out.  Repeated rows score alike.  Several labels of one key
    count as the worst of them; labels without a document are unused; with
    no labels, or labels of one kind only, the target is constant.
    """
    meta, score = _over_batches(docs, labels, text, threshold, {"key": key, **train})

    def run(batches):
        for b in batches:
            bad, toxic, keep = score(b.column(1), {c: b.column(2 + i) for i, c in enumerate(meta)})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(bad, pa.float64()), pa.array(toxic, pa.float64()),
                 pa.array((1 - bad) * (1 - toxic), pa.float64()), pa.array(keep.astype(bool), pa.bool_())],
                names=[key, "p_bad", "p_toxic", "score", "keep"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T.DoubleType()) for c in ("p_bad", "p_toxic", "score")],
                           T.StructField("keep", T.BooleanType())])
    return docs.select(col(key), col(text).cast("string"), *[col(c).cast("string") for c in meta]).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
              threshold: float = THRESHOLD, **train) -> DataFrame:
    """The documents (all columns) that the classifier does not reject."""
    meta, score = _over_batches(docs, labels, text, threshold, {"key": key, **train})
    at = docs.columns.index(text)
    at_meta = [docs.columns.index(c) for c in meta]

    def run(batches):
        for b in batches:
            keep = score(b.column(at), {c: b.column(i).cast(pa.string()) for c, i in zip(meta, at_meta)})[2]
            yield b.filter(pa.array(keep.astype(bool), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
