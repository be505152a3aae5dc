"""Benchmark decontamination by winnowing.

Both sides are fingerprinted: of every ``window - k + 1`` consecutive
``k``-word hashes the minimum is kept.  Two texts that share ``window``
words share the ``k``-grams of that stretch, hence its minimum, so joining
the fingerprints misses no shared stretch.  Each hit is then extended: the
windows around it are compared as a whole, and only whole windows count.

Items with fewer words than a window are one window of their own length
(winnowing with a run of one: every gram of that length is looked up).

The benchmark is read in blocks of at most ``block_bytes`` of text; each
block's index is built once and broadcast, its size therefore being bounded
whatever the number of blocks.  Documents are scanned once, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.frames import col, field, filter_texts, map_texts
from panelspark.llm.kernels import ALNUM, Words, slices, text_buffers, whole_gram, winnow

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 4 << 20

FIELDS = [field("n_words", "long"), field("n_hit", "long"), field("n_items", "long"),
          field("items_sha256", "string"), field("contaminated", "boolean"), field("items", "string[]")]


class _Lookup:
    """Sorted window hashes and, for each, the items that hold it."""

    def __init__(self, hashes: list[np.ndarray], owners: list[np.ndarray]):
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        self.owner = o
        self.hash, self.first = np.unique(h, return_index=True)
        self.first = np.append(self.first, len(h))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def owners(self, index: int) -> np.ndarray:
        return self.owner[self.first[index]:self.first[index + 1]]


class BenchmarkIndex:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, ids: Sequence, texts: Sequence[str | None], window: int, k: int):
        self.ids = [None if i is None else str(i) for i in ids]
        long_h, long_o, fps, short = [], [], [], {}
        data, offsets = text_buffers(pa.array(list(texts), pa.large_string()))
        for a, b in slices(offsets):
            w = Words(data, offsets[a:b + 1], ALNUM)
            grams, ok = w.grams(window)
            small, small_ok = w.grams(k)
            long_h.append(grams[ok])
            long_o.append(w.text[ok] + a)
            for t in range(b - a):
                lo, n = int(w.first[t]), int(w.count[t])
                if n >= window:
                    part = small[lo:lo + n - k + 1]
                    fps.append(part[winnow(part, window - k + 1)])
                elif n:
                    hs, os_ = short.setdefault(n, ([], []))
                    hs.append(np.array([whole_gram(w.hash[lo:lo + n])]))
                    os_.append(np.array([a + t]))
        self.long = _Lookup(long_h, long_o)
        self.fingerprints = np.unique(np.concatenate(fps)) if fps else np.zeros(0, np.uint64)
        self.short = {n: _Lookup(*v) for n, v in sorted(short.items())}

    def hits(self, w: Words, window: int, k: int):
        """(first word, length, lookup, index) of every place where a window occurs."""
        if len(self.fingerprints) and len(w.hash) >= window:
            grams, ok = w.grams(k)
            grams = np.where(ok, grams, np.uint64(0xFFFFFFFFFFFFFFFF))
            kept = winnow(grams, window - k + 1)
            at = np.minimum(np.searchsorted(self.fingerprints, grams[kept]), len(self.fingerprints) - 1)
            seeds = kept[self.fingerprints[at] == grams[kept]]
            if len(seeds):
                around = np.unique((seeds[:, None] - np.arange(window - k + 1)[None, :]).ravel())
                around = around[around >= 0]
                whole, whole_ok = w.grams(window)
                around = around[whole_ok[around]]
                found = self.long.find(whole[around])
                yield around[found >= 0], window, self.long, found[found >= 0]
        for n, lookup in self.short.items():
            grams, ok = w.grams(n)
            at = np.flatnonzero(ok)
            found = lookup.find(grams[at])
            yield at[found >= 0], n, lookup, found[found >= 0]


def _scanner(blocks: list, window: int, k: int):
    def scan(column: pa.Array) -> dict[str, pa.Array]:
        data, offsets = text_buffers(column)
        n_words, n_hit, items = [], [], []
        for a, b in slices(offsets):
            w = Words(data, offsets[a:b + 1], ALNUM)
            edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
            found: dict[int, set[str]] = {}
            for block in blocks:
                index = block.value
                for first, n, lookup, which in index.hits(w, window, k):
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n, -1)
                    if len(first):
                        for t, i in np.unique(np.stack([w.text[first], which], 1), axis=0):
                            found.setdefault(int(t), set()).update(
                                index.ids[o] for o in lookup.owners(int(i)) if index.ids[o] is not None)
            hit = np.cumsum(edge[:-1]) > 0
            n_words.append(w.count)
            n_hit.append(np.bincount(w.text[hit], minlength=b - a))
            items += [sorted(found.get(t, ())) for t in range(b - a)]
        words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        hits = np.concatenate(n_hit) if n_hit else np.zeros(0, np.int64)
        return {"n_words": pa.array(words, pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                "contaminated": pa.array(hits > 0, pa.bool_()), "items": pa.array(items, pa.list_(pa.string()))}
    return scan


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
                     k: int = GRAM, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark's index as broadcast blocks of bounded size."""
    src = benchmark.select(col(item_id).alias("id"), col(text).cast("string").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    src = src.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    out = []
    for i in range(n):
        part = src.filter(F.col("block") == i).select("id", "text").toArrow()
        index = BenchmarkIndex(part["id"].to_pylist(), part["text"].to_pylist(), window, k)
        out.append(benchmark.sparkSession.sparkContext.broadcast(index))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row with its overlap with the benchmark.

    A word of a document is hit when it lies inside an occurrence of
    ``window`` consecutive words of an item (or of a whole shorter item).
    ``items`` are the ids of the items with an occurring window, sorted as
    strings; items with a null id count for the hits but are not listed.

    Null and empty texts have no words and are clean.  Repeated rows each get
    their own row; items with the same id count once.  An empty benchmark
    leaves every document clean.  Columns outside ``keep`` are not read.
    """
    blocks = benchmark_blocks(benchmark, item_id, item_text, window, k, block_bytes)
    return map_texts(docs, _scanner(blocks, window, k), FIELDS, text, keep)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, k: int = GRAM,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents (all columns) that share no window with the benchmark."""
    blocks = benchmark_blocks(benchmark, item_id, item_text, window, k, block_bytes)
    return filter_texts(docs, _scanner(blocks, window, k), "contaminated", text)
