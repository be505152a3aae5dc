"""Exact substring dedup with suffix arrays by induced sorting.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else.  Each such string holds an anchor: winnowing keeps the least
``GRAM``-byte hash of every string, so equal strings hold equal anchors at
equal places.  Anchors that occur once are dropped; an occurrence whose whole
surroundings (all strings that can hold the anchor) occur again is decided by
that.  The others are grouped by anchor and cut by the anchor's place in the
string into ranges.  All strings of a range share a core of bytes; only rows
with equal cores stay together, and rows alike over a whole range are decided
by that.  The groups that are left are dealt to shards, the core written as a
short token, and each shard's suffix array is built by induced sorting:
suffixes are classified as smaller or larger than their successor, the
leftmost-smaller substrings are sorted by one induction, named and ranked
recursively, and a second induction, linear in the shard, orders all suffixes.
Strings are repeated where the permuted common prefix of neighbours reaches
their (shortened) length and the neighbours lie at different places.

A group with very many distinct surroundings is cut in halves again, as often
as needed, so that no group grows with the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.frames import col, cut_lineage, field, prepare
from panelspark.llm.kernels import BASE, BASE_INV, BYTE_CODE, _power_table, byte_grams, mix, text_buffers, winnow

LENGTH = 200
GRAM = 40
SHARD_BYTES = 1 << 19
MOST_IN_GROUP = 4000      # distinct surroundings of one group; larger groups are split
PIECES = 4                # ranges into which the windows that hold an anchor are cut first
TOKEN = 8                 # bytes that stand for a group's core: numbers up to 7 ** 7 groups in a shard


# ---- suffix array of one shard -------------------------------------------------------------------------------------

def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last is)."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))   # next minus own
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.where(nxt < n - 1, step[np.minimum(nxt, n - 2)] > 0, False)
    return small


def _deal(items: np.ndarray, keys: np.ndarray, buckets: list[list[np.ndarray]], but: int) -> np.ndarray:
    """Append items to their key's bucket, in order; those of key ``but`` are returned as well."""
    order = np.argsort(keys, kind="stable")
    items, keys = items[order], keys[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    own = items[:0]
    for part, k in zip(np.split(items, cuts), keys[np.concatenate([[0], cuts])] if len(keys) else ()):
        buckets[k].append(part)
        if k == but:
            own = part
    return own


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes, given the leftmost-smaller ones in their order."""
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    less: list[list[np.ndarray]] = [[] for _ in range(size)]
    keys = s[lms]
    cuts = np.searchsorted(keys, np.arange(size + 1)) if len(keys) and (np.diff(keys.astype(np.int32)) >= 0).all() else None
    seeds = [lms[cuts[c]:cuts[c + 1]] for c in range(size)] if cuts is not None else [lms[keys == c] for c in range(size)]

    def back(block: np.ndarray, want_small: bool) -> tuple[np.ndarray, np.ndarray]:
        prev = block[block > 0] - 1
        prev = prev[small[prev] == want_small]
        return prev, s[prev]

    for c in range(size):
        block = np.concatenate(large[c]) if large[c] else lms[:0]
        large[c] = [block]
        while len(block):   # runs of one symbol extend their own bucket
            block = _deal(*back(block, False), large, c)
        _deal(*back(seeds[c], False), large, -1)
    for c in range(size - 1, -1, -1):
        block = np.concatenate(less[c]) if less[c] else lms[:0]
        less[c] = [block]
        while len(block):
            block = _deal(*back(block, True), less, c)
        whole = np.concatenate(large[c]) if large[c] else lms[:0]
        large[c] = [whole]
        _deal(*back(whole[::-1], True), less, -1)
    parts = [np.array([len(s) - 1], lms.dtype)]   # the end, smaller than all; nothing induces it
    for c in range(1, size):
        parts += [*large[c], np.concatenate(less[c])[::-1] if less[c] else lms[:0]]
    return np.concatenate(parts)


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of symbols 1..255 (uint8) by induced sorting; the end is smallest.

    With ``depth`` suffixes that agree on their first ``depth`` symbols may
    stand in any order.
    """
    if not len(s):
        return np.zeros(0, np.int64)
    s = np.append(s, np.uint8(0))
    n, size = len(s), int(s.max()) + 1
    small = _classify(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)
    if len(lms) > 1:
        # first induction: leftmost-smaller substrings in order
        by_symbol = lms[np.argsort(s[lms], kind="stable")]
        first = _induce(s, small, by_symbol, size)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = first[is_lms[first]]
        # names: equal substrings (up to and with the next leftmost-smaller suffix) get one name
        end = np.append(lms[1:], n - 1) + 1
        with np.errstate(over="ignore"):
            acc = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODE[s] * _power_table(BASE, n), out=acc[1:])
            h = mix((acc[end] - acc[lms]) * _power_table(BASE_INV, n + 1)[lms] + (end - lms).astype(np.uint64))
        number = np.zeros(n, np.int64)
        number[lms] = np.arange(len(lms))
        place = number[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = h[place[1:]] != h[place[:-1]]
        rank = np.zeros(len(lms), np.int64)
        rank[place] = np.cumsum(fresh)
        # recursion: rank by twice as many names each time, until all differ or the depth is reached
        k = 1
        while int(rank.max()) < len(lms) and (depth is None or k < depth):
            ahead = np.zeros(len(lms), np.int64)
            ahead[:-k] = rank[k:] if k < len(lms) else 0
            key = rank * (len(lms) + 1) + ahead
            order = np.argsort(key)
            ordered = key[order]
            up = np.ones(len(order), np.int64)
            up[1:] = ordered[1:] != ordered[:-1]
            rank[order] = np.cumsum(up)
            k *= 2
        lms = lms[np.argsort(rank, kind="stable")]
    return _induce(s, small, lms, size)[1:]


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, exact: bool = True) -> np.ndarray:
    """For each suffix (by place) the length shared with its predecessor in ``sa``, up to ``most``.

    Found by doubling steps over hashes; not ``exact``: ``most`` where it is reached, else 0.
    """
    n = len(s)
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[s] * _power_table(BASE, n), out=acc[1:])
        inverse = _power_table(BASE_INV, n + 1)
        a, b = sa[1:], sa[:-1]
        have = np.zeros(len(a), np.int64)
        steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)] if exact else [most]
        for step in steps:
            i, j = a + have, b + have
            fits = (np.maximum(i, j) + step <= n) & (have + step <= most)
            x, y = np.minimum(i, n), np.minimum(j, n)
            xe, ye = np.minimum(x + step, n), np.minimum(y + step, n)
            same = fits & ((acc[xe] - acc[x]) * inverse[x] == (acc[ye] - acc[y]) * inverse[y])
            have += np.where(same, step, 0)
    plcp[sa[1:]] = have
    return plcp


def repeated_windows(parts: list[bytes], place: np.ndarray, copies: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                     length: int) -> list[tuple[int, int] | None]:
    """For each part the first and last start of a repeated window among its starts lo..hi, or None.

    ``place``: a hash of where a part begins in its text, so that place + start
    names a window's place; ``copies``: parts that occur several times.
    """
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    whole = np.frombuffer(b"\x00".join(parts), np.uint8)
    # symbols: the bytes in use, numbered from 2; 1 ends a part
    used = np.zeros(256, bool)
    used[whole] = True
    number = np.cumsum(used) + 1
    s = number[whole].astype(np.uint16)
    ends = begin[1:] - 1
    s[ends] = 1
    if s.max() > 255:   # all 256 byte values: leave one out by merging it with its neighbour's code point pair
        s = np.minimum(s, 255)
    s = s.astype(np.uint8)
    sa = suffix_array(s, depth=length)
    plcp = permuted_common_prefixes(s, sa, length, exact=False)
    owner = np.repeat(np.arange(len(parts)), np.append(sizes[:-1] + 1, sizes[-1]))
    start = np.arange(len(s)) - begin[owner]
    # classes of equal windows: runs of neighbours with a common prefix of full length
    joined = plcp[sa] >= length
    joined[0] = False
    run = np.cumsum(~joined) - 1
    inside = (start[sa] >= lo[owner[sa]]) & (start[sa] <= hi[owner[sa]])
    sa, run = sa[inside], run[inside]
    if not len(sa):
        return [None] * len(parts)
    own = owner[sa]
    with np.errstate(over="ignore"):
        where = place[own] + start[sa].astype(np.uint64)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    several = (np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)) | np.logical_or.reduceat(copies[own], first)
    hit = np.repeat(several, np.diff(np.append(first, len(run))))
    out: list[tuple[int, int] | None] = [None] * len(parts)
    own, at = own[hit], start[sa][hit]
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    if len(own):
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        last = np.append(first[1:], len(own)) - 1
        for p, a, b in zip(own[first], at[first], at[last]):
            out[p] = (int(a), int(b))
    return out


# ---- the distributed operator --------------------------------------------------------------------------------------

def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(a, c, t, pos, n): anchor hash, hash of its surroundings, text hash, place, text length; per document row."""
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("a", "c", "t", "pos", "n")])
    reach = length - gram

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            keys = b.column(0).to_numpy()
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for i in range(b.num_rows):
                raw = data[offsets[i]:offsets[i + 1]]
                n = len(raw)
                if n < length:
                    continue
                grams = byte_grams(raw, gram)
                pos = winnow(grams, reach + 1)
                lo, hi = np.maximum(pos - reach, 0), np.minimum(pos + length, n)
                with np.errstate(over="ignore"):
                    acc = np.zeros(n + 1, np.uint64)
                    np.cumsum(BYTE_CODE[raw] * _power_table(BASE, n), out=acc[1:])
                    c = mix((acc[hi] - acc[lo]) * _power_table(BASE_INV, n + 1)[lo]
                            + (pos - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - pos).astype(np.uint64))
                out.append((grams[pos].astype(np.int64), c.astype(np.int64), np.full(len(pos), keys[i]), pos, np.full(len(pos), n)))
                held += len(pos)
                if held > 50_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=schema.names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=schema.names)

    return docs.select("t", "text").mapInArrow(run, schema)


def _parts(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, t, c0, copies, pre, post): the wanted anchors with the bytes before and after that a window can hold."""
    reach = length - gram
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("t", T.LongType()), T.StructField("c0", T.LongType()),
                           T.StructField("copies", T.BooleanType()), T.StructField("pre", T.BinaryType()), T.StructField("post", T.BinaryType())])
    per = wanted.groupBy("t").agg(F.collect_list("a").alias("a"), F.collect_list("pos").alias("pos"), F.collect_list("copies").alias("copies"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                raw = b.column(1)[k].as_py().encode("utf-8", "surrogatepass")
                t, a, pos, copies = (b.column(q)[k].as_py() for q in (0, 2, 3, 4))
                for lo in range(0, len(a), 5000):
                    p = pos[lo:lo + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[lo:lo + 5000], pa.int64()), pa.array([t] * len(p), pa.int64()), pa.array(p, pa.int64()),
                         pa.array(copies[lo:lo + 5000], pa.bool_()), pa.array([raw[max(0, x - reach):x] for x in p], pa.binary()),
                         pa.array([raw[x + gram:x + length] for x in p], pa.binary())], names=schema.names)

    return texts.join(per, "t").select("t", "text", "a", "pos", "copies").mapInArrow(run, schema)


def _narrow(rows: DataFrame, width: int, pieces: int, length: int) -> tuple[DataFrame, int]:
    """Groups dealt anew by the place of the window: (key, t, c0, copies, pre, post, s, e, hit, open, kinds) and the new width.

    The rows of a group share the ``length - width + 1`` bytes from ``c0`` (the core); its windows start 0 to ``width - 1``
    bytes before ``c0``.  These starts are cut into equal ranges.  All windows of a range hold a longer core, so rows whose
    longer cores differ share none.  Rows with equal bytes over a whole range repeat each other there (``hit``; s, e: the
    bytes covered); one of them stays.  Where rows remain that are alike in part only, the group is ``open``.
    """
    step = -(-width // pieces)
    lows = sorted({min(k * step, width - step) for k in range(pieces)})
    low, before, after = F.col("l"), F.length("pre"), F.length("post")
    high, rest = low + step - 1, F.lit(width) - low - step      # rest: bytes after the core that become part of it
    x = rows.withColumn("l", F.explode(F.array(*[F.lit(v) for v in lows])))
    x = x.filter(F.greatest(low, F.lit(width - 1) - after) <= F.least(high, before))
    x = x.select(F.xxhash64("key", "l", F.substring("pre", before - low + 1, low), F.substring("post", F.lit(1), rest)).alias("key"), "t",
                 (F.col("c0") - low).alias("c0"), "copies",
                 F.substring("pre", F.greatest(before - high, F.lit(0)) + 1, F.least(before, high) - low).alias("pre"),
                 F.substring("post", rest + 1, F.least(after - rest, F.lit(step - 1))).alias("post"))
    one, same = Window.partitionBy("key"), Window.partitionBy("key", "whole")
    x = (x.withColumn("whole", F.xxhash64("pre", "post")).repartition("key")
         .withColumn("m", F.sum(F.when(F.col("copies"), 2).otherwise(1)).over(same))
         .withColumn("turn", F.row_number().over(same.orderBy("t", "c0")))
         .withColumn("least", F.min("m").over(one)).withColumn("kinds", F.sum((F.col("turn") == 1).cast("int")).over(one)))
    x = x.withColumn("hit", (F.col("m") > 1) & ~F.col("copies")).withColumn("open", (F.col("turn") == 1) & (F.col("least") == 1) & (F.col("kinds") > 1))
    start = F.col("c0") - F.length("pre")
    end = F.col("c0") - F.greatest(F.lit(step - 1) - F.length("post"), F.lit(0)) + length
    x = x.filter("hit or open").select("key", "t", "c0", (F.col("m") > 1).alias("copies"), *[F.when(F.col("open"), F.col(c)).alias(c) for c in ("pre", "post")],
                                       start.alias("s"), end.alias("e"), "hit", "open", "kinds")
    return cut_lineage(x, "suffix-groups"), step


def _token(group: int) -> bytes:
    """A group's core in short: bytes that no UTF-8 text holds, the first of them nowhere else in the token."""
    return bytes([0xFF, *(0xF8 + group // 7 ** k % 7 for k in range(TOKEN - 1))])


def _shards(groups: DataFrame, length: int) -> DataFrame:
    """(t, s, e): the span of each row that repeated windows cover; rows of a group (key, width) stay together.

    A group's core is the same in all its rows and windows, so that it enters the shard as a token.
    """
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("t", "s", "e")])

    def solve(rows: list[tuple], groups: list[int], width: int):
        t, c0, copies, pre, post = (list(x) for x in zip(*rows))
        before, after = (np.array([len(p) for p in x]) for x in (pre, post))
        begin = np.array(c0) - before
        with np.errstate(over="ignore"):
            place = mix(np.array(t, np.int64).astype(np.uint64)) + begin.astype(np.uint64)
        part = [p + _token(g) + q for p, g, q in zip(pre, groups, post)]
        last = before - np.maximum(width - 1 - after, 0)
        found = repeated_windows(part, place, np.array(copies), np.zeros(len(part), np.int64), last, width - 1 + TOKEN)
        got = [(t[i], int(begin[i] + f[0]), int(begin[i] + f[1] + length)) for i, f in enumerate(found) if f and not copies[i]]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], names=schema.names)

    def run(batches):
        rows: list[tuple] = []
        numbers: list[int] = []
        held, own = 0, None
        for b in batches:
            for width, key, *row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if own is not None and (width != own[0] or key != own[1] and held > SHARD_BYTES):
                    yield from solve(rows, numbers, own[0])
                    rows, numbers, held, own = [], [], 0, None
                numbers.append(numbers[-1] + (key != own[1]) if numbers else 0)
                rows.append(tuple(row))
                own = (width, key)
                held += len(row[3]) + len(row[4]) + TOKEN
        if rows:
            yield from solve(rows, numbers, own[0])

    return (groups.select("width", "key", "t", "c0", "copies", "pre", "post").repartition("key").sortWithinPartitions("width", "key")
            .mapInArrow(run, schema))


def _repeats(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """(t, s, e): spans of the parts that repeated windows cover."""
    rows, width, pieces = parts, length - gram + 1, PIECES
    spans = shards = None
    while True:   # each further round halves the large groups alone; a group of one window each has only equal rows
        x, width = _narrow(rows, width, pieces, length)
        hits = x.filter("hit").select("t", "s", "e")
        ready = x.filter(F.col("open") & (F.col("kinds") <= MOST_IN_GROUP)).withColumn("width", F.lit(width))
        spans = hits if spans is None else spans.unionByName(hits)
        shards = ready if shards is None else shards.unionByName(ready)
        rows, pieces = x.filter(F.col("open") & (F.col("kinds") > MOST_IN_GROUP)), 2
        if not rows.limit(1).count():
            return spans.unionByName(_shards(shards, length))


FIELDS = [field("n_bytes", "long"), field("n_removed", "long"), field("n_spans", "long"), field("kept_sha256", "string")]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document row: its key, bytes, removed bytes and spans, and the digest of the bytes kept.

    Bytes covered by a string of ``length`` bytes that also starts elsewhere
    (in the same or another document; overlaps count) are removed, judged on
    the texts as given; matches never cross documents.

    Null and empty texts have no bytes; texts shorter than ``length`` keep
    all.  Repeated rows are copies of each other and lose all that is at
    least ``length`` long.  Empty tables give empty results; other columns
    are not read.
    """
    prepare(docs.sparkSession)
    words = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(key).alias("key"), F.xxhash64(words).alias("t"), words.alias("text"))
    reach = length - gram
    x = _anchor_rows(rows, length, gram).repartition("a")
    one, same = Window.partitionBy("a"), Window.partitionBy("a", "c")
    x = (x.withColumn("m", F.count(F.lit(1)).over(one)).filter("m > 1")
         .withColumn("mc", F.count(F.lit(1)).over(same)).withColumn("turn", F.row_number().over(same.orderBy("t", "pos")))
         .withColumn("least", F.min("mc").over(one)))
    x = cut_lineage(x.select("a", "t", "pos", "n", "mc", "turn", "least"), "suffix-anchors")
    lo, hi = F.greatest(F.col("pos") - reach, F.lit(0)), F.least(F.col("pos") + length, F.col("n"))
    whole = x.filter("mc > 1").select("t", lo.alias("s"), hi.alias("e")).filter(F.col("e") - F.col("s") >= length)
    wanted = x.filter("turn = 1 and least = 1").select("a", "t", "pos", (F.col("mc") > 1).alias("copies"))
    parts = _parts(rows.select("t", "text").dropDuplicates(["t"]), wanted, length, gram)
    found = _repeats(cut_lineage(parts, "suffix-parts"), length, gram)
    spans = whole.unionByName(found).distinct().groupBy("t").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            out = []
            for i in range(b.num_rows):
                raw = data[offsets[i]:offsets[i + 1]]
                edge = np.zeros(len(raw) + 1, np.int64)
                got = b.column(2)[i].values
                if got is not None and len(got):
                    np.add.at(edge, got.field(0).to_numpy(), 1)
                    np.add.at(edge, got.field(1).to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                                             names=[key, *[f.name for f in FIELDS]])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *FIELDS])
    return rows.join(spans, "t", "left").select("key", "text", "spans").mapInArrow(run, schema)
