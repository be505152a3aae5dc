"""Prefix trie of conversations from vertical bitmaps.

A turn at a position is an item; its posting is the bitset of the
conversations that have it there.  Conversations are sorted by their first
turns and dealt to shards of one Arrow batch, cut into strips of ``BAND``
positions, so that neither a long conversation nor a popular first turn makes
a shard large.  In a shard a depth-first walk carries the bitset of a prefix:
intersected with the postings of the next position it gives the children,
their popcounts and the conversations that end there.  A prefix is known
across shards by the sum of the hashes of its (position, turn) items (128
bits), and the shards' partial nodes are added up.

Sums over subtrees are sums over members.  A node belongs to its smallest
member; going down a path, once a conversation owns a node it owns all below.
So a second walk, told from which depth each conversation owns its nodes,
gives in each shard what a subtree holds there, and these add up too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.frames import col, cut_lineage, prepare

BAND = 64          # positions of a strip
_LOW = np.uint64(0xFFFFFFFF)
_NEVER = 1 << 62


@dataclass
class Trie:
    """``nodes``: a row per node; ``ends``: (node_1, node_2, conv_id) of every conversation at the node where it ends."""
    nodes: DataFrame
    ends: DataFrame


def number_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, role, text_1, text_2, size): turns numbered from 1 by turn, null first.

    Equal turns of a conversation stand in the order of role, then of a hash
    of the text.  Null roles and texts are empty; rows without a
    conversation are left out.  Rows are numbered in key ranges, so a long
    conversation is shared by several tasks.  ``text_1`` and ``text_2`` are
    two hashes of the text, ``size`` its UTF-8 bytes.
    """
    spark = turns.sparkSession
    said = F.coalesce(col(text).cast("string"), F.lit(""))
    x = turns.filter(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv_id"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
        F.xxhash64(said).alias("text_1"), F.xxhash64(F.lit(1), said).alias("text_2"), F.octet_length(said).cast("long").alias("size"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_1"), F.col("text_2")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = cut_lineage(x.repartitionByRange(n, F.col("conv_id"), *order).withColumn("_pid", F.spark_partition_id()), "trie-turns")
    # only the first conversation of a partition can have begun before it
    before = (x.groupBy("conv_id", "_pid").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("_before") > 0).select("conv_id", "_pid", "_before"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy("_pid", "conv_id").orderBy(*order)))
    return (x.join(F.broadcast(before), ["conv_id", "_pid"], "left")   # at most one row per partition
            .select("conv_id", (F.col("_in") + F.coalesce("_before", F.lit(0))).alias("pos"), "role", "text_1", "text_2", "size"))


def graft_heads(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt from numbered turns.

    Conversation c takes the first h turns of conversation c - c % ``every``
    (none if there is no such), then its own turns after its first h; h is
    crc32 of c's decimal, modulo ``most``.  The second table has every
    conversation once, turnless ones too.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    convs = cut_lineage(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", h, base), "trie-convs")
    heads = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("head"))
    plan = convs.join(heads, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("head", F.lit(0))).alias("k"))
    own = (turns.join(plan.select("conv_id", "h", "k"), "conv_id").filter(F.col("pos") > F.col("h"))
           .withColumn("pos", F.col("pos") - F.col("h") + F.col("k")).drop("h", "k"))
    lent = (turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
            .join(plan.select("conv_id", "base", "k"), "base").filter(F.col("pos") <= F.col("k")).drop("base", "k"))
    return own.unionByName(lent), convs.select("conv_id")


def _strips(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and ``BAND`` positions, sorted so that conversations that begin alike are neighbours."""
    spark = turns.sparkSession
    x1, x2 = F.xxhash64("pos", "role", "text_1", "text_2"), F.xxhash64(F.lit(1), "pos", "role", "text_1", "text_2")
    x = turns.select("conv_id", "pos", x1.alias("x1"), x2.alias("x2"), "size", F.floor((F.col("pos") - 1) / BAND).alias("band"))
    half = lambda c: [F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{c}_lo"), F.sum(F.shiftrightunsigned(c, 32)).alias(f"{c}_hi")]
    x = x.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "x1", "x2", "size"))).alias("items"),
                                         *half("x1"), *half("x2"), F.max("pos").alias("end"))
    sums = ["x1_lo", "x1_hi", "x2_lo", "x2_hi"]
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    x = x.select("conv_id", "band", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)).alias(c) for c in sums],
                 F.max("end").over(whole).alias("length"), "items")
    none = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("band"), *[F.lit(0).cast("long").alias(c) for c in sums],
        F.lit(0).cast("long").alias("length"), F.array().cast(x.schema["items"].dataType).alias("items"))
    x = x.withColumn("length", F.col("length").cast("long")).unionByName(none)
    alike = ["band", *sums, *[F.get("items", F.lit(i))["x1"] for i in range(6)], "conv_id"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(x.repartitionByRange(n, *alike).sortWithinPartitions(*alike), "trie-strips")


class _Shard:
    """Postings of one batch of strips and the walk over them."""

    def __init__(self, b: pa.RecordBatch):
        order = np.argsort(b.column("conv_id").to_numpy(), kind="stable")   # the lowest bit is the smallest member
        b = b.take(pa.array(order))
        self.ids = b.column("conv_id").to_pylist()
        self.band = b.column("band").to_numpy()
        items = b.column("items")
        self.offs = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())]).astype(np.int64)
        flat = items.flatten()
        field = lambda n: flat.field(n).to_numpy().view(np.uint64)
        x1, x2 = field("x1"), field("x2")
        self.size = flat.field("size").to_pylist()
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.offs))
        halves = [x1 & _LOW, x1 >> np.uint64(32), x2 & _LOW, x2 >> np.uint64(32)]
        start = [b.column(c).to_numpy().astype(np.uint64) for c in ("x1_lo", "x1_hi", "x2_lo", "x2_hi")]
        with np.errstate(over="ignore"):
            run = [np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)]) for h in halves]
            at = [((r[1:] - r[self.offs[row]] + s[row]) & _LOW) for r, s in zip(run, start)]
        join = lambda lo, hi: ((hi << np.uint64(32)) | lo).view(np.int64).tolist()
        self.p1, self.p2 = join(at[0], at[1]), join(at[2], at[3])
        self.s1, self.s2 = join(start[0], start[1]), join(start[2], start[3])
        self.length = b.column("length").to_numpy()
        # postings by (position, turn); the position is part of the item's hash
        self.item = list(zip(x1.tolist(), x2.tolist()))
        self.post: dict[tuple, int] = {}
        for i, t in zip(row.tolist(), self.item):
            self.post[t] = self.post.get(t, 0) | (1 << i)
        self.batch = b

    def classes(self) -> dict[tuple, int]:
        """Bitsets of the strips that begin at the same node."""
        out: dict[tuple, int] = {}
        for i, k in enumerate(zip(self.band.tolist(), self.s1, self.s2)):
            out[k] = out.get(k, 0) | (1 << i)
        return out

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out

    def walk(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the node above or -1, bitset, depth, item or -1, one row) of every node, the one above first.

        A class of strips that goes on from an earlier band has its first
        node in that band; its children have -1 above them.
        """
        offs, item, post = self.offs.tolist(), self.item, self.post
        ends_at: dict[int, int] = {}
        for i, n in enumerate(np.diff(self.offs).tolist()):
            ends_at[n] = ends_at.get(n, 0) | (1 << i)
        count = 0
        for (band, _, _), bits in self.classes().items():
            above = -1
            if band == 0:
                yield -1, bits, 0, -1, 0
                above, count = count, count + 1
            stack = [(above, bits & ~ends_at.get(0, 0), 0)]
            while stack:
                up, rest, j = stack.pop()
                while rest:
                    i = (rest & -rest).bit_length() - 1
                    at = offs[i] + j
                    child = rest & post[item[at]]
                    rest ^= child
                    yield up, child, band * BAND + j + 1, at, i
                    go_on = child & ~ends_at.get(j + 1, 0)
                    if go_on:
                        stack.append((count, go_on, j + 1))
                    count += 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's partial nodes with popcount, smallest member and the members that end there."""
    for b in batches:
        s = _Shard(b)
        done: dict[int, int] = {}
        for i, n in enumerate(s.length.tolist()):
            done[n] = done.get(n, 0) | (1 << i)
        rows = []
        for _, bits, depth, at, i in s.walk():
            ends = [s.ids[m] for m in s.members(bits & done.get(depth, 0))]
            if at < 0:
                rows.append((0, 0, None, None, 0, s.ids[(bits & -bits).bit_length() - 1], bits.bit_count(), 0, ends))
                continue
            up = (s.p1[at - 1], s.p2[at - 1]) if at > s.offs[i] else (s.s1[i], s.s2[i])
            rows.append((s.p1[at], s.p2[at], *up, depth, s.ids[i], bits.bit_count(), s.size[at], ends))
        names = ["node_1", "node_2", "up_1", "up_2", "depth", "conv_id", "n_convs", "size"]
        columns = list(zip(*rows)) if rows else [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(columns[8], pa.list_(pa.int64()))],
                                         names=[*names, "ends"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's share of every subtree: leaves, and bytes of members that do not own their nodes."""
    for b in batches:
        s = _Shard(b)
        since, leaf, tail = (s.batch.column(c).to_pylist() for c in ("owns_from", "leaf", "tail"))
        leaves = sum(1 << i for i, f in enumerate(leaf) if f)
        owned: dict[int, int] = {}     # depth -> rows that own their node from there on
        for i, d in enumerate(since):
            owned[d] = owned.get(d, 0) | (1 << i)
        steps = sorted(owned)
        upto, have = [], 0
        for d in steps:
            have |= owned[d]
            upto.append(have)
        steps = np.array(steps, np.int64)
        above, keys, n_leaves, saved = [], [], [], []
        for up, bits, depth, at, i in s.walk():
            k = int(np.searchsorted(steps, depth, side="right")) - 1
            mine = k >= 0 and bits & upto[k] != 0
            more = 0
            if at >= 0:
                more = (bits.bit_count() - mine) * s.size[at]
                if depth % BAND == 0:
                    more += sum(tail[m] for m in s.members(bits))
            above.append(up)
            keys.append((s.p1[at], s.p2[at]) if at >= 0 else (0, 0))
            n_leaves.append((bits & leaves).bit_count())
            saved.append(more)
        for i in range(len(above) - 1, -1, -1):
            if above[i] >= 0:
                saved[above[i]] += saved[i]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                          pa.array(n_leaves, pa.int64()), pa.array(saved, pa.int64())],
                                         names=["node_1", "node_2", "n_leaves", "saved_tokens"])


def conversation_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of all conversations: ``turns`` (conv_id, pos, role, text_1, text_2, size), ``convs`` (conv_id), each once.

    ``nodes``: node_1, node_2 (its id), up_1, up_2 (its parent's; null for
    the root), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes below or here), saved_tokens (bytes
    that members share, over the subtree).  Turnless conversations are
    members of the root.  Without conversations there is no node.
    """
    prepare(turns.sparkSession)
    key = ["node_1", "node_2"]
    strips = _strips(turns, convs)
    part = cut_lineage(strips.mapInArrow(_count, "node_1 long, node_2 long, up_1 long, up_2 long, depth long, conv_id long, "
                                                 "n_convs long, size long, ends array<long>"), "trie-parts")
    nodes = part.groupBy(*key).agg(F.min("up_1").alias("up_1"), F.min("up_2").alias("up_2"), F.min("depth").alias("depth"),
                                   F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    nodes = cut_lineage(nodes, "trie-merged")
    kids = nodes.filter(F.col("depth") > 0).groupBy(F.col("up_1").alias("node_1"), F.col("up_2").alias("node_2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(kids, key, "left").fillna(0, ["n_children"]), "trie-nodes")
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.max(F.col("n_children") == 0).alias("leaf"))
    told = strips.join(owners, "conv_id", "left").withColumns({
        "owns_from": F.coalesce("owns_from", F.lit(_NEVER)), "leaf": F.coalesce("leaf", F.lit(False))})
    later = Window.partitionBy("conv_id").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    shared = F.expr("aggregate(items, 0L, (a, i) -> a + if(i.pos < owns_from, i.size, 0L))")
    # the leaf counts once per conversation and node, in the strip that holds the node
    told = told.withColumn("tail", F.coalesce(F.sum(shared).over(later), F.lit(0)))
    alike = ["band", "x1_lo", "x1_hi", "x2_lo", "x2_hi", *[F.get("items", F.lit(i))["x1"] for i in range(6)], "conv_id"]
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = told.repartitionByRange(n, *alike).sortWithinPartitions(*alike)
    sums = (told.mapInArrow(_add_up, "node_1 long, node_2 long, n_leaves long, saved_tokens long").groupBy(*key)
            .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    up = nodes.select(F.col("node_1").alias("up_1"), F.col("node_2").alias("up_2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, key).join(up, ["up_1", "up_2"], "left")
    return Trie(full.select(*key, "up_1", "up_2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"),
                part.select(*key, F.explode("ends").alias("conv_id")))


def node_turns(trie: Trie, turns: DataFrame) -> DataFrame:
    """The nodes but the root, each with its last turn's columns from ``turns`` (conv_id, pos, ...)."""
    return trie.nodes.join(turns.withColumnRenamed("pos", "depth"), ["conv_id", "depth"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = np.stack([b.column(i).to_numpy() for i in (0, 1)], 1)
        ids = b.column(2).to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1 if len(k) else np.zeros(0, np.int64)
        first = np.concatenate([[0], cut]).astype(np.int64) if len(k) else cut
        last = np.append(first[1:], len(k)) if len(k) else cut
        yield pa.RecordBatch.from_arrays([pa.array(k[first, 0]), pa.array(k[first, 1]), pa.array(ids[first]),
                                          pa.array([",".join(map(str, ids[a:z].tolist())) for a, z in zip(first, last)], pa.string())],
                                         names=["node_1", "node_2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_key, sha = None, None
    for b in batches:
        out = []
        for k1, k2, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            if (k1, k2) != open_key:
                if sha:
                    out.append((*open_key, sha.hexdigest()))
                open_key, sha = (k1, k2), hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield _digest_batch(out)
    if sha:
        yield _digest_batch([(*open_key, sha.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())],
                                      names=["node_1", "node_2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node_1, node_2, ends_sha256): SHA-256 of the ascending conv_ids, comma-joined, of every node where one ends.

    The ids are sorted and put in words in key ranges; a digest is fed from
    such pieces one after the other, so a long list is never held whole.
    """
    n = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["node_1", "node_2"]
    pieces = (ends.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInArrow(_joined, "node_1 long, node_2 long, first long, ids string"))
    return (pieces.repartition(*key).sortWithinPartitions(*key, "first")
            .mapInArrow(_digests, "node_1 long, node_2 long, ends_sha256 string"))


def grafted_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per node of the trie of the rebuilt conversations (``graft_heads``), with the digest of its ends.

    Nulls: a null turn comes first, null roles and texts are empty, rows
    without a conversation are left out.  Ties and repeated rows are turns of
    their own.  An empty table gives an empty result.  Extra columns are not
    read.
    """
    prepare(turns.sparkSession)
    numbered = cut_lineage(number_turns(turns, conv, turn, role, text), "trie-numbered")
    trie = conversation_trie(*graft_heads(numbered))
    return (trie.nodes.join(end_digests(trie.ends), ["node_1", "node_2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
