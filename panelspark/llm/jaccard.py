"""N-gram Jaccard join by T-occurrence search (DivideSkip), with components of the links.

A document's set is its distinct word shingles.  A partner of a set with n
shingles must share at least T = ceil(threshold * n) of them, that is, occur
on T of its n inverted lists.  DivideSkip divides the lists: the longest are
set aside, the short ones are merged and the occurrences counted, and only
what occurs often enough there is probed, by binary search, against the rest.

* List lengths are estimated for all shingles by a count sketch of fixed
  size.  It only orders the lists, the same way for every document, so an
  estimate that is off costs time, never a link.
* Each set puts its ``n - T + c`` shortest lists into the inverted index;
  two sets that reach T share at least ``c`` of them (``c`` = ``SHORT_HITS``,
  fewer for tiny sets).
* Equal sets are one class with one set; classes carry the multiplicity.
* Long lists of near copies are not expanded into pairs at once.  First every
  class on a long list is probed against one class of it only, the one with
  the fewest shingles of its own, and classes found alike become one
  component.  What is still apart is then joined list by list across
  components, counted, bounded and probed, so that no link between different
  components is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.frames import col, cut_lineage, forget, prepare
from panelspark.llm.graph import components
from panelspark.llm.kernels import NOT_SPACE, Words, mix, slices, text_buffers, whole_gram
from panelspark.session import sized_broadcast

WORDS, PERCENT = 5, 80
SHORT_HITS = 8
JOIN_HITS = 4             # of these, asked for by the last join
SKETCH_BITS = 22
CHUNK = 1 << 16
STAR_ROUNDS = 1
PRUNE_ROUNDS = 2
LONG_LIST = 16            # lists with more classes are collapsed by representatives first


def doc_shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each text of a slice: its distinct shingle hashes, sorted."""
    w = Words(data, offsets, NOT_SPACE)
    grams, ok = w.grams(k)
    text, grams = w.text[ok], grams[ok]
    cut = np.searchsorted(text, np.arange(w.n_texts + 1))
    for t in range(w.n_texts):
        n = int(w.count[t])
        if n >= k:
            yield np.unique(grams[cut[t]:cut[t + 1]])
        elif n:
            lo = int(w.first[t])
            yield np.array([whole_gram(w.hash[lo:lo + n])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        a, b = s.sum(dtype=np.uint64), mix(s + np.uint64(len(s))).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _vector_sum(parts: DataFrame, slots: int) -> np.ndarray:
    """Sum of vectors given as chunks (chunk, salt, counts): streamed sums in two steps, result of fixed size."""
    schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("salt", T.IntegerType()),
                           T.StructField("counts", T.BinaryType())])

    def add(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(2)):
                part = np.frombuffer(zlib.decompress(v.as_buffer()), np.uint32).astype(np.uint64)
                have[c] = have[c] + part if c in have else part
        for c, v in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([0], pa.int32()),
                                              pa.array([zlib.compress(np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())],
                                             names=["chunk", "salt", "counts"])

    once = parts.repartition("chunk", "salt").mapInArrow(add, schema)
    rows = once.repartition("chunk").mapInArrow(add, schema).collect()
    total = np.zeros(slots, np.uint32)
    for r in rows:
        total[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return total


def _chunks(total: np.ndarray, salt: int):
    for c in range(0, len(total), CHUNK):
        part = total[c:c + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([salt], pa.int32()),
                                              pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "salt", "counts"])


_CHUNK_SCHEMA = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("salt", T.IntegerType()),
                              T.StructField("counts", T.BinaryType())])


def list_lengths(docs: DataFrame, text: str, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often shingles occur, by the upper ``bits`` of their hash: 2**bits counts over all documents."""
    slots = 1 << bits

    def count(batches):
        total = np.zeros(slots, np.uint32)
        seen = 0
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for i, j in slices(offsets):
                w = Words(data, offsets[i:j + 1], NOT_SPACE)
                grams, ok = w.grams(k)
                total += np.bincount((grams[ok] >> np.uint64(64 - bits)).astype(np.int64), minlength=slots).astype(np.uint32)
                seen += int(ok.sum())
        yield from _chunks(total, seen % 61)

    return _vector_sum(docs.select(col(text).cast("string").alias("t")).mapInArrow(count, _CHUNK_SCHEMA), slots)


def _slots_in_use(ids: DataFrame, bits: int) -> np.ndarray:
    """2**bits flags: which slots the (64-bit) ids fall into."""
    slots = 1 << bits

    def count(batches):
        total, seen = np.zeros(slots, np.uint32), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
            total[(x >> np.uint64(64 - bits)).astype(np.int64)] = 1
            seen += len(x)
        yield from _chunks(total, seen % 61)

    return _vector_sum(ids.mapInArrow(count, _CHUNK_SCHEMA), slots) > 0


def _sets(docs: DataFrame, key: str, text: str, k: int, percent: int, level) -> DataFrame:
    """Per row: key, hash of its text, set size, set digest, its short lists' tokens (shortest first, packed)."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("th", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
                           T.StructField("short", T.BinaryType())])
    bits = SKETCH_BITS

    def run(batches):
        order = level.value
        for b in batches:
            data, offsets = text_buffers(b.column(2))
            n, d1, d2, short = [], [], [], []
            for i, j in slices(offsets):
                for s in doc_shingles(data, offsets[i:j + 1], k):
                    a, c = digest(s)
                    n.append(len(s))
                    d1.append(a)
                    d2.append(c)
                    if not len(s):
                        short.append(b"")
                        continue
                    least = -(-percent * len(s) // 100)
                    rank = order[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
                    token = np.sort((rank << np.uint64(56)) | (s & np.uint64((1 << 56) - 1)))
                    short.append(token[:len(s) - least + min(SHORT_HITS, least)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(short, pa.binary())], names=["key", "th", "n", "d1", "d2", "short"])

    t = col(text).cast("string")
    return docs.select(col(key).alias("key"), F.xxhash64(t).alias("th"), t.alias("t")).mapInArrow(run, schema)


def _postings(classes: DataFrame) -> DataFrame:
    """(token, cid, n, at): the inverted index of the short lists; at: the token's place in its class's set."""
    names = ["token", "cid", "n", "at"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                tokens = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(2)]
                lens = [len(t) for t in tokens]
                cid, n = (np.repeat(part.column(i).to_numpy(), lens) for i in (0, 1))
                at = np.concatenate([np.arange(m) for m in lens])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
                    np.concatenate(tokens), cid, n, at)], names=names)

    return classes.select("cid", "n", "short").mapInArrow(run, schema)


def _full_sets(docs: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(cid, n, shingles) of the wanted classes (cid, d1, d2); shingles packed and sorted.

    The texts are not shuffled: a bitmap of fixed size, made from the wanted
    digests, lets a scan drop most other documents; the join decides.
    """
    bits = SKETCH_BITS
    wanted = cut_lineage(wanted, "jaccard-wanted")
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(_slots_in_use(wanted.select("d1"), bits)))
    schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
                           T.StructField("set", T.BinaryType())])

    def run(batches):
        use = flags.value
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for i, j in slices(offsets):
                out = []
                for s in doc_shingles(data, offsets[i:j + 1], k):
                    if len(s):
                        d1, d2 = digest(s)
                        slot = (d1 & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                        if use[slot >> 3] >> (7 - (slot & 7)) & 1:
                            out.append((d1, d2, s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                                                      pa.array([x[2] for x in out], pa.binary())], names=["d1", "d2", "set"])

    found = docs.select(col(text).cast("string").alias("t")).mapInArrow(run, schema)
    return cut_lineage(found.join(wanted, ["d1", "d2"]).groupBy("cid").agg(F.first("set").alias("set")), "jaccard-full")


def probe(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets: binary search of the smaller in the larger."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                keep = []
                for x, y in zip(part.column(2), part.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = probe(x, y)
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b")
    both = left.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, schema)


def _can_pair(lists: DataFrame, percent: int) -> DataFrame:
    """Without the classes that cannot reach any partner.

    The first ``c`` tokens that two linked sets share are on the short lists
    of both (``c`` = SHORT_HITS, T if that is smaller), so each stands on a
    list that is still here.  The c-th cannot come before the class's c-th
    such token, which bounds what it shares: ``most`` = c and all after that.
    """
    c = F.least(F.lit(SHORT_HITS), F.ceil(F.col("n1") * percent / 100)).cast("int")
    # a class's places: no more than one document's short tokens
    own = (lists.groupBy("cid").agg(F.first("n").alias("n1"), F.sort_array(F.collect_list("at")).alias("places"))
           .filter(F.size("places") >= c).withColumn("most", F.col("n1") - 1 - F.element_at("places", c) + c)
           .filter(F.col("most") * 100 >= F.col("n1") * percent).select("cid", "most"))
    return lists.drop("most").join(own, "cid")


def _prune(lists: DataFrame, percent: int) -> DataFrame:
    """Without the classes that cannot reach any partner, and the lists that are then left with one class."""
    left = _can_pair(lists, percent)
    return cut_lineage(left.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("m > 1").drop("m"), "jaccard-lists")


def _open(per: DataFrame) -> DataFrame:
    """The lists on which classes of several components are, each with its largest component as ``main``.

    Of equally large ones the one that has the class with the fewest tokens
    of its own: nearest to what copies have in common.
    """
    sizes = per.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("n") - F.col("most")).alias("odd"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("m", -F.col("odd"), F.xxhash64("comp"), "comp")).alias("main"),
                                      F.sum("m").alias("all"), F.max("m").alias("top")).filter(F.col("all") > F.col("top"))
    return per.join(main, "token")


def _can_reach(na, ma, nb, mb, percent: int):
    """Whether two sets of which at most ma and mb shingles can be shared may reach the threshold."""
    both = F.least(ma, mb)
    return both * 100 >= (na + nb - both) * percent


def _merge(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more links: (cid, comp) with the linked components joined."""
    look = lambda c: comp.select(F.col("cid").alias(c), F.col("comp").alias(f"c{c}"))
    linked = (edges.join(look("a"), "a").join(look("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
              .filter("a <> b").distinct())
    new = components(linked)
    return cut_lineage(comp.join(new, comp["comp"] == new["node"], "left")
                       .select("cid", F.coalesce(new["comp"], comp["comp"]).alias("comp")), "jaccard-comp")


def link_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS,
                 percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, classes): every row's (key, th, n, d1, d2), and every distinct set's (d1, d2, root, comp_root).

    ``root`` is the smallest key of the class, ``comp_root`` that of its component.
    """
    spark = docs.sparkSession
    prepare(spark)
    counts = list_lengths(docs, text, k)
    level = spark.sparkContext.broadcast(np.minimum(4 * np.log2(counts + 1.0), 127).astype(np.uint8))
    found = cut_lineage(_sets(docs, key, text, k, percent, level), "jaccard-sets")
    members = cut_lineage(found.drop("short"), "jaccard-members")
    classes = cut_lineage(
        found.filter("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("root"), F.first("n").alias("n"), F.first("short").alias("short"))
        .withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    forget(found)
    # lists of one class lead nowhere; sets too small for any unequal partner put none into the index
    least = 1
    while 100 * least < percent * (least + 1):
        least += 1
    lists = cut_lineage(_postings(classes.filter(F.col("n") >= least)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token")))
                        .filter("m > 1").drop("m"), "jaccard-lists")
    postings = classes
    classes = cut_lineage(classes.drop("short"), "jaccard-classes")   # the short lists are in the index now
    forget(postings)
    for _ in range(PRUNE_ROUNDS):
        old, lists = lists, _prune(lists, percent)
        forget(old)
    comp = cut_lineage(lists.select("cid").distinct().select("cid", F.col("cid").alias("comp")), "jaccard-comp")
    sets = None
    for turn in range(STAR_ROUNDS + 1 if lists.limit(1).count() else 0):
        # what each list's members belong to by now, and the largest component on it
        per = cut_lineage(_open(lists.join(comp, "cid")), "jaccard-open")
        last = turn == STAR_ROUNDS
        if last:
            # tokens that only a class's own component has lead nowhere
            for _ in range(PRUNE_ROUNDS):
                old, per = per, cut_lineage(_open(_can_pair(per.drop("main", "all", "top"), percent)), "jaccard-open")
                forget(old)
            # merge the short lists across components: count on how many a pair occurs
            side = lambda q: ["token", *[F.col(c).alias(d + q) for c, d in
                                         (("cid", ""), ("n", "n"), ("most", "m"), ("comp", "c"), ("at", "t"))]]
            x = per.filter(F.col("comp") != F.col("main")).select(*side("a"))
            y = per.select(*side("b"), "main")
            hits = F.least(F.lit(JOIN_HITS), F.ceil(F.col("na") * percent / 100), F.ceil(F.col("nb") * percent / 100))
            # two sets that share T share hits of their first n - T + hits lists already
            need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
            early = (F.col("ta") < F.col("na") - need + hits) & (F.col("tb") < F.col("nb") - need + hits)
            pairs = (x.join(y, "token").filter((F.col("ca") != F.col("cb")) & early & _can_reach(F.col("na"), F.col("ma"), F.col("nb"), F.col("mb"), percent)
                                               & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))))
                     .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                     .agg(F.count(F.lit(1)).alias("m"), F.first(hits).alias("least"))
                     .filter(F.col("m") >= F.col("least")).select("a", "b"))
        else:
            # on long lists: one class of the largest component; first the one with the fewest tokens of its own
            # (nearest to what its copies have in common), then another one each round
            odd = F.col("n") - F.col("most") if turn == 0 else F.lit(0)
            long = per.filter(F.col("all") > LONG_LIST)
            if sets is None:
                sets = _full_sets(docs, text, k, classes.join(long.select("cid").distinct(), "cid").select("cid", "d1", "d2"))
            pivot = (long.filter(F.col("comp") == F.col("main")).groupBy("token")
                     .agg(F.min_by(F.struct("cid", "n", "most"), F.struct(odd, F.xxhash64("cid", F.lit(turn)), "cid")).alias("q")))
            pairs = (long.filter(F.col("comp") != F.col("main")).join(pivot, "token")
                     .filter(_can_reach(F.col("n"), F.col("most"), F.col("q.n"), F.col("q.most"), percent))
                     .select(F.col("q.cid").alias("a"), F.col("cid").alias("b")).distinct())
        pairs = cut_lineage(pairs, "jaccard-pairs")
        forget(per)
        if last:
            if sets is not None:
                forget(sets)
            named = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
            sets = _full_sets(docs, text, k, classes.join(named, "cid").select("cid", "d1", "d2"))
        comp = _merge(comp, cut_lineage(_verify(pairs, sets, percent), "jaccard-links"))
        if last:
            break
    named = classes.join(comp, "cid", "left").select("d1", "d2", "root", F.coalesce("comp", "cid").alias("comp"))
    roots = named.groupBy("comp").agg(F.min("root").alias("comp_root"))
    return members, named.join(roots, "comp").select("d1", "d2", "root", "comp_root")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """Per document row: its key, ``n_shingles`` and ``component_id``.

    Documents link when 100 * |A and B| >= percent * |A or B| over their sets
    of ``k``-word shingles (words: runs of characters other than space and
    \\t..\\r, A-Z lower-cased; fewer words than ``k`` are one shingle).
    ``component_id`` is the smallest key reachable by links, itself included.

    Null and empty texts have an empty set and link with nothing.  Repeated
    rows each get their row and are linked; a null key is no candidate for a
    component's id unless all its keys are null.  An empty table gives an
    empty result; other columns are not read.
    """
    members, classes = link_classes(docs, text, key, k, percent)
    out = members.select("key", "n", "d1", "d2").join(classes.select("d1", "d2", "comp_root"), ["d1", "d2"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("comp_root")).otherwise(F.col("key")).alias("component_id"))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS,
                     percent: int = PERCENT) -> DataFrame:
    """The documents (all columns), one of each component: the one with the smallest key.

    Documents without words stay.  The keys to drop are broadcast only if
    their size is proven small, else joined by a shuffle.
    """
    members, classes = link_classes(docs, text, key, k, percent)
    rows = members.filter("n > 0").join(classes.select("d1", "d2", "comp_root"), ["d1", "d2"])
    first = F.row_number().over(Window.partitionBy("key", "comp_root").orderBy("th"))
    # one row of a key is kept per component: that of the component's smallest key
    marked = cut_lineage(rows.select("key", "th", "comp_root", (F.col("key").eqNullSafe(F.col("comp_root")) & (first == 1)).alias("keep"))
                         .groupBy("key", "th").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("m")), "jaccard-keep")
    own = docs.withColumn("__th", F.xxhash64(col(text).cast("string")))

    def without(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = sized_broadcast(keys.select(F.col("key").alias("__k"), F.col("th").alias("__t")))
        return df.join(keys, col(key).eqNullSafe(F.col("__k")) & (F.col("__th") == F.col("__t")), how)

    out = without(own, cut_lineage(marked.filter(~F.col("keep") | (F.col("m") > 1)), "jaccard-drop"), "left_anti")
    twice = cut_lineage(marked.filter(F.col("keep") & (F.col("m") > 1)), "jaccard-twice")
    if twice.limit(1).count():   # equal rows of which one stays
        out = out.unionByName(without(own, twice, "left_semi").dropDuplicates([key, "__th"]))
    return out.select(*[col(c) for c in docs.columns])
