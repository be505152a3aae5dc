"""Spelling variants of words: pairs one edit apart, found by a trie frontier.

The trie of all words is a distributed edge table.  A node is the 64-bit hash
of a prefix.  The edges are of power-of-two lengths: from a node with ``rem``
code points of some word still to come, an edge reads the largest power of two
of them.  A state is (word, position, node, edits): for every word and every
place i there is one state that stands at the node of the first i code points
and has one edit to spend there.

* Spawning: the state reads the first edge behind its edit.  Edges that start
  at its node delete the code point of the word; edges that skip one code
  point of the trie first (``_edges(skip=True)``) replace it.  An insertion is
  a deletion seen from the other word.
* Levels: the frontier is joined with the edges of one length after the
  other, from long to short; a state that finds no edge ends.
* A state with nothing left to read stands at the end of a word: a neighbour.

A word of L code points has L states and 2 L + 1 edges, whatever the other
words are, and a state finds at most one node per letter of the alphabet, so
no level lists the pairs of a group.  Hashes lead to candidates only; a pair
counts if the two words are one edit apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.frames import col, cut_lineage, prepare
from panelspark.llm.kernels import BASE, BASE_INV, BYTE_CODE, _power_table, mix

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REM = np.uint64(0xD6E8FEB86659FD93)


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 7, least_count: int = 2,
                slip_every: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters, one in ``slip_every`` (by a hash of key and run) with a letter left out.

    Only A-Z are lower-cased.  Null texts have no words; a null key counts as
    empty text in the hash.  Runs are counted per task before the shuffle.
    """
    run = F.explode(F.regexp_extract_all(col(text).cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    x = docs.select(F.coalesce(col(key).cast("string"), F.lit("")).alias("k"), run.alias("run"))
    x = x.select("k", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat("k", F.lit(":"), "run").cast("binary"))
    x = x.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.expr("substring(run, 1, cast(h % char_length(run) as int))"),
                    F.expr("substring(run, cast(h % char_length(run) as int) + 2)"))
    word = F.when((F.col("h") % slip_every == 0) & at.isNotNull(), less).otherwise(F.col("run"))
    return (x.select(word.alias("word")).filter(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count))


class _Spans:
    """Hashes of code point ranges of many words (all letters are below U+0100, one byte each)."""

    def __init__(self, words: list[str]):
        self.raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        n = len(self.raw)
        with np.errstate(over="ignore"):
            self.acc = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODE[self.raw] * _power_table(BASE, n), out=self.acc[1:])
        self.inverse = _power_table(BASE_INV, n + 1)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.acc[b] - self.acc[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def places(self, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start of the word, place) for every place of every word, ``more`` places past the end."""
        per = self.length + more
        word = np.repeat(np.arange(len(per)), per)
        start = self.first[word]
        return word, start, start + np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)

    def edge(self, at: np.ndarray, rem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label, length) of the edge that is read at ``at`` with ``rem`` to come; the label knows ``rem``."""
        step = np.zeros(len(rem), np.int64)
        some = rem > 0
        step[some] = np.int64(1) << np.floor(np.log2(rem[some])).astype(np.int64)
        with np.errstate(over="ignore"):
            return mix(self.hash(at, at + step) + rem.astype(np.uint64) * _REM), step


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _word_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = _Spans(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([_long(s.hash(s.first[:-1], s.first[1:])), b.column(0), b.column(1)], names=["id", "word", "n"])


def _edges(skip: bool):
    """(node, label, next, step) of every place of every word; with ``skip`` the edge starts one code point later."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _Spans(b.column(0).to_pylist())
            word, start, at = s.places(0 if skip else 1)
            read = at + skip
            label, step = s.edge(read, s.first[1:][word] - read)
            new = s.hash(start, read + step)
            yield pa.RecordBatch.from_arrays([_long(s.hash(start, at)), _long(label), _long(new), pa.array(step)],
                                             names=["node", "label", "next", "step"])
    return run


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, label, own, deletes, rest, steps) of every place of every word.

    ``own``: where the word itself goes; ``deletes``: false where the next
    letter is the same, whose deletion gives the same word; ``rest`` and
    ``steps``: labels and lengths of the edges still to be read.
    """
    for b in batches:
        s = _Spans(b.column(0).to_pylist())
        word, start, at = s.places()
        end = s.first[1:][word]
        label, step = s.edge(at + 1, end - at - 1)
        last = at + 1 == end
        after = s.raw[np.where(last, at, at + 1)]
        cursor, rows, labels, steps = at + 1 + step, [], [], []
        todo = np.flatnonzero(cursor < end)
        while len(todo):
            more, by = s.edge(cursor[todo], (end - cursor)[todo])
            rows.append(todo)
            labels.append(more)
            steps.append(by)
            cursor[todo] += by
            todo = todo[cursor[todo] < end[todo]]
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (
            _long(np.concatenate(labels)[order] if rows else np.zeros(0, np.uint64)),
            pa.array(np.concatenate(steps)[order] if rows else np.zeros(0, np.int64)))]
        yield pa.RecordBatch.from_arrays(
            [_long(s.hash(s.first[:-1], s.first[1:])[word]), _long(s.hash(start, at)), _long(label),
             _long(s.hash(start, at + 1 + step)), pa.array(last | (s.raw[at] != after)), *lists],
            names=["id", "node", "label", "own", "deletes", "rest", "steps"])


def near_words(words: DataFrame) -> DataFrame:
    """(id, word, n, other, other_n): every word of (word, n) with each word one edit away, both ways round.

    ``words`` holds each word once, letters up to U+00FF.  An empty table
    gives an empty result.
    """
    spark = words.sparkSession
    prepare(spark)
    words = words.select("word", "n")
    edge = "node long, label long, next long, step long"
    key = F.xxhash64("node", "label").alias("key")
    plain, skip = words.mapInArrow(_edges(False), edge), words.mapInArrow(_edges(True), edge)
    both = (plain.select(key, "next", F.lit(True).alias("drop")).unionByName(skip.select(key, "next", F.lit(False).alias("drop")))
            .repartition("key").distinct())
    states = words.mapInArrow(_states, "id long, node long, label long, own long, deletes boolean, rest array<long>, steps array<long>")
    spawned = (states.select(key, "id", "own", "deletes", "rest", "steps").join(both, "key")
               .filter(F.when(F.col("drop"), F.col("deletes")).otherwise(F.col("next") != F.col("own")))
               .select("id", F.col("next").alias("node"), "rest", "steps"))
    frontier = cut_lineage(spawned, "spelling-frontier")
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    ends = [frontier.filter(F.size("steps") == 0).select("id", "node")]
    frontier = frontier.filter(F.size("steps") > 0)
    step = 1 << max(0, longest.bit_length() - 1)
    while step:
        now = F.get("steps", F.lit(0)) == step
        level = plain.filter(F.col("step") == step).select(key, "next").repartition("key").distinct()
        moved = (frontier.filter(now).select(F.xxhash64("node", F.get("rest", F.lit(0))).alias("key"), "id", "rest", "steps")
                 .join(level, "key").select("id", F.col("next").alias("node"), F.expr("slice(rest, 2, size(rest))").alias("rest"),
                                            F.expr("slice(steps, 2, size(steps))").alias("steps")))
        # states of shorter edges wait in the same table
        done = cut_lineage(moved.unionByName(frontier.filter(~now)), "spelling-frontier")
        ends.append(done.filter(F.size("steps") == 0).select("id", "node"))
        frontier = done.filter(F.size("steps") > 0)
        step >>= 1
    pairs = ends[0]
    for e in ends[1:]:
        pairs = pairs.unionByName(e)
    named = cut_lineage(words.mapInArrow(_word_ids, "id long, word string, n long"), "spelling-words")
    a, b = named.toDF("id", "word", "n"), named.toDF("node", "other", "other_n")
    found = pairs.join(a, "id").join(b, "node").filter(F.levenshtein("word", "other", 1) == 1)
    one = F.struct(F.col("id"), F.col("word"), F.col("n"), F.col("other"), F.col("other_n"))
    back = F.struct(F.col("node").alias("id"), F.col("other").alias("word"), F.col("other_n").alias("n"),
                    F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.select(F.inline(F.when(F.char_length("other") < F.char_length("word"), F.array(one, back)).otherwise(F.array(one))))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of the forms, by doubling; forms never lead back."""
    cur = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not cur.filter("moved").isEmpty():
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        cur = cut_lineage(cur.drop("moved").join(on, "root", "left")
                          .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")),
                          "spelling-roots")
    return cur.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from (word, n).

    The form is the near word of largest n (ties: the first by code point) if
    its n is at least ``ratio`` times the word's, else null.  The root is
    reached by following forms; a word without a form is its own root.  An
    empty table gives an empty result.
    """
    words = cut_lineage(words.select("word", "n"), "spelling-counts")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = (near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b"))
            .select(F.col("word").alias("_w"), "n_near", F.col("_b.form").alias("_form"), (-F.col("_b.m")).alias("_form_n")))
    takes = F.col("_form_n") >= F.col("n") * ratio
    out = cut_lineage(words.join(near, F.col("word") == F.col("_w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("_form")).alias("form"),
        F.when(takes, F.col("_form_n")).alias("form_n")), "spelling-forms")
    roots = follow_forms(out.filter(F.col("form").isNotNull())).withColumnRenamed("word", "_w")
    return (out.join(roots, F.col("word") == F.col("_w"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The words of ``docs`` with their near words counted and their forms and roots named.

    Null texts have no words, an empty table gives an empty result, repeated
    rows count as often as they stand, extra columns are not read.  Runs of
    any length are words; a long run has as many states as code points.
    """
    prepare(docs.sparkSession)
    return group_variants(count_words(docs, text, key))
