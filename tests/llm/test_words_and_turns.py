"""Conversation trie, language model and spelling variants against brute force, awkward cases included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import lm, prefixes, spelling
from panelspark.llm.seating import Seating
from tests.llm.data import ROWS, documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string, depth string, node_1 string, pos int"


# ---------------------------------------------------------------- conversation trie

def trie_brute(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    built = {c: conv.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9:]
             for c, v in conv.items()}
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "n", 1) for r in rows], TURNS)


def conversations():
    rng, rows = random.Random(4), []
    for c in range(40):   # long ones over several strips, null and tied turns, nulls in role and text
        for t in range(rng.choice([1, 2, 3, 9, 70, 150])):
            if c % 7 == 0:
                rows.append((c, rng.choice([t, t // 2, None]), None, None))
            else:
                rows.append((c, t, rng.choice(["user", None]) if t < 4 else "u", rng.choice(["a", "é", ""]) if t < 99 and c % 3 else "x"))
    rows += [(1000 + 5 * i, t, "u", f"same {t}") for i in range(1200) for t in range(3)]   # a large group of copies
    return rows + [(None, 1, "u", "t"), (2003, 0, "u", "gone"), (7001, None, None, None), (7001, None, None, None)]


def test_trie_equals_brute_force(spark):
    rows = conversations()
    got = prefixes.grafted_trie(turns_frame(spark, rows).repartition(7))
    assert sorted([tuple(r) for r in got.collect()], key=str) == trie_brute(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefixes.grafted_trie(turns_frame(spark, [])).count() == 0
    # 2003 loses its only turn and its base does not exist: the root alone remains
    assert zlib.crc32(b"2003") % 9 > 0
    got = prefixes.grafted_trie(turns_frame(spark, [(2003, 0, "u", "gone")])).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves) for r in got] == [(2003, 0, 1, 0, 1)]
    assert got[0].ends_sha256 == hashlib.sha256(b"2003").hexdigest()


def test_trie_as_an_operator(spark):
    """Real outputs: nodes with their turn, ends; without grafting."""
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yes"), (2, 0, "u", "hi"), (2, 1, "a", "no"), (3, 0, "u", "hi")]
    turns = prefixes.number_turns(turns_frame(spark, rows))
    trie = prefixes.conversation_trie(turns, turns.select("conv_id").distinct())
    nodes = {(r.conv_id, r.depth): r for r in prefixes.node_turns(trie, turns).collect()}
    assert {k: (r.n_convs, r.n_leaves, r.size, r.role) for k, r in nodes.items()} == {
        (1, 1): (3, 2, 2, "u"), (1, 2): (1, 1, 3, "a"), (2, 2): (1, 1, 2, "a")}
    ends = trie.ends.join(trie.nodes.select("node_1", "node_2", "depth"), ["node_1", "node_2"])
    assert sorted((r.conv_id, r.depth) for r in ends.collect()) == [(1, 2), (2, 2), (3, 1)]


def test_digest_of_many_ends_is_fed_in_order(spark):
    ids = list(range(0, 70000, 7))
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(3, 4, 9), (3, 4, 10)], "node_1 long, node_2 long, conv_id long").repartition(5)
    got = {(r.node_1, r.node_2): r.ends_sha256 for r in prefixes.end_digests(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (3, 4): hashlib.sha256(b"9,10").hexdigest()}


# ---------------------------------------------------------------- language model

def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [None]


def test_lm_base_counts_equal_brute_force(spark):
    df = documents(spark).unionByName(documents(spark).filter("doc_id < 9")).unionByName(
        documents(spark, ["of a null key"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = df.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, x in rows:
        w = tokens(x)
        want[i, held(i), len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), 5)] += 1
    got = lm.score_held_out(df).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_empty_tables(spark):
    assert lm.score_held_out(spark.createDataFrame([], ROWS)).count() == 0
    model = lm.train_model(spark.createDataFrame([], ROWS))   # nothing learnt: every token is the one unknown word
    got = lm.score_texts(documents(spark, ["a b", None]), model).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in got} == {(0, 3, 0, 0.0), (1, 1, 0, 0.0)}


def bigram_texts(n, seed):
    """Texts in which the word before says much about the next one."""
    rng = random.Random(seed)
    follow = {f"w{i}": [f"w{(7 * i + j) % 60}" for j in range(4)] for i in range(60)}
    out = []
    for _ in range(n):
        w = f"w{rng.randrange(60)}"
        text = [w]
        for _ in range(rng.randint(20, 60)):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"w{rng.randrange(60)}"
            text.append(w)
        out.append(" ".join(text))
    return out


def test_lm_beats_smoothed_frequencies_on_held_out_texts_and_reruns_agree(spark):
    df = documents(spark, bigram_texts(300, 3))
    rows = lm.score_held_out(df).filter("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    base, model = (10 ** (-sum(getattr(r, f) for r in rows) / n) for f in ("base_score", "score"))
    assert model < 0.35 * base   # some 57 against some 10: the context is used
    again = {r.doc_id: r.score for r in lm.score_held_out(df.repartition(3)).filter("held_out").collect()}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-6) for r in rows)


def test_lm_predictions_add_up_to_one(spark):
    """Over all known words and the unknown one, in the class of a word and at the beginning."""
    texts = bigram_texts(40, 5)
    model = lm.train_model(documents(spark, texts))
    words = sorted({w for t in texts for w in t.split()})
    assert model.totals.words == len(words) + 1
    rows = model.state.collect()
    assert len(rows) == 1 and len(rows[0].kept) == lm.SAMPLES
    part = lm._Model(lm._Part(bytes(rows[0].counts)), model.totals, [bytes(x) for x in rows[0].kept])
    for kind in set(part.part.kind.tolist()) | {5}:
        every = np.append(part.part.words, np.uint64(12345))
        score, count = part.score(every, np.full(len(every), kind, np.uint16))
        assert math.isclose((10 ** score).sum(), 1, rel_tol=1e-6) and count[-1] == 0


def test_seating_has_the_distribution_of_the_restaurant():
    """Tables of one dish after Gibbs moves, against all seatings of six customers."""
    d, new, c = 0.4, 0.7, 6

    def weights(sizes, left, w):   # unnormalised weight of every way to seat the customers one after the other
        if not left:
            yield len(sizes), w
            return
        for i, s in enumerate(sizes):
            yield from weights(sizes[:i] + [s + 1] + sizes[i + 1:], left - 1, w * (s - d))
        yield from weights(sizes + [1], left - 1, w * new)

    exact = Counter()
    for t, w in weights([], c, 1.0):
        exact[t] += w
    total = sum(exact.values())
    n = 4000
    s = Seating(np.arange(n, dtype=np.uint64) * np.uint64(977), np.full(n, c), np.full(n, new), d)
    seen, rounds = Counter(), 40
    for i in range(rounds + 5):
        s.resample(np.full(n, new), c)
        assert s.size.sum() == n * c and (s.size > 0).all() and len(s.size) == s.t.sum()
        if i >= 5:
            seen.update(s.t.tolist())
    for t in exact:
        assert abs(seen[t] / (n * rounds) - exact[t] / total) < 0.01, t


def test_seating_goes_on_from_its_state():
    new = np.full(300, 0.5)
    a = Seating(np.arange(300, dtype=np.uint64), np.arange(300) % 11, new, 0.6)
    a.resample(new, 4)
    b = Seating.resume(a.key, *a.state(), 0.6)
    for s in (a, b):
        s.resample(new, 5)
    assert (a.t == b.t).all() and (a.size == b.size).all() and (a.c == b.c).all()


def test_seating_follows_changing_customers():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 9, 500)
    s = Seating(np.arange(500, dtype=np.uint64), rng.integers(0, 9, 500), np.full(500, 0.5), 0.6)
    s.follow(want, np.full(500, 0.5))
    row = np.repeat(np.arange(500), s.t)
    assert (np.bincount(row, weights=s.size, minlength=500) == want).all() and ((s.t > 0) == (want > 0)).all()


# ---------------------------------------------------------------- spelling variants

def words_brute(rows):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= 2}


def variants_brute(words):
    near, alike = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            alike[w[:i], w[i + 1:]].append(w)
            less = w[:i] + w[i + 1:]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in alike.values():
        for a in group:
            near[a].update(b for b in group if a != b)
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        if best and -best[0] >= 10 * n:
            form[w] = best[1]

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(7, 12))) for _ in range(25)] + ["abababab", "aaaaaaaa", "straßenbahn"]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcÀ") + w[i:], w[:i] + rng.choice("abc") + w[i + 1:]])

    rows = [None, "", "short", "x" * 300 + " " + "x" * 300 + " " + "x" * 301 + " " + "x" * 301]
    for _ in range(250):
        words = [rng.choice(stems[:6]) if rng.random() < 0.7 else rng.choice(stems) for _ in range(12)]
        rows.append(", ".join(slip(w) if rng.random() < 0.2 else w.capitalize() for w in words))
    rows += rows[:40]
    df = documents(spark, rows).unionByName(documents(spark, ["Abababab abababab"]).withColumn("doc_id", F.lit(None).cast("long")))
    words = words_brute([(r.doc_id, r.text) for r in df.collect()])
    got = spelling.spelling_variants(df).collect()
    assert len(got) == len(words) > 60
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants_brute(words)
    assert any(r.form for r in got)


def test_chains_of_forms_and_ties(spark):
    words = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 999), ("caaabbbb", 10000), ("daaabbbb", 10000)]
    got = spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants_brute(dict(words))
    assert {r.word: r.root for r in got}["aaaaaaa"] == "aaaabbb" and {r.word: r.form for r in got}["aaabbbb"] == "caaabbbb"


@pytest.mark.parametrize("rows", [[], [None, "", "a b c"]])
def test_no_words_no_variants(spark, rows):
    df = documents(spark, rows) if rows else spark.createDataFrame([], ROWS)
    assert spelling.spelling_variants(df).count() == 0
