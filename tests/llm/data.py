"""Small made-up inputs with the awkward cases: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

ROWS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words long, `key` string"


def texts(n=60, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    para = lambda k: " ".join(word() for _ in range(k))
    shared = para(70)
    out = [None, "", "   ", "one", "two words", "The Cat"]
    for _ in range(n):
        out.append(para(rng.choice([3, 20, 60, 120])))
    base = para(150).split()
    for i in range(12):   # near copies
        w = list(base)
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [para(30) + "\n" + shared + " " + para(20) for _ in range(6)]
    out += ["na " * 400, "ab" * 700, "é€😀 " * 90, para(9000)]
    out += out[6:12] + [out[-1]]   # exact copies
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["a", "b", "é", None]
    data = [(i, t, "en", sources[0 if i % 3 else i % 4], len(t or ""), "x", 1, "k") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, ROWS).repartition(5)
