import random
import re

import numpy as np
import pyarrow as pa

from panelspark.llm import kernels as K
from panelspark.llm import suffixes as S
from tests.llm.data import texts


def test_words_and_grams_match_regular_expressions():
    rows = texts()
    data, offsets = K.text_buffers(pa.array(rows))
    for alphabet, pattern in ((K.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (K.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = K.Words(data, offsets, alphabet)
        want = [re.findall(pattern, (t or "").replace("T", "t").replace("C", "c")) for t in rows]
        assert w.count.tolist() == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        assert len(set(flat)) == len(set(w.hash.tolist()))
        grams, ok = w.grams(3)
        want_grams = {tuple(ws[i:i + 3]) for ws in want for i in range(len(ws) - 2)}
        assert len(set(grams[ok].tolist())) == len(want_grams)


def test_winnow_keeps_a_minimum_of_every_run():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 50, 400):
        x = rng.integers(0, 50, n).astype(np.uint64)
        kept = set(K.winnow(x, 7).tolist())
        for i in range(max(0, n - 6)):
            run = x[i:i + 7]
            assert any(i + j in kept for j in range(7) if run[j] == run.min())
        assert kept <= {i for i in range(n) if any(x[i] == x[a:a + 7].min() for a in range(max(0, i - 6), i + 1))}


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for trial in range(40):
        n = rng.randint(1, 300)
        s = np.array([rng.choice([2, 3, 4] if trial % 2 else [2, 3]) for _ in range(n)], np.uint8)
        sa = S.suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: bytes(s[i:]))
        plcp = S.permuted_common_prefixes(s, sa, 50)
        for a, b in zip(sa[1:], sa[:-1]):
            x, y = bytes(s[a:]), bytes(s[b:])
            k = next((k for k in range(51) if k == 50 or k >= min(len(x), len(y)) or x[k] != y[k]))
            assert plcp[a] == k


def test_tokens_name_groups_and_repeats_stay_inside_them():
    tokens = [S._token(g) for g in range(5000)]
    assert len(set(tokens)) == 5000 and all(len(t) == S.TOKEN and t.count(b"\xff") == 1 for t in tokens)
    # width 3: windows hold 2 bytes around the core; rows 0 and 1 agree on "b|c", row 2 has the same bytes in another group
    parts = [b"ab" + tokens[0] + b"cd", b"xb" + tokens[0] + b"cy", b"ab" + tokens[1] + b"cd"]
    place = np.array([1000, 2000, 3000], np.uint64)
    got = S.repeated_windows(parts, place, np.zeros(3, bool), np.zeros(3, np.int64), np.full(3, 2), 2 + S.TOKEN)
    assert got == [(1, 1), (1, 1), None]
