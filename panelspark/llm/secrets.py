"""Secret scan: base patterns plus a linear-chain conditional random field.

The field tags tokens as secret begin, inside or outside from shape, length,
neighbouring words and file features; the best tag sequence is found by
Viterbi.  It is trained here, by gradient steps on the exact log-likelihood
(forward-backward), on two bounded sources: lines made by a seeded generator
of common secret formats and of harmless look-alikes, and up to
``sample_rows`` documents of the table whose base matches serve as labels.

Every token of every text is decoded.  The texts of a batch stand in one
chain that starts afresh at each text; the chain is cut into blocks whose best
scores between any two end tags are max-plus matrices, found for all blocks at
once, so the result is that of Viterbi over each whole text.  Token features
are kept per distinct token and combined in numpy.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Iterable, Sequence
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.frames import col, field, map_texts, prepare

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")

SAMPLE_ROWS = 600        # bound on labelled rows taken from the table
GENERATED = 1200         # generated training lines
LEAST_LENGTH = 6         # shorter spans of the field are not reported
TRAIN_TOKENS = 64        # training sequences are windows of this many tokens
SAMPLE_WINDOWS = 1200    # bound on the windows of the sampled documents that train the field
PIECE = 1 << 20          # characters tokenised at a time
GROUP = 1 << 17          # characters of texts that are decoded together (one text at least)
BLOCK = 64               # tokens of a block of the chain
KNOWN = 400_000          # distinct tokens whose features a worker remembers

_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)
_WORDS = r"pass(?:word|wd|phrase|code)|pwd|auth|secret|token|api_?key|credential|private_?key|access_?key|bearer"
# a text without any of these (in lower case) needs no search for words or assignments
_HINTS = ("pass", "pwd", "auth", "secret", "token", "api", "credential", "private", "access", "bearer")
_HINT = re.compile("|".join(_HINTS))
_KEYWORD = re.compile(r"(?:[a-z]+_)*(?:" + _WORDS + r")s?", re.IGNORECASE | re.ASCII)
# a token with the white space before it
_TOKEN = re.compile(r"\s*(?:[A-Za-z0-9_]+|[^\sA-Za-z0-9_])", re.ASCII)
_EDGE = re.compile(r"(?<=\S)[^A-Za-z0-9_]", re.ASCII)   # a token ends before this
_SPACES = " \t\n\r\f\v"
_DIGIT = re.compile(r"[0-9]")
N_FEATURES = 1 << 16     # features are hashed to 16 bits


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _HINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in code points."""
    out = []
    if _hinted(text):
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
    return sorted(out)


def secret_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values inside the base matches: the labels for training."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_MIN]
    return out + [(s, e) for s, k, e in base_spans(text) if k]


def _shape(token: str) -> str:
    n = len(token)
    size = "0" if n < 6 else "1" if n < 10 else "2" if n < 16 else "3" if n < 20 else "4" if n < 28 else "5"
    if token.isalpha() and token.islower():
        return "a" + size
    if not token[0].isalnum() and token[0] != "_":
        return "p" + token if ord(token[0]) < 128 else "u"
    digit, upper = bool(_DIGIT.search(token)), token != token.lower()
    s = ("a" if token != token.upper() or "_" in token else "") + ("A" if upper else "") + ("0" if digit else "")
    if digit and not upper and _HEX_RUN.fullmatch(token):
        s += "x"
    elif s == "aA" and token[1:].islower():
        s = "Aa"
    return s + size


@lru_cache(maxsize=4096)
def _shape_hash(shape: str) -> int:
    return crc32(shape.encode("utf-8", "replace")) & 0xFFFF


class _Known(dict):
    """Number of each token with the white space before it; what the features need of it by that number.

    Two integers: length of the token itself (31 bits), hash of the word (16),
    hash of its first four letters (6), is a word, is a secret word, variety of
    its characters (3), share of vowels (3); and its shape's hash.
    """

    def __init__(self):
        super().__init__()
        self.info, self.shape, self.size = array("q"), array("q"), 0

    def forget(self) -> None:
        """Start anew once too much is remembered."""
        if len(self) > KNOWN or self.size > 32 * KNOWN:
            self.clear()
            self.__init__()

    def __missing__(self, spaced: str) -> int:
        t = spaced.lstrip(_SPACES)
        low = t.lower()
        some = low.encode("utf-8", "replace")[:64]
        n, size = len(t), len(some)
        word = t[0].isalnum() or t[0] == "_"
        key = word and n < 64 and _HINT.search(low) is not None and _KEYWORD.fullmatch(t) is not None
        variety = len(set(t)) * 4 // min(n, 16)
        vowels = (size - len(some.translate(None, b"aeiou"))) * 8 // size
        head = crc32(some[:4] if n > 3 else b"=" + some) & 63
        # 7 at most: variety of a long token can be more
        self.info.append(n << 30 | (crc32(some) & 0xFFFF) << 14 | head << 8 | word << 7 | key << 6 | min(variety, 7) << 3 | min(vowels, 7))
        self.shape.append(_shape_hash(_shape(t)))
        self.size += len(spaced)
        self[spaced] = number = len(self.info) - 1
        return number


_known = _Known()


class Tokens:
    """The tokens of some texts: bounds in their text, number of the text, and what the features need."""

    def __init__(self, texts: Sequence[str | None]):
        ends, info, shape, count, kinds = [], [], [], [], []
        for text in texts:
            text = text or ""
            n, at, stop = 0, 0, len(text.rstrip(_SPACES))
            while at < stop:
                cut = _EDGE.search(text, at + PIECE, stop) if at + PIECE < stop else None
                to = cut.start() if cut else stop
                found = _TOKEN.findall(text, at, to)
                _known.forget()
                numbers = np.fromiter(map(_known.__getitem__, found), np.int64, len(found))
                info.append(np.frombuffer(_known.info, np.int64)[numbers])
                shape.append(np.frombuffer(_known.shape, np.int64)[numbers])
                ends.append(at + np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
                n += len(found)
                at = to
            count.append(n)
            kinds.append(int(file_feature(text)) if n else 0)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.end, code, self.shape = join(ends, np.int64), join(info, np.int64), join(shape, np.int64)
        self.count = np.array(count, dtype=np.int64)
        self.text = np.repeat(np.arange(len(count)), self.count)
        self.kind = np.repeat(np.array(kinds, dtype=np.int64), self.count)
        take = lambda shift, bits: (code >> shift) & ((1 << bits) - 1)
        self.vowels, self.variety, self.key = take(0, 3), take(3, 3), take(6, 1)
        self.word, self.head, self.hash = take(7, 1), take(8, 6), take(14, 16)
        self.start = self.end - (code >> 30)
        self.first = np.zeros(len(code), dtype=bool)   # begins a text
        self.first[(np.cumsum(self.count) - self.count)[self.count > 0]] = True


def features(k: Tokens) -> Iterable[np.ndarray]:
    """Feature numbers of all tokens, one array per kind of feature.

    Shape, first letters and characters of the token; whether it is a secret
    word and how far back the last one is; shapes of the neighbours and
    whether they touch; the neighbouring words (nearest word before and
    after, punctuation left out, and the one before that); kind of file.
    """
    n = len(k.end)
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(k.first, at, 0)) if n else at
    last = np.append(k.first[1:], True) if n else k.first
    shape = k.shape

    def before(flag: np.ndarray) -> np.ndarray:
        """Place of the nearest flagged token before each token of the same text, or -1."""
        mark = np.maximum.accumulate(np.where(flag, at, -1)) if n else at
        mark = np.append([-1], mark[:-1])[:n]
        return np.where(mark >= begin, mark, -1)

    def valued(place: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, value[place] if n else value, 1 << 16)

    key = before(k.key > 0)
    since = np.where(key >= 0, np.minimum(9, at - key), 9)
    touch = np.zeros(n, dtype=np.int64)
    touch[1:] = (k.start[1:] == k.end[:-1]) & ~k.first[1:]
    touch_after = np.append(touch[1:], 0)[:n]
    left = np.where(k.first, 1 << 16, np.append([0], shape[:-1])[:n])
    right = np.where(last, 1 << 16, np.append(shape[1:], 0)[:n])
    word = before(k.word > 0)
    # the nearest word after, by the same on the reversed order
    far = np.minimum.accumulate(np.where(k.word > 0, at, n)[::-1])[::-1] if n else at
    far = np.append(far[1:], n)[:n]
    same = far < n
    same[same] = k.text[far[same]] == k.text[at[same]]
    after = np.where(same, far, -1)
    second = np.where(word >= 0, word[word] if n else word, -1)
    kinds = [shape, k.key, since, since << 17 | shape, left << 1 | touch, right << 1 | touch_after,
             (left << 1 | touch) << 17 | shape, k.variety << 17 | shape, k.vowels << 17 | shape, k.kind << 17 | shape, k.head,
             valued(word, k.hash), valued(after, k.hash), valued(second, k.hash)]
    for number, code in enumerate(kinds):
        # multiply-shift: the upper 16 bits
        yield ((code.view(np.uint64) + np.uint64(number + 1 << 44)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def file_feature(text: str) -> str:
    """Coarse kind of file: how much of it is assignment and bracket characters."""
    n = sum(text.count(c) for c in "={};:\"")
    return str(min(3, n * 60 // max(len(text), 1)))


class SecretField:
    """Weights of the linear chain: emissions per feature and tag, transitions, start."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    @staticmethod
    def _padded(seqs: Sequence[Sequence[Sequence[int]]]):
        longest = max(len(s) for s in seqs)
        width = len(seqs[0][0])
        ids = np.zeros((len(seqs), longest, width), dtype=np.int32)
        mask = np.zeros((len(seqs), longest), dtype=bool)
        for i, s in enumerate(seqs):
            ids[i, :len(s)] = s
            mask[i, :len(s)] = True
        return ids, mask

    def decode(self, tokens: Tokens) -> np.ndarray:
        """Viterbi tags (0 outside, 1 begin, 2 inside) of all tokens, each text a chain of its own."""
        score = np.zeros((len(tokens.end), 3), dtype=np.float32)
        table = self.emit.astype(np.float32)
        for numbers in features(tokens):
            score += table.take(numbers.view(np.int64), axis=0)
        return self.best(score, tokens.first)

    def best(self, score: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Best tags of chains that begin where ``first`` is set, from (token, tag) scores."""
        n = len(score)
        if not n:
            return np.zeros(0, dtype=np.int8)
        rows = -(-n // block)
        padded = np.zeros((rows * block, 3))
        padded[:n] = score
        # one plane per tag, the tokens of one place of all blocks side by side
        plane = np.ascontiguousarray(padded.reshape(rows, block, 3).transpose(1, 2, 0))
        starts = np.append(np.flatnonzero(first), [n] if n < rows * block else [])   # what fills the last block is a chain of its own
        starts = starts.astype(np.int64)
        starts = [starts[starts % block == t] // block for t in range(block)]
        move, begin = self.move, self.begin

        def step(v: np.ndarray, t: int) -> np.ndarray:
            """(..., tag before, tag, block) scores of moving to token t of every block."""
            ways = v[..., :, None, :] + move[:, :, None]
            if len(starts[t]):
                ways[..., starts[t]] = v[..., :, None, starts[t]] + begin[:, None]
            return ways

        # best scores through each block, by the tag before it and the tag at its end
        through = np.where(np.eye(3, dtype=bool)[:, :, None], 0.0, np.full((3, 3, rows), -1e18))
        for t in range(block):
            through = step(through, t).max(axis=1) + plane[t]
        enter, at = np.zeros((3, rows)), np.zeros(3)
        for r, part in enumerate(through.transpose(2, 0, 1)):
            enter[:, r] = at
            at = (at[:, None] + part).max(axis=0)
            at -= at.max()
        back = np.zeros((block, 3, rows), dtype=np.int8)
        v = enter
        for t in range(block):
            ways = step(v, t)
            back[t] = ways.argmax(axis=0)
            v = ways.max(axis=0) + plane[t]
        # the tag before a block, for each tag at its end
        block_at = np.arange(rows)
        origin = np.repeat(np.arange(3, dtype=np.int8)[:, None], rows, axis=1)
        for t in range(block - 1, -1, -1):
            origin = back[t][origin, block_at]
        end = np.zeros(rows, dtype=np.int8)
        end[-1] = v[:, -1].argmax()
        for r in range(rows - 1, 0, -1):
            end[r - 1] = origin[end[r], r]
        tags = np.zeros((block, rows), dtype=np.int8)
        for t in range(block - 1, -1, -1):
            tags[t] = end
            end = back[t][end, block_at]
        return tags.T.ravel()[:n]

    @classmethod
    def train(cls, seqs: Sequence[Sequence[Sequence[int]]], gold: Sequence[Sequence[int]], epochs: int = 12,
              batch: int = 64, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> SecretField:
        """Maximum likelihood by Adagrad; gradients from forward-backward."""
        emit = np.zeros((N_FEATURES, 3))
        move, begin = np.zeros((3, 3)), np.zeros(3)
        move[0, 2] = begin[2] = -1e4   # inside never follows outside and never starts
        model = cls(emit, move, begin)
        g_emit, g_move, g_begin = np.full_like(emit, 1e-6), np.full_like(move, 1e-6), np.full_like(begin, 1e-6)
        rng = np.random.default_rng(seed)
        keep = [i for i in range(len(seqs)) if len(seqs[i])]
        lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        for _ in range(epochs if keep else 0):
            order = sorted(rng.permutation(keep), key=lambda i: len(seqs[i]))
            chunks = [order[i:i + batch] for i in range(0, len(order), batch)]
            for c in rng.permutation(len(chunks)):
                ids, mask = cls._padded([seqs[i] for i in chunks[c]])
                n, length, _ = ids.shape
                want = np.zeros((n, length), dtype=np.int64)
                for r, i in enumerate(chunks[c]):
                    want[r, :len(gold[i])] = gold[i]
                score = emit[ids].sum(axis=2)
                fwd, bwd = np.zeros((n, length, 3)), np.zeros((n, length, 3))
                fwd[:, 0] = begin + score[:, 0]
                for t in range(1, length):
                    nxt = lse(fwd[:, t - 1][:, :, None] + move, 1) + score[:, t]
                    fwd[:, t] = np.where(mask[:, t][:, None], nxt, fwd[:, t - 1])
                z = lse(fwd[:, -1], 1)
                for t in range(length - 2, -1, -1):
                    prev = lse(move[None] + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                    bwd[:, t] = np.where(mask[:, t + 1][:, None], prev, 0.0)
                p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
                d = p - np.eye(3)[want] * mask[:, :, None]
                both = mask[:, 1:] & mask[:, :-1]
                pair = np.exp(fwd[:, :-1, :, None] + move + (score + bwd)[:, 1:, None, :] - z[:, None, None, None])
                d_move = (pair * both[:, :, None, None]).sum(axis=(0, 1))
                np.subtract.at(d_move, (want[:, :-1][both], want[:, 1:][both]), 1)
                d_emit = np.zeros_like(emit)
                used, part = ids[mask].ravel(), np.repeat(d[mask], ids.shape[2], axis=0)
                for tag in range(3):
                    d_emit[:, tag] = np.bincount(used, part[:, tag], N_FEATURES)
                for w, g, grad in ((emit, g_emit, d_emit), (move, g_move, d_move), (begin, g_begin, d[:, 0].sum(axis=0))):
                    grad = grad / n + decay * w
                    g += grad * grad
                    free = w > -1e3
                    w[free] -= (rate * grad / np.sqrt(g))[free]
        return model


def generated_lines(n: int = GENERATED, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Training lines with their secret spans: common secret formats and harmless look-alikes, from a seeded rule."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: pick("etaoinshrdlu", rng.randint(2, 9))
    camel = lambda k: "".join(word().capitalize() for _ in range(k))
    hexs = "0123456789abcdef"
    secrets = [lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "AKIA" + pick(alnum[:26] + alnum[-10:], 16),
               lambda: pick(hexs, rng.choice([32, 40, 64])), lambda: pick(alnum, rng.randint(16, 44)),
               lambda: pick(alnum + "+/", 40) + "==", lambda: ".".join(["eyJ" + pick(alnum, 20), pick(alnum, 40), pick(alnum, 30)]),
               lambda: pick(alnum[:52], rng.randint(16, 40)), lambda: "-".join(["xoxb", pick("0123456789", 12), pick("0123456789", 12), pick(alnum, 24)])]
    # told by their name alone
    named = [lambda: camel(rng.randint(2, 5)) + "xy", lambda: word() + "-" + word() + "-" + word(), lambda: pick(alnum[26:52], rng.randint(6, 28)), lambda: pick(alnum[:52], rng.randint(6, 16)),
             lambda: pick(alnum, rng.randint(6, 16))]
    harmless = [lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: f"+1 ({pick('0123456789', 3)}) 555-{pick('0123456789', 4)}",
                lambda: pick("0123456789", 16), lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"20{pick('0123456789', 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
                lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"https://{word()}.example.org/{word()}/{rng.randint(1, 999)}", lambda: f"the {rng.choice(['token', 'password', 'secret', 'api key'])} {word()} {word()}",
                lambda: "-".join([pick(hexs, 8), pick(hexs, 4), pick(hexs, 4), pick(hexs, 4), pick(hexs, 12)]),
                lambda: word() + camel(rng.randint(1, 3)), lambda: f"{word()}: {word()}{word()} {word()}", lambda: f"{word()} = {camel(2)}", lambda: f"{word().capitalize()}: {camel(1)}",
                lambda: word() * rng.randint(3, 60), lambda: pick("etaoinshrdlu", rng.randint(16, 60)), lambda: "-".join(word() for _ in range(6)),
                lambda: f"https://{word()}.example.org/{word()}/{word()}-{word()}",
                lambda: f"https://{word()}.example.org/{word()}?id={pick(alnum, rng.randint(8, 20))}&page={rng.randint(1, 99)}",
                lambda: f"https://{word()}.example.org/{pick(alnum, rng.randint(8, 24))}", lambda: word().upper() + " " + word().upper() + word().upper()]
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "client_secret", "bearer", "DB_PASSWORD", "AUTH_TOKEN", "pwd", "AUTH", "passphrase"]
    joins = [" = \"{}\"", ": {}", "={}", "='{}'", "\": \"{}\"", " := {}", " {}"]
    out = []
    for _ in range(n):
        left, right = " ".join(word() for _ in range(rng.randint(0, 8))), " ".join(word() for _ in range(rng.randint(0, 8)))
        if rng.random() < 0.5:
            by_name = rng.random() < 0.4
            value = rng.choice(named if by_name else secrets)()
            head = (rng.choice(names) + rng.choice(joins[:-1] if by_name else joins)).split("{}") if by_name or rng.random() < 0.8 else ["", ""]
            lead = f"{left} {head[0]}"
            out.append((f"{lead}{value}{head[-1]} {right}", [(len(lead), len(lead) + len(value))]))
        else:
            out.append((f"{left} {rng.choice(harmless)()} {right}", []))
    return out


def _tags(start: np.ndarray, end: np.ndarray, secrets: Iterable[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(start), dtype=np.int64)
    for lo, hi in secrets:
        inside = np.flatnonzero((start >= lo) & (end <= hi))
        tags[inside] = 2
        tags[inside[:1]] = 1
    return tags


def train_field(docs: DataFrame | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS,
                generated: int = GENERATED, sample_windows: int = SAMPLE_WINDOWS) -> SecretField:
    """Fit the field on generated lines and ``sample_windows`` windows of ``sample_rows`` documents at most.

    The documents are those of the lowest text hashes with a digit.
    """
    lines = generated_lines(generated)
    if docs is not None and sample_rows:
        t = col(text).cast("string")
        some = docs.filter(t.rlike("[0-9]") & (F.length(t) < 20_000)).select(t.alias("t"), F.xxhash64(t).alias("h"))
        # the hashes first, then the texts of those alone: what reaches the driver is bounded by the sample
        first = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(sample_rows).collect()]
        rows = some.filter(F.col("h") <= first[-1]).dropDuplicates(["h"]).orderBy("h").collect() if first else []
        lines += [(r["t"], secret_values(r["t"])) for r in rows]
    tokens = Tokens([line for line, _ in lines])
    numbers = np.stack(list(features(tokens)), axis=1)
    ends = np.cumsum(tokens.count)
    own, windows = [], []   # of the generated lines, of the documents
    for i, (lo, hi, (_, secrets)) in enumerate(zip(ends - tokens.count, ends, lines)):
        tags = _tags(tokens.start[lo:hi], tokens.end[lo:hi], secrets)
        for a in range(lo, hi, TRAIN_TOKENS):
            b = min(a + TRAIN_TOKENS, hi)
            (own if i < generated else windows).append((numbers[a:b], tags[a - lo:b - lo]))
    # evenly among those with a secret, which may fill half of the bound, and among the others
    held, free = [w for w in windows if w[1].any()], [w for w in windows if not w[1].any()]
    room = sample_windows - min(len(held), sample_windows // 2)
    held, free = ([w[j] for j in np.linspace(0, len(w) - 1, min(len(w), most)).astype(int)] if w else []
                  for w, most in ((held, sample_windows // 2), (free, room)))
    return SecretField.train(*zip(*(own + held + free))) if own or held or free else SecretField.train([], [])


def find_spans(texts: Sequence[str | None], model: SecretField) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind number, end) of each text: base matches, and the field's where no base match lies."""
    out: list[list[tuple[int, int, int]]] = []
    lo = 0
    while lo < len(texts):   # some texts at a time, at least one
        hi, size = lo + 1, len(texts[lo] or "")
        while hi < len(texts) and size + len(texts[hi] or "") <= GROUP:
            size += len(texts[hi] or "")
            hi += 1
        out += _spans_of(texts[lo:hi], model)
        lo = hi
    return out


def _spans_of(texts: Sequence[str | None], model: SecretField) -> list[list[tuple[int, int, int]]]:
    out = [base_spans(text or "") for text in texts]
    tokens = Tokens(texts)
    tags = model.decode(tokens)
    found: dict[int, list[tuple[int, int]]] = {}
    marked = np.flatnonzero(tags)
    # a span begins at tag 1; the tokens of tag 2 that follow it without a gap belong to it
    heads = np.flatnonzero(tags[marked] == 1)
    for a, b in zip(heads, np.append(heads[1:], len(marked))):
        i, j = marked[a], marked[b - 1]
        found.setdefault(int(tokens.text[i]), []).append((int(tokens.start[i]), int(tokens.end[j])))
    for i, spans in found.items():
        base = [(s, e) for s, k, e in out[i]]
        for a, b in spans:
            while b > a and texts[i][b - 1] in ".,;:!?\"')":
                b -= 1
            if b - a >= LEAST_LENGTH and not any(a < e and b > s for s, e in base):
                out[i].append((a, 3, b))
    return [sorted(x) for x in out]


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FIELDS = [field("n_assign", "long"), field("n_access", "long"), field("n_hex", "long"),
          field("base_sha256", "string"), field("spans", "string")]


def scan_secrets(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
                 model: SecretField | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Secrets of every document row.

    Counts of the base matches per kind, the digest of their list, and all
    spans with those of the field, as ``kind:start:end`` in code points.

    Null and empty texts have no spans (empty strings).  Repeated rows each
    get a row; spans that start together stand in the order of KINDS.
    Columns outside ``keep`` are not read; an empty table trains on
    generated lines alone.
    """
    prepare(docs.sparkSession)
    model = model or train_field(docs, text, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(column: pa.Array) -> dict[str, pa.Array]:
        spans = find_spans(column.to_pylist(), shared.value)
        base = [[s for s in x if s[1] < 3] for x in spans]
        count = lambda k: pa.array([sum(s[1] == k for s in x) for x in base], pa.int64())
        return {"n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                "base_sha256": pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()),
                "spans": pa.array([joined(x) for x in spans], pa.string())}
    return map_texts(docs, scan, FIELDS, text, keep)


def redact_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]",
                   model: SecretField | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All documents and columns, each secret's value replaced by ``mark``; ``length`` (if there) follows the text.

    Of an assignment the value alone goes, its name stays.  Null texts stay null.
    """
    prepare(docs.sparkSession)
    model = model or train_field(docs, text, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index(text)
    at_length = docs.columns.index(length) if length in docs.columns else None

    def clean(value: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return value
        out, done = [], 0
        for a, k, b in spans:
            if k == 0:
                a = ASSIGN.match(value, a).start(2)
            if b <= done:
                continue
            out += [value[done:max(a, done)], mark if a >= done else ""]
            done = b
        return "".join(out) + value[done:]

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            spans = find_spans(texts, shared.value)
            fresh = [clean(t, s) for t, s in zip(texts, spans)]
            cols = list(b.columns)
            cols[at] = pa.array(fresh, b.column(at).type)
            if at_length is not None:
                old = b.column(at_length).to_pylist()
                cols[at_length] = pa.array([len(f) if s else o for f, s, o in zip(fresh, spans, old)], b.column(at_length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
