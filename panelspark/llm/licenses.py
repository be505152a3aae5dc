"""License scan: Aho-Corasick over words, licence expressions by shunting-yard.

The texts are reduced to their words (ASCII lower case), one space between
them, so that a phrase is found wherever its words stand in sequence.  One
automaton holds all base phrases, notice phrases and licence names.
Identifier tags (``SPDX-License-Identifier: ...``) are read from the raw text
around the tag that the automaton found; their and/or/with expression is
evaluated by a shunting-yard parser to the labels that a user must accept.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.frames import field, map_texts
from panelspark.llm.kernels import ALNUM, LOWER

# The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Notice phrases of common licences (public texts), as words, and their labels.
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "apache license": "apache",
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license": "gpl",
    "creative commons": "cc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "permission to use copy modify and or distribute this software": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "unlicense": "unlicense",
}
TAG = "spdx license identifier"
# How sure a kind of evidence makes the scan: an identifier tag, a phrase of several words, a single word.
EVIDENCE = {"tag": 1.0, "base": 0.9, "notice": 0.8, "word": 0.4}
_TAG_LINE = re.compile(r"spdx-license-identifier\s*:\s*([^\n\r]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str] | None:
    """Postfix form of a licence expression by shunting-yard; None if it is malformed.

    ``with`` binds tightest, then ``and``, then ``or``; text after the first
    complete expression (a comment end, say) is ignored.
    """
    out: list[str] = []
    ops: list[str] = []
    want_operand = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if want_operand:
            if low == "(":
                ops.append("(")
            elif low == ")" or low in _RANK:
                return None
            else:
                out.append(low)
                want_operand = False
        elif low in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            want_operand = True
        elif low == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        else:
            break
    if want_operand or "(" in ops:
        return None
    return out + ops[::-1]


def licences(postfix: Sequence[str]) -> set[str]:
    """The names that an expression speaks of, each ``x with y`` as one.

    One pass with a stack of name sets; the smaller set is poured into the
    larger one, so an expression of n terms takes about n steps however its
    clauses are nested.  An exception is a single name: ``(a or b) with c``
    gives both with c; where both sides have several names, the names stand
    alone.
    """
    stack: list[set[str]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append({token})
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with" and min(len(left), len(right)) == 1:
            stack.append({f"{x} with {y}" for x in left for y in right})
        else:
            if len(left) < len(right):
                left, right = right, left
            left |= right
            stack.append(left)
    return stack[0]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for phrase in {**NOTICE_PHRASES, **BASE_PHRASES, TAG: None}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


_TO_SPACE = bytes(int(LOWER[b]) if ALNUM[b] else 0x20 for b in range(256))


def scan_text(text: str | None) -> dict:
    """Everything the scan finds in one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_TO_SPACE).split()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    places, base, labels, weight = [], set(), set(), 0.0
    tagged = False
    for end, phrase in _automaton().iter(line):
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE_PHRASES:
            places.append(end - len(phrase) - 1)
            base.add(BASE_PHRASES[phrase])
            weight = max(weight, EVIDENCE["base"])
        if phrase in NOTICE_PHRASES:
            labels.add(NOTICE_PHRASES[phrase])
            weight = max(weight, EVIDENCE["notice" if " " in phrase else "word"])
    expressions = []
    if tagged:
        for m in _TAG_LINE.finditer(text):
            postfix = to_postfix(m.group(1))
            if postfix:
                expressions.append(" ".join(postfix))
                labels |= licences(postfix)
                weight = EVIDENCE["tag"]
    first = last = None
    if places:
        places.sort()
        first = line.count(" ", 0, places[0])
        last = first + line.count(" ", places[0], places[-1])
    return {"n_words": len(words), "n_base": len(places), "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)),
            "score": weight, "expressions": expressions}


FIELDS = [field("n_words", "long"), field("n_base", "long"), field("first_word", "long"), field("last_word", "long"),
          field("base_labels", "string"), field("labels", "string"), field("score", "double"),
          field("expressions", "string[]")]


def scan_licenses(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Licence findings of every document row.

    ``n_base`` counts the places of the base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest of their first words (null
    without a place), ``base_labels`` their labels; ``labels`` adds those of
    notice phrases and identifier tags; ``score`` is the weight of the best
    evidence, 0 without any; ``expressions`` are the tags' expressions in
    postfix form.

    Null and empty texts have no words and no findings (empty strings).
    Repeated rows each get a row; a malformed expression adds no label.
    Columns outside ``keep`` are not read.
    """
    def scan(column: pa.Array) -> dict[str, pa.Array]:
        found = [scan_text(t) for t in column.to_pylist()]
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return {f.name: pa.array([x[f.name] for x in found],
                                 types.get(f.dataType.typeName(), pa.list_(pa.string()))) for f in FIELDS}
    return map_texts(docs, scan, FIELDS, text, keep)
