"""Licence scans: Aho-Corasick over words and identifier tags, expressions by a shunting yard.

Three kinds of evidence come from one pass of an automaton each:

* base phrases (``BASE``) and further notice phrases (``NOTICES``) over the
  stream of words, where a word is a run of letters, digits or characters
  beyond ASCII after lower-casing A-Z;
* identifier tags (``spdx-license-identifier:``) in the lower-cased text, whose
  rest of the line is parsed as an expression of identifiers with ``and``,
  ``or``, ``with``, ``+`` and parentheses.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from tessera.llm.common import map_texts

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases that the method adds.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx-license-identifier:"
_ORDER = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+_-]*")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def parse(expression: str) -> list[str] | None:
    """The expression in postfix order; None if it is not well-formed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for t in _TOKEN.findall(expression):
        if t in _ORDER:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], set[str]]:
    """(required, named): the licences that every way to comply holds, and all that some way holds.

    ``and`` requires what either side does, ``or`` what both do; ``with`` binds
    an exception to its licence. Smaller sets go into larger ones, so the work
    hardly exceeds the expression's length, however many ways there are.
    """
    stack: list[tuple[set[str], set[str]]] = []

    def union(x: set[str], y: set[str]) -> set[str]:
        if len(x) < len(y):
            x, y = y, x
        x |= y
        return x

    for t in postfix:
        if t not in _ORDER:
            stack.append(({t}, {t}))
            continue
        (rb, nb), (ra, na) = stack.pop(), stack.pop()
        if t == "or":
            stack.append((ra & rb, union(na, nb)))
        elif t == "and":
            stack.append((union(ra, rb), union(na, nb)))
        else:
            end = f" with {'/'.join(sorted(nb))}"
            stack.append(({i + end for i in ra}, {i + end for i in na}))
    return stack[0]


def tagged(rest: str) -> tuple[str, list[str]]:
    """The longest well-formed expression at the start of ``rest``, and its identifiers; one pass."""
    depth, operand, end, good = 0, False, 0, 0
    for m in _TOKEN.finditer(rest):
        t = m.group()
        if rest[end : m.start()].strip(" \t"):
            break
        if t in _ORDER:
            if not operand:
                break
            operand = False
        elif t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif operand:
            break
        else:
            operand = True
        end = m.end()
        if operand and not depth:
            good = end
    text = rest[:good].strip()
    return text, [t for t in parse(text) or [] if t not in _ORDER] if text else []


def scan(docs: DataFrame) -> DataFrame:
    """Licence evidence of each row's whole text.

    Per row: doc_id, n_words, n_base (all places of base phrases), first_word
    and last_word (smallest and largest start of a base phrase; null without),
    base_labels, labels (base and added; sorted, comma-joined, empty if none),
    score (0 without evidence; base phrases, notices and tags add up towards 1),
    expressions (the tags' expressions), required (what every way to comply with
    them holds) and optional (what only some ways hold).
    Null and empty texts have no words and score 0; repeated rows give repeated rows; an empty table gives none.
    """

    def make():
        import ahocorasick

        words = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE}.items():
            words.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
        words.make_automaton()
        tags = ahocorasick.Automaton()
        tags.add_word(TAG, len(TAG))
        tags.make_automaton()

        def one(text: str) -> tuple:
            raw = text.encode("utf-8", "surrogatepass")
            found = raw.translate(_FOLD).split()
            n = len(found)
            # Latin-1 keeps a byte a character, so places in the stream are byte places.
            stream = (b" " + b" ".join(found) + b" ").decode("latin-1")
            hits = []
            for end, (size, label, base) in words.iter(stream):
                hits.append((end + 1 - size, label, base))
            starts: list[int] = []
            if hits:
                spaces, at = [], stream.find(" ")
                last = max(h[0] for h in hits)
                while 0 <= at <= last:
                    spaces.append(at)
                    at = stream.find(" ", at + 1)
                starts = [bisect_left(spaces, h[0]) for h in hits]
            base = [(s, h[1]) for s, h in zip(starts, hits) if h[2]]
            base_labels = {label for _, label in base}
            labels = base_labels | {h[1] for h in hits}
            expressions: list[str] = []
            required: set[str] = set()
            named: set[str] = set()
            low = raw.translate(_LOWER).decode("latin-1")
            for end, _ in tags.iter(low):
                stop = low.find("\n", end + 1)
                line = low[end + 1 : stop if stop >= 0 else len(low)]
                text_, ids = tagged(line)
                if ids:
                    expressions.append(text_)
                    labels |= set(ids)
                    must, may = evaluate(parse(text_))
                    required |= must
                    named |= may
            kinds = (0.6 if base_labels else 0.0) + (0.25 if len(labels) > len(base_labels) else 0.0) + (0.15 if expressions else 0.0)
            return (n, len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(1.0, kinds), expressions, sorted(required), sorted(named - required))

        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "required", "optional"]
        return lambda texts: dict(zip(names, map(list, zip(*map(one, texts)))))

    return map_texts(docs, ["doc_id"], "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, required array<string>, optional array<string>", make)
