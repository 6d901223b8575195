"""Byte-level BPE by backtracking over longest matches, and decoding.

The vocabulary's byte strings go, as Latin-1 text, into one Aho-Corasick
automaton that gives the longest token starting anywhere. A piece is encoded
from the left with longest matches; a token stands only where it is compatible
with the one before it, that is where the merges of both together would not
join across their border. Where it is not, the next shorter prefix token is
tried, and with none left the previous token is taken back. Each place is given
up at most once, so the work is linear in the piece; the result is exactly that
of merging pairs in the order of their ranks.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

from pyspark.sql import DataFrame

from tessera.llm.common import CACHE_ENTRIES, Remembered, map_texts


#: Pieces, and as many chunks, that a task remembers with their ids, at most (some 150 bytes each).
PIECES = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder of single pieces (matches of the pretokenizer's pattern)."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b) - 1, i))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[int, bool] = {}
        self.merges: dict[bytes, int] = ranks

    def longest(self, piece: bytes) -> dict[int, int]:
        """The longest token that starts at each byte of the piece."""
        # Matches come by their ends, so of those with one start the longest comes last and stays.
        return {end - back: token for end, (back, token) in self.automaton.iter(piece.decode("latin-1"))}

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of the token."""
        if token not in self.shorter:
            b = self.tokens[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; None for a single byte or one that no merge makes."""
        if token not in self.parts:
            b, last = self.tokens[token], None
            parts = [b[i : i + 1] for i in range(len(b))]
            while len(parts) > 2:
                best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < token), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2 and all(p in self.ranks for p in parts):
                last = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.parts[token] = last
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand beside each other in an encoding; remembered for each pair."""
        got = self.fits.get(left << 32 | right)
        if got is None:
            if len(self.fits) > CACHE_ENTRIES:
                self.fits.clear()
            got = self.fits[left << 32 | right] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.ranks) + (1 << 62)
        while True:
            joined = self.merges.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit and self.split(joined) == (a, b):
                return False
            if a > b:
                limit, parts = a, self.split(a)
                if parts is None:
                    return True
                a = parts[1]
                if a == limit:
                    return True
            else:
                limit, parts = b + 1, self.split(b)
                if parts is None:
                    return True
                b = parts[0]
                if b + 1 == limit:
                    return True

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        nxt, sizes, compatible = self.longest(piece), self.sizes, self.compatible
        shut = set()
        out: list[int] = []
        at, last = 0, -1
        token: int | None = nxt.get(0)
        while at < n:
            if token is None:
                raise ValueError("the vocabulary lacks a byte")
            to = at + sizes[token]
            if to not in shut and (last < 0 or compatible(last, token)):
                out.append(token)
                at, last, token = to, token, nxt.get(to)
                continue
            shorter = self.prefix(token)
            if shorter is not None:
                token = shorter
            else:
                shut.add(at)
                token = out.pop() if out else None
                at -= sizes.get(token, 0)
                last = out[-1] if out else -1
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """Whole texts to ids; pieces, and a space with what follows up to the next, are remembered."""

    def __init__(self, bpe: Bpe, find):
        self.find = find
        self.pieces = Remembered(lambda piece: tuple(bpe.encode(piece.encode("utf-8", "replace"))), PIECES)
        self.chunks = Remembered(lambda chunk: got[0] if len(got := [self.pieces[p] for p in find(chunk)]) == 1 else tuple(chain.from_iterable(got)), PIECES)

    def ids(self, text: str, by_space: bool) -> list[int]:
        self.pieces.turn()
        self.chunks.turn()
        if by_space and "  " not in text and "\0" not in text:
            return list(chain.from_iterable(map(self.chunks.__getitem__, text.replace(" ", "\0 ").split("\0"))))
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False, by_space: bool = False) -> DataFrame:
    """Each row's whole text encoded by the vocabulary at that path, each match of ``pattern`` separately, and decoded again.

    ``by_space`` says that under the pattern a match that holds a single space
    between other characters always starts with it; then texts without double
    spaces are taken apart at spaces before the pattern is applied, to the same
    result.

    Per row: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes); with ``keep_ids`` also ids (array).
    Null and empty texts have no tokens. A lone surrogate counts as "?".
    """

    def make():
        import regex

        bpe = Bpe(read_ranks(vocabulary))
        encoder = Encoder(bpe, regex.compile(pattern).findall)
        digits = {i: str(i) for i in bpe.tokens}

        def one(text: str) -> tuple:
            ids = encoder.ids(text, by_space)
            text_ids = ",".join(map(digits.__getitem__, ids))
            return len(ids), hashlib.sha256(text_ids.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), ids if keep_ids else None

        return lambda texts: dict(zip(["n_tokens", "ids_sha256", "decoded_sha256", "ids"], map(list, zip(*map(one, texts)))))

    return map_texts(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else ""), make)
