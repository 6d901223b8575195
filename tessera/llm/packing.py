"""Best-fit packing planned on a histogram of lengths.

Texts become token pieces; only their lengths are counted. A plan is made over
counts (best-fit decreasing on at most ``capacity`` lengths and groups of equal
bins, so its work and size depend on the capacity, not on the corpus): a segment
says that pieces of one length with ranks from r go to bins from b, k to a bin,
from an offset on. Pieces then take their slots by their rank within their
length. Ranks are dealt by (length, salt) and shifted by running counts, so no
length is gathered in one task.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Remembered, map_texts, partitions, written

CAPACITY = 2048
END = 0
#: Parts of words that a task remembers with their ids, at most (some 200 bytes each).
PARTS = 600_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, pieces, first bin, pieces to a bin, first offset) by best-fit decreasing over counts.

    A group is a run of bins with equal room left. Each length goes, largest
    first, into the fullest groups that have room for it, as often as it fits
    into a bin; then into new bins.
    """
    segments: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(room: int, first: int, n: int) -> None:
            nonlocal left, rank
            each = room // length
            for k, m in ((each, min(n, left // each)), (left - min(n, left // each) * each, 1)):
                if m and k and first < end:
                    segments.append((length, rank, k * m, first, k, capacity - room))
                    put(room - k * length, first, m)
                    rank, left, first = rank + k * m, left - k * m, first + m
                if not left:
                    break
            put(room, first, end - first)

        while left and (i := bisect_left(rooms, length)) < len(rooms):
            room = rooms[i]
            first, n = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            end = first + n
            fill(room, first, n)
        if left:
            n = -(-left // (capacity // length))
            end = bins + n
            fill(capacity, bins, n)
            bins = end
    return segments


def word_ids(path: str) -> Callable[[str], bytes]:
    """A function that gives the ids of a whole text as little-endian unsigned 32-bit numbers, as the tokenizer at that path would.

    Characters below U+0300 are their own NFC form and have no lower case that
    depends on their place: text of such is lower-cased and cut here by the
    tokenizer's own pattern, and the parts are merged by the tokenizer's model
    and remembered. White space is dropped by this tokenizer and ends a part, so
    in other texts each word that holds a character beyond goes through the whole
    tokenizer. Texts with odd white space, and other tokenizers' ones, do so as a whole.
    """
    import json
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        parts = _parts_of(json.load(f))
    tokenize = t.model.tokenize
    # Byte-level: bytes that aren't printable in Latin-1 stand as characters from U+0100 on, in their order.
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shown = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def encode(text: str) -> bytes:
        return array("I", t.encode(text, add_special_tokens=False).ids).tobytes()

    def part_ids(part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(shown)
        return array("I", [x.id for x in tokenize(part)]).tobytes()

    beyond, odd = re.compile("[\u0300-\U0010ffff]").search, re.compile("[\x1c-\x1f\x85]").search
    remembered, whole = Remembered(part_ids, PARTS), Remembered(encode)

    def near(text: str) -> bytes:
        return b"".join(map(remembered.__getitem__, parts(text.lower())))

    def ids_of(text: str) -> bytes:
        remembered.turn()
        whole.turn()
        text = text.encode("utf-8", "replace").decode()
        if parts is None or odd(text):
            return encode(text)
        if not beyond(text):
            return near(text)
        return b"".join(whole[w] if beyond(w) else near(w) for w in text.split())

    return ids_of


def _parts_of(made: dict) -> Callable[[str], list[str]] | None:
    """The cutter of lower-case text below U+0300 of a tokenizer's file, if it is of the form that ``word_ids`` knows; else None."""
    import re

    import regex

    norm = (made.get("normalizer") or {}).get("normalizers") or []
    cut = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
    known = [n.get("type") for n in norm] == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
    if not known or cut[0].get("behavior") != "Removed" or not cut[0].get("invert") or cut[1].get("add_prefix_space") or cut[1].get("use_regex"):
        return None
    pattern = cut[0]["pattern"]["Regex"]
    for kind in ("L", "N"):
        members = "".join(c for c in map(chr, range(0x300)) if regex.match(rf"\p{{{kind}}}", c))
        pattern = pattern.replace(rf"\p{{{kind}}}", members)
    # What the pattern says of other properties has no such form.
    return None if "\\p" in pattern or "\\P" in pattern else re.compile(pattern).findall


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of each row's whole text: doc_id, row, piece, start, length, ids_crc32 (and ids).

    Ids are the tokenizer's, without special tokens, then id 0; a piece has
    ``capacity`` ids, a text's last one the rest. ``row`` tells apart rows that
    share a doc_id. Null and empty texts are one piece of one id.
    """

    def make():
        ids_of = word_ids(tokenizer)

        def batch(texts: list[str]) -> dict:
            out = []
            for text in texts:
                raw = ids_of(text) + struct.pack("<I", END)
                cut = [raw[i : i + 4 * capacity] for i in range(0, len(raw), 4 * capacity)]
                out.append([{"piece": i, "start": i * capacity, "length": len(c) // 4, "ids_crc32": zlib.crc32(c), **({"ids": list(struct.unpack(f"<{len(c) // 4}I", c))} if keep_ids else {})} for i, c in enumerate(cut)])
            return {"pieces": out}

        return batch

    rows = docs.select("doc_id", "text")
    made = map_texts(rows, ["doc_id"], "pieces array<struct<piece: int, start: long, length: long, ids_crc32: long" + (", ids: array<int>" if keep_ids else "") + ">>", make)
    return made.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode("pieces").alias("p")).select("doc_id", "row", "p.*")


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: each sequence is gapless from offset 0 and holds at most ``capacity`` ids.

    The table of pieces is written first, so that ranks stay the same however
    often a task is run. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    cut = written(cut)
    salts = max(64, 4 * partitions(spark))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    segments = plan(totals, capacity)
    # As Arrow: rows in Python lists are read by Python workers of their own, which stay beside those of the other plans.
    slots = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*(segments or [(0, 0, 0, 0, 1, 0)]))], ["length", "rank", "n", "bin", "each", "at"]))
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "row", "piece"))
    ranked = salted.withColumn("n_local", local.cast("long")).join(before.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("n_local") - 1)
    # A length has at most some hundred segments: they come as one array, sorted by rank.
    by_length = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "bin", "each", "at"))).alias("plan"))
    s = F.element_at(F.filter("plan", lambda x: (x["rank"] <= F.col("rank")) & (F.col("rank") < x["rank"] + x["n"])), 1)
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("s", s)
    into = F.col("rank") - F.col("s.rank")
    return placed.select(
        *[c for c in cut.columns],
        (F.col("s.bin") + F.floor(into / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + (into % F.col("s.each")) * F.col("length")).cast("long").alias("offset"),
    )
