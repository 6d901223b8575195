"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are minimizers of word 8-mers: of each 16 consecutive ones the smallest
hash is taken, so any 23 words in common share one. A seed is joined with its
earliest document (smallest doc_id), never with all others, so work grows with
the text. The matches of two documents are merged along diagonals and chained:
in order of both texts, with a cost for gaps, by prefix maxima in a Fenwick
tree. Each chain is aligned word by word, grown at both ends, and kept as a
fuzzy passage if enough of it agrees; else its longest parts that agree enough
are kept. Chains with different documents that
adjoin in a text count together, as a passage may have been seen first in
parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, freed, joined, map_texts, mix, slices, text_slices, windows, words_of, written

K, WINDOW = 8, 16
#: Words of a passage at least, of one chain at least, and the share of them that agrees.
PASSAGE, CHAIN, IDENTITY = 50, 20, 0.8
#: Cost of a word in a gap between chained matches, and the largest gap in words.
GAP_COST, GAP_MOST = 0.25, 100
#: Growth at an end stops when it has lost so much; a mismatch costs 2, a match gains 1.
DROP, MARGIN = 12, 64
#: Cuts of one text, and pairs of cuts, that are handled together.
ASKS = 1000


def minimizers(h: np.ndarray, k: int = K, w: int = WINDOW) -> np.ndarray:
    """Places of the k-mers that are the smallest of some w consecutive ones (of all, where there are fewer)."""
    g = mix(windows(h, k)) if len(h) >= k else np.empty(0, np.uint64)
    if not len(g):
        return np.empty(0, np.int64)
    # The leftmost of equal k-mers is the smallest: places stand in the low bits.
    g = g & ~np.uint64(0xFFFFF) | (np.arange(len(g)) & 0xFFFFF).astype(np.uint64)
    w = min(w, len(g))
    least = _sliding(g, w, np.minimum)
    # A k-mer is the smallest of a window if and only if the greatest minimum of the windows around it is its own.
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == g)


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """The best of each w consecutive values, by overlapping halves."""
    size = 1
    while 2 * size <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def chain(x: np.ndarray, y: np.ndarray, k: int = K) -> list[list[tuple[int, int, int]]]:
    """Chains of matches (k words at x in one text and at y in the other), best first; a match is in one chain at most.

    A chain is a list of (x, y, words), ascending in both. Its score is the
    words covered less ``GAP_COST`` for each word of the gaps (in both texts).
    """
    # Matches on one diagonal that overlap or lie near become one anchor.
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.r_[True, ((y - x)[1:] != (y - x)[:-1]) | (x[1:] > x[:-1] + k + WINDOW)]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(x)] - 1
    anchors = sorted(zip(x[start].tolist(), y[start].tolist(), (x[end] - x[start] + k).tolist()))
    score, back = _scores(anchors)
    out, used = [], [False] * len(anchors)
    # Best ends first; a chain is followed back to its start or to what a better chain has taken.
    for i in sorted(range(len(anchors)), key=score.__getitem__, reverse=True):
        picked = []
        while i is not None and not used[i]:
            used[i] = True
            picked.append(anchors[i])
            i = back[i]
        if picked:
            out.append(picked[::-1])
    return out


def _scores(anchors: list[tuple[int, int, int]]) -> tuple[list[float], list[int | None]]:
    """For each anchor the score of the best chain that ends with it, and its predecessor there; in one pass."""
    n = len(anchors)
    back: list[int | None] = [None] * n
    ends = sorted({a[1] + a[2] for a in anchors})
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ends) + 1)
    score = [0.0] * n
    waiting = sorted(range(n), key=lambda i: anchors[i][0] + anchors[i][2])
    w = 0
    for i, (x, y, size) in enumerate(anchors):
        while w < n and anchors[waiting[w]][0] + anchors[waiting[w]][2] <= x:
            j = waiting[w]
            xe, ye = anchors[j][0] + anchors[j][2], anchors[j][1] + anchors[j][2]
            item, at = (score[j] + GAP_COST * (xe + ye), j), bisect_left(ends, ye) + 1
            while at <= len(ends):
                if item > tree[at]:
                    tree[at] = item
                at += at & -at
            w += 1
        at, top = bisect_left(ends, y + 1), (float("-inf"), -1)
        while at:
            top = max(top, tree[at])
            at -= at & -at
        if top[1] >= 0 and not _near(anchors[top[1]], x, y):
            # The best of all lies too far: the best of those that ended not long ago, at most as many as the largest gap has words.
            top, k = (float("-inf"), -1), w
            while k and (a := anchors[j := waiting[k - 1]])[0] + a[2] >= x - GAP_MOST:
                if a[1] + a[2] <= y and _near(a, x, y):
                    top = max(top, (score[j] + GAP_COST * (a[0] + a[1] + 2 * a[2]), j))
                k -= 1
        score[i] = size
        gained = top[0] - GAP_COST * (x + y)
        if top[1] >= 0 and gained > 0:
            score[i] += gained
            back[i] = top[1]
    return score, back


def _near(a: tuple[int, int, int], x: int, y: int) -> bool:
    return max(x - a[0], y - a[1]) - a[2] <= GAP_MOST


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two short runs have in common, in order (longest common subsequence)."""
    if not len(a) or not len(b):
        return 0
    if len(a) == 1 or len(b) == 1:
        return int((a == b).any())
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        hit = np.r_[0, row[:-1] + (b == v)]
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


def _grow(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many places from the start two runs go together, mismatches allowed, before the loss exceeds ``DROP``, and how many of them agree."""
    n = min(len(a), len(b))
    same = (a[:n] == b[:n]).tobytes()
    if same.count(1) == n:
        return n, n
    score = best = at = 0
    for i, agrees in enumerate(same, 1):
        if agrees:
            score += 1
            if score > best:
                best, at = score, i
        else:
            score -= 2
            if best - score > DROP:
                break
    return at, same.count(1, 0, at)


def align(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """(start, end, other start, other end, agreeing words) of a chain in word hashes a and b, grown at both ends."""
    (x0, y0, _), (x1, y1, s1) = anchors[0], anchors[-1]
    left, same = _grow(a[:x0][::-1], b[:y0][::-1])
    right, more = _grow(a[x1 + s1 :], b[y1 + s1 :])
    same += more
    for i, (x, y, s) in enumerate(anchors):
        same += np.count_nonzero(a[x : x + s] == b[y : y + s])
        if i:
            px, py, ps = anchors[i - 1]
            same += common(a[px + ps : x], b[py + ps : y])
    return x0 - left, x1 + s1 + right, y0 - left, y1 + s1 + right, same


def exact_runs(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs of equal words of a chain's anchors, each anchor grown exactly into the gaps and at the ends."""
    out: list[tuple[int, int, int]] = []
    for i, (x, y, s) in enumerate(anchors):
        px, py = (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) if out else (0, 0)
        nx, ny = anchors[i + 1][:2] if i + 1 < len(anchors) else (len(a), len(b))
        before, after = min(x - px, y - py), min(nx - x, ny - y) - s
        lo, hi = x - before, x + s + after
        same = a[lo:hi] == b[lo + y - x : hi + y - x]
        edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
        for u, v in zip(edge[::2].tolist(), edge[1::2].tolist()):
            # Beyond the anchor only what touches it; the rest of a gap is aligned by `common`.
            if v > before and u < before + s:
                out.append((lo + u, lo + u + y - x, v - u))
    return out


def parts(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]], least: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """A chain as ``align`` gives it if enough of it agrees, else its longest stretches of which enough does.

    A stretch begins and ends with a run of equal words and has at least ``least``
    words. The longest comes first, then those of what is left on its two sides.
    """

    def enough(p: tuple[int, int, int, int, int]) -> bool:
        return p[4] >= identity * max(1, p[1] - p[0], p[3] - p[2])

    whole = align(a, b, anchors)
    if enough(whole) or whole[1] - whole[0] < least:
        return [whole]
    runs = exact_runs(a, b, anchors)
    if not runs:
        return []
    # gain[i]: what is over, up to the start of run i, when a word that disagrees outweighs those that must agree with it.
    cost = identity / (1 - identity) if identity < 1 else float(len(a) + len(b))
    gain, ends = [0.0], []
    for i, (x, y, s) in enumerate(runs):
        ends.append(gain[-1] + s)
        if i + 1 < len(runs):
            nx, ny, _ = runs[i + 1]
            same = common(a[x + s : nx], b[y + s : ny])
            gain.append(ends[-1] + same - cost * (max(nx - x - s, ny - y - s) - same))
    out, todo = [], [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        starts: list[int] = []
        for i in range(lo, hi):
            if not starts or gain[i] < gain[starts[-1]]:
                starts.append(i)
        best = (0, lo, lo)
        for j in range(hi - 1, lo - 1, -1):
            while starts and ends[j] >= gain[starts[-1]] - 1e-9:
                i = starts.pop()
                if i <= j:
                    best = max(best, (runs[j][0] + runs[j][2] - runs[i][0], i, j))
        n, i, j = best
        # A short stretch may still grow to enough words at its ends.
        if n < max(1, least // 2):
            continue
        grown = align(a, b, runs[i : j + 1])
        if not enough(grown):
            (x, y, _), (u, v, s) = runs[i], runs[j]
            at = align(a[x : u + s], b[y : v + s], [(p - x, q - y, r) for p, q, r in runs[i : j + 1]])
            grown = (at[0] + x, at[1] + x, at[2] + y, at[3] + y, at[4])
        if grown[1] - grown[0] >= least:
            out.append(grown)
        todo += [(lo, i), (j + 1, hi)]
    return out


def contested(docs: DataFrame) -> DataFrame:
    """(doc_id, th): the ids that rows with different texts share, with the hash of the text that takes part, the smallest one."""
    return written(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).groupBy("doc_id").agg(F.min("th").alias("th"), F.max("th").alias("top")).where("th < top").select("doc_id", "th"))


def _one_text(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text and __in: whether the text takes part."""
    both = joined(docs, shared.select(F.col("doc_id").alias("__id"), F.col("th").alias("__only")), F.col("doc_id").cast("long") == F.col("__id"), "left")
    return both.withColumn("__in", F.col("__only").isNull() | (F.col("__only") == F.xxhash64("text"))).drop("__id", "__only")


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, at, first): the minimizers of each whole text; ``first`` marks a seed's first place in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for lo, _, texts in text_slices(b["text"]):
                got: list[list[np.ndarray]] = [[], [], [], []]
                for i, text in enumerate(texts, lo):
                    h = hashes.of(words_of(text))
                    at = minimizers(h)
                    seed = windows(h, K)[at] if len(at) else np.empty(0, np.uint64)
                    first = np.zeros(len(at), bool)
                    first[np.unique(seed, return_index=True)[1]] = True
                    for g, v in zip(got, (seed.view(np.int64), np.full(len(at), ids[i]), at.astype(np.int32), first)):
                        g.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)) for g in got], ["seed", "doc_id", "at", "first"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), "seed long, doc_id long, at int, first boolean")


def chains(docs: DataFrame) -> DataFrame:
    """(doc_id, other_id, anchors): chains of each text with earlier ones. Only rows of one document are held at a time."""
    s = written(seeds(docs))  # read twice; as a plan it would be made twice
    heads = s.groupBy("seed").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("top"), F.min_by("at", F.expr("CASE WHEN first THEN doc_id END")).alias("other_at")).where("other_id < top")
    # Stored, so that a seed that very many texts hold is a skewed side of a plain join, which can be split.
    heads = written(heads.select("seed", "other_id", "other_at"))
    matches = s.select("seed", "doc_id", "at").join(heads.hint("merge"), "seed").where("doc_id <> other_id")
    dealt = matches.select("doc_id", "other_id", "at", "other_at").repartition("doc_id").sortWithinPartitions("doc_id", "other_id", "at", "other_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            edges = np.r_[0, cut, len(cols[0])]
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip(edges[:-1], edges[1:]):
                for c in chain(cols[2][lo:hi].astype(np.int64), cols[3][lo:hi].astype(np.int64)):
                    out[0].append(int(cols[0][lo]))
                    out[1].append(int(cols[1][lo]))
                    out[2].append([v for a in c for v in a])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["doc_id", "other_id", "anchors"])

        for b in batches:
            if not len(b):
                continue
            cols = [c.to_numpy() for c in b.columns]
            # The last document of a batch may go on in the next.
            whole = int(np.searchsorted(cols[0], cols[0][-1])) if cols[0][0] != cols[0][-1] else 0
            if whole or (held and held[-1][0][-1] != cols[0][0]):
                if whole:
                    held.append([c[:whole] for c in cols])
                    yield from close()
                    held = [[c[whole:] for c in cols]]
                else:
                    yield from close()
                    held = [cols]
            else:
                held.append(cols)
        if held:
            yield from close()

    return dealt.mapInArrow(freed(run), "doc_id long, other_id long, anchors array<int>")


def aligned(docs: DataFrame, found: DataFrame, least: int = CHAIN, identity: float = IDENTITY) -> DataFrame:
    """Chains, or their parts, as passages: doc_id, other_id, start, end, other_start, other_end (words, ends beyond), n_same, identity.

    Only the words around a chain are moved: each side's document is read once,
    cut, and the two cuts of a chain meet by its number.
    """
    c = written(found.withColumn("id", F.xxhash64("doc_id", "other_id", "anchors")))
    asks = c.select("id", F.lit(0).alias("side"), F.col("doc_id").alias("of"), F.greatest(F.lit(0), F.element_at("anchors", 1) - MARGIN).alias("lo"), (F.element_at("anchors", -3) + F.element_at("anchors", -1) + MARGIN).alias("hi")).union(
        c.select("id", F.lit(1), "other_id", F.greatest(F.lit(0), F.element_at("anchors", 2) - MARGIN), F.element_at("anchors", -2) + F.element_at("anchors", -1) + MARGIN)
    )
    wanted = written(asks.select(F.col("of").alias("doc_id")).distinct())
    texts = joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), wanted, "doc_id", "left_semi")
    # A document's asks come together, about so many to a row: its text is moved once for each such row, not for each ask.
    n = asks.groupBy("of").agg(F.ceil(F.count("*") / ASKS).alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("id", "side"), F.coalesce("n", F.lit(1)))
    lists = joined(asks, written(n), "of", "left").withColumn("part", part).groupBy("of", "part").agg(F.collect_list(F.struct("id", "side", "lo", "hi")).alias("asks"))
    cuts = texts.withColumnRenamed("doc_id", "of").join(lists, "of").select("asks", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        out: list[tuple] = []

        def made_so_far() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["id", "side", "lo", "words"])

        for b in batches:
            for i in range(len(b)):
                h = (hashes.of(words_of(b["text"][i].as_py())) >> np.uint64(32)).astype(np.uint32)
                for k in b["asks"][i].as_py():
                    out.append((k["id"], k["side"], k["lo"], h[k["lo"] : k["hi"]].tobytes()))
                    if len(out) == ASKS:
                        yield made_so_far()
        if out:
            yield made_so_far()

    made = cuts.mapInArrow(freed(cut), "id long, side int, lo int, words binary")
    stored = written(made)
    one = stored.where("side = 0").select("id", F.col("lo").alias("la"), F.col("words").alias("wa")).dropDuplicates(["id"])
    two = stored.where("side = 1").select("id", F.col("lo").alias("lb"), F.col("words").alias("wb")).dropDuplicates(["id"])
    pairs = c.join(one, "id").join(two, "id").select("doc_id", "other_id", "anchors", "la", "wa", "lb", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ASKS) for b in batches for i in range(0, len(b), ASKS)):
            rows, of = [], []
            for k, r in enumerate(batch.select(["anchors", "la", "wa", "lb", "wb"]).to_pylist()):
                v, la, lb = r["anchors"], r["la"], r["lb"]
                for s, e, t, u, same in parts(np.frombuffer(r["wa"], np.uint32), np.frombuffer(r["wb"], np.uint32), [(v[i] - la, v[i + 1] - lb, v[i + 2]) for i in range(0, len(v), 3)], least, identity):
                    rows.append((s + la, e + la, t + lb, u + lb, same, same / max(1, e - s, u - t)))
                    of.append(k)
            cols = list(zip(*rows)) if rows else [()] * 6
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(of), batch["other_id"].take(of), *[pa.array(x, pa.int32()) for x in cols[:5]], pa.array(cols[5], pa.float64())],
                ["doc_id", "other_id", "start", "end", "other_start", "other_end", "n_same", "identity"],
            )

    return pairs.mapInArrow(freed(run), "doc_id long, other_id long, start int, end int, other_start int, other_end int, n_same int, identity double")


def passages(docs: DataFrame, words: int = PASSAGE, least: int = CHAIN, identity: float = IDENTITY) -> DataFrame:
    """Passages of at least ``words`` words that an earlier document holds, one row per passage and earlier document.

    doc_id, other_id, start, end, other_start, other_end, n_same, identity, and
    run_start and run_end: the stretch of the text that adjoining passages cover
    together, which has at least ``words`` words. Words are split at white space
    and compared in lower case. The earliest document (smallest doc_id) of a
    passage is the other of the later ones. Rows without doc_id or text take no
    part; of rows that repeat a doc_id with different texts that of the smallest
    hash takes part; repeated rows count once. An empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    shared = contested(docs)
    if shared.limit(1).count():
        docs = _one_text(docs, shared).where("__in").select("doc_id", "text")
    good = aligned(docs, chains(docs), least, identity).where((F.col("identity") >= identity) & (F.col("end") - F.col("start") >= least))
    w = Window.partitionBy("doc_id").orderBy("start", "end", "other_id", "other_start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = good.withColumn("new", F.when(before.isNull() | (F.col("start") > before + 3), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    r = Window.partitionBy("doc_id", "run")
    runs = opened.withColumn("run_start", F.min("start").over(r)).withColumn("run_end", F.max("end").over(r))
    return runs.where(F.col("run_end") - F.col("run_start") >= words).drop("new", "run")


def without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__row, text, __spans) to (__row, text, gone): texts without their spans of words; gone marks those that lose all.

    Rows go out in slices of bounded size, and only the texts that have spans become Python strings.
    """
    import re

    import pyarrow.compute as pc

    word = re.compile(r"\S+")

    def left_of(text: str, spans: list[dict]) -> str | None:
        places = [m.span() for m in word.finditer(text)]
        at, kept = 0, []
        for s in spans:
            lo, hi = s["run_start"], min(s["run_end"], len(places))
            if lo >= hi:
                continue
            kept.append(text[at : places[lo][0]])
            at = places[hi][0] if hi < len(places) else len(text)
        kept.append(text[at:])
        return "".join(kept).strip() or None

    for batch in batches:
        for lo, hi in slices(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
            b = batch.slice(lo, hi - lo)
            text, spans = b["text"], b["__spans"]
            has = pc.and_(text.is_valid(), pc.greater(pc.fill_null(pc.list_value_length(spans), 0), 0))
            left = pa.array([left_of(text[i].as_py(), spans[i].as_py()) for i in np.flatnonzero(has)], text.type)
            text = pc.replace_with_mask(text, has, left)
            yield pa.RecordBatch.from_arrays([b["__row"], text, pc.and_(has, text.is_null())], ["__row", "text", "gone"])


def repeated_removed(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from the later documents; a text that loses all its words goes as a row.

    n_chars, if there is one, is set to the new length. Rows without doc_id or
    text stay as they are, as do texts that don't take part (see ``passages``).
    """
    spans = passages(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("run_start", "run_end"))).alias("__spans"))
    spans = written(spans)
    columns = docs.columns
    shared = contested(docs)
    both = joined(docs, spans.withColumnRenamed("doc_id", "__of"), F.col("doc_id").cast("long") == F.col("__of"), "left")
    if shared.limit(1).count():
        both = _one_text(both, shared).withColumn("__spans", F.when(F.col("__in"), F.col("__spans")))
    names = [c for c in columns if c != "text"]
    packed = both.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "text", "__spans")

    row = packed.schema["__row"].dataType.simpleString()
    cut = packed.mapInArrow(freed(without_spans), f"__row {row}, text string, gone boolean").where("not gone")
    made = cut.select("__row.*", "text")
    if "n_chars" in columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(f"`{c}`") for c in columns])
