"""Near duplicates by ProbMinHash: probability Jaccard of weighted word shingles, banding, verification.

Each shingle of five words, weighted by its count, is a Poisson process whose
arrivals, at a rate of its weight, fall into random registers; a register keeps
the shingle that arrives first. Two texts agree in a register with a
probability equal to the probability Jaccard similarity of their weights (for
texts without repeated shingles that is the plain Jaccard similarity). A
process ends when its next arrival is later than every register's, so most
shingles are looked at once.

Registers are banded; texts that share a band are candidates, and candidates of
candidates form groups. In a group every text meets every other that it isn't
joined with yet, by the exact similarity of whole texts, so no link between two
texts that share a band is lost; what a task puts out are joining links, never
all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, joined, map_texts, mix, slices, windows, words_of, written
from tessera.operators.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: At a similarity of 0.8 a pair shares no band with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Shingles whose arrivals are drawn together (a text of more goes alone).
SHINGLES = 1 << 16
#: Texts of a group that one task lays out against as many others.
BLOCK = 1024


def weighted(text: str, hashes: WordHashes, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text and their counts. Fewer than k words make one shingle; none, none."""
    got, n = np.unique(windows(hashes.of(words_of(text)), k), return_counts=True)
    return got, n.astype(float)


def registers(shingles: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    """ProbMinHash of each weighted set: m registers with the first arriving shingle; 0 everywhere for an empty set."""
    d = len(shingles)
    item = np.concatenate(shingles) if d else np.empty(0, np.uint64)
    rate = np.concatenate(weights) if d else np.empty(0)
    row = np.repeat(np.arange(d), [len(s) for s in shingles])
    first = np.full(d * m, np.inf)
    out = np.zeros(d * m, np.uint64)
    at = np.zeros(len(item))
    step = 0
    with np.errstate(over="ignore"):
        while len(item):
            step += 1
            h = mix(item + np.uint64((step * 0xD1342543DE82EF95) & (1 << 64) - 1))
            at = at - np.log(((h >> np.uint64(16)).astype(float) + 1) * 2.0**-48) / rate
            cell = row * m + ((h & np.uint64(0xFFFF)) * np.uint64(m) >> np.uint64(16)).astype(np.int64)
            new = np.flatnonzero(at < first[cell])
            np.minimum.at(first, cell[new], at[new])
            new = new[at[new] == first[cell[new]]]
            out[cell[new]] = item[new]
            go = at < first.reshape(d, m).max(1)[row]  # early termination
            item, rate, row, at = item[go], rate[go], row[go], at[go]
    return out.reshape(d, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (shingles sorted): the sum over common i of 1 / sum_j max(a_j/a_i, b_j/b_i)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    ratio = np.full(len(every), np.inf)
    np.divide(y, x, out=ratio, where=x > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # Of a place i, those of a ratio not above its own count as a_j/a_i, the others as b_j/b_i.
    upto = np.searchsorted(ratio, ratio, side="right")
    cx, cy = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(y)]
    both = (x > 0) & (y > 0)
    i = np.flatnonzero(both)
    return float((1 / (cx[upto[i]] / x[i] + (cy[-1] - cy[upto[i]]) / y[i])).sum())


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (hash of the words), bands (array of hashes; null without words)."""

    def make():
        hashes = WordHashes()

        def batch(texts: list[str]) -> dict:
            import xxhash

            sets, nodes = [], []
            for t in texts:
                words = words_of(t)
                h = hashes.of(words)
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                got, n = np.unique(windows(h, SHINGLE), return_counts=True)
                sets.append((got, n.astype(float)))
            parts = [sets[lo:hi] for lo, hi in slices([len(s[0]) for s in sets], SHINGLES)]
            sig = np.concatenate([registers([s[0] for s in p], [s[1] for s in p], bands * rows) for p in parts]).reshape(len(texts), bands, rows)
            with np.errstate(over="ignore"):
                band = np.zeros(sig.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            return {"node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "bands": [b if len(s[0]) else None for b, s in zip(band.view(np.int64), sets)]}

        return batch

    return map_texts(docs, ["doc_id"], "node long, bands array<long>", make)


def links_between(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]] | None, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs (i, j) of weighted sets of a and b (of a alone, i < j, if b is None) that reach the threshold: as many as
    join what is similar, fewer than all. Every pair that isn't joined yet is compared.

    One set is laid out and met by all others at once. The sum over common
    shingles of the smaller share of either set bounds the probability Jaccard
    from above; where no shingle is repeated it gives it exactly. Other pairs
    that the bound lets through are computed in full.
    """
    every = a if b is None else a + b
    first = 0 if b is None else len(a)
    full = [i for i in range(first, len(every)) if len(every[i][0])]
    if not full:
        return []
    ids, place = np.unique(np.concatenate([s[0] for s in every]), return_inverse=True)
    size = np.array([len(s[0]) for s in every])
    ends = np.cumsum(size)
    share = np.concatenate([s[1] / s[1].sum() if len(s[1]) else s[1] for s in every])
    plain = np.array([bool((s[1] == 1).all()) for s in every])
    lo = ends[first] - size[first]
    place_b, share_b = place[lo:], share[lo:]
    starts = (ends - size)[full] - lo
    of = np.array(full)
    parent = list(range(len(every)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    laid = np.zeros(len(ids))
    out = []
    for i in range(len(a)):
        if not size[i]:
            continue
        own = slice(ends[i] - size[i], ends[i])
        laid[place[own]] = share[own]
        met = laid[place_b]
        bound = np.add.reduceat(np.minimum(met, share_b), starts)
        common = np.add.reduceat((met > 0).astype(np.int64), starts)
        laid[place[own]] = 0
        exact = common / (size[i] + size[of] - common)
        both_plain = plain[of] & plain[i]
        near = np.where(both_plain, exact >= threshold - 1e-12, bound >= threshold - 1e-9)
        if b is None:
            near &= of > i
        for k in np.flatnonzero(near):
            j = int(of[k])
            x, y = find(i), find(j)
            if x != y and (both_plain[k] or similarity(every[i], every[j]) >= threshold - 1e-12):
                parent[max(x, y)] = min(x, y)
                out.append((i, j - first if b is not None else j))
    return out


def links_in_groups(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of nodes within each group of ``members`` (node, root); ``texts`` is (node, text), one row a node.

    A group is dealt into blocks of about ``block`` texts and every two blocks
    meet in one task, so the memory of a task is bounded whatever the group.
    """
    n = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    blocks = members.join(n, "root").withColumn("k", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = blocks.join(texts, "node").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("root", F.least("k", "o").alias("bi"), F.greatest("k", "o").alias("bj"), "k", "node", "text")

    def run(t: pa.Table) -> pa.Table:
        hashes = WordHashes()
        bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
        nodes, ks = t["node"].to_pylist(), t["k"].to_pylist()
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        left, right = [i for i in order if ks[i] == bi], [i for i in order if ks[i] == bj]
        a = [weighted(t["text"][i].as_py() or "", hashes) for i in left]
        b = None if bi == bj else [weighted(t["text"][i].as_py() or "", hashes) for i in right]
        got = links_between(a, b, threshold)
        return pa.table({"a": pa.array([nodes[left[i]] for i, _ in got], pa.int64()), "b": pa.array([nodes[right[j]] for _, j in got], pa.int64())})

    return dealt.groupBy("root", "bi", "bj").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), n_class, keeper (doc_id is class_id).

    Texts with the same words are one node whatever their case and white space;
    null, empty and wordless texts are equal to each other. A class is a
    component of nodes linked by a similarity of at least ``threshold``; a class
    whose rows all lack a doc_id has class_id null, and such texts are classed
    only with equal ones. Repeated rows keep their places; an empty table gives none.
    """
    sig = written(signatures(docs))
    nodes = sig.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands", ignorenulls=True).alias("bands"))
    buckets = written(nodes.where("bands is not null").select("node", "least", F.posexplode("bands").alias("band", "h")).select("node", "least", F.xxhash64("band", "h").alias("h")))
    # Buckets of one node are no business of anyone. The others tie their nodes to the smallest of them.
    shared = buckets.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    star = buckets.join(shared, "h").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tied = components(star)
    members = written(tied.union(tied.select("root", "root").distinct()))
    first = written(nodes.join(members.select("node"), "node", "left_semi").select("node", F.col("least").alias("doc_id")))
    # One text for each node that is compared, from the first document that has it.
    links = written(links_in_groups(members, _texts(docs, first), threshold))
    roots = components(links)
    of_node = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = of_node.groupBy("root").agg(F.min("least").alias("class_id"))
    of_node = of_node.join(named, "root").select("node", "class_id", "root")
    members = sig.select("doc_id", "node").join(of_node, "node")
    return members.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("keeper"))


def _texts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(node, text) for the wanted nodes: the ids are few words each, the texts are moved only where wanted."""
    found = joined(docs.select("doc_id", "text"), first.select("doc_id").distinct(), "doc_id", "left_semi")

    def make():
        hashes = WordHashes()

        def batch(texts: list[str]) -> dict:
            import xxhash

            return {"node": pa.array(np.array([xxhash.xxh3_64_intdigest(hashes.of(words_of(t)).tobytes()) for t in texts], np.uint64).view(np.int64)), "text": texts}

        return batch

    made = written(map_texts(found, [], "node long, text string", make))
    return made.dropDuplicates(["node"])


def near_duplicates_removed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest doc_id. Rows that repeat a doc_id count once."""
    decided = written(classes(docs, threshold).where("doc_id is not null"))
    drop = written(decided.where(~F.col("keeper")).select("doc_id").distinct())
    kept = joined(docs, drop, "doc_id", "left_anti")
    again = written(decided.where("keeper").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.limit(1).count():
        return kept
    once = joined(kept, again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return joined(kept, again, "doc_id", "left_anti").unionByName(once)


