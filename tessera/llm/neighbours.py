"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into
partitions of equal size with few edges across; a small classifier (one hidden
layer) learns to tell from a vector in which partitions its neighbours lie.
Every row is indexed under its most probable partition; a query is routed to
its several most probable ones and compared there with every row, exactly. How
many partitions a query visits is calibrated on the sample: as few as find
``TARGET`` of the true neighbours of held-out sample vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: The index is fitted on at most so many vectors, those with the smallest hashes of vec_id.
SAMPLE = 8192
#: Partitions: so many at least, one for about so many rows beyond that, and so many sample vectors in each at least.
PARTITIONS, PART_ROWS, PART_SAMPLE = 32, 4096, 64
NEIGHBOURS = 12
TARGET = 0.95
#: Rows and queries that meet in one task at most.
ROW_BLOCK, QUERY_BLOCK = 4096, 1024


def nearest(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k nearest rows of x for each row of q; ``own`` are rows to leave out."""
    out = np.empty((len(q), k), np.int64)
    n2 = (x * x).sum(1)
    for lo in range(0, len(q), 512):
        d = n2[None] - 2 * q[lo : lo + 512] @ x.T
        if own is not None:
            d[np.arange(len(d)), own[lo : lo + 512]] = np.inf
        out[lo : lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """A partition of the graph's nodes into equal parts: seeded by capacity-bound centroids, refined by moving
    nodes to the part that most of their neighbours (both ways) are in, the greatest gains first, while there is room.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    most = -(-n // parts)
    centre = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)

    def fill(gain: np.ndarray, room: int) -> np.ndarray:
        """Each node takes its best part with room left, nodes with the most to lose first."""
        order = np.argsort(-(np.partition(gain, -2, axis=1)[:, -1] - np.partition(gain, -2, axis=1)[:, -2]), kind="stable")
        wish = np.argsort(-gain, axis=1, kind="stable")
        left, got = np.full(parts, room), np.empty(n, np.int64)
        for i in order:
            for p in wish[i]:
                if left[p]:
                    left[p] -= 1
                    got[i] = p
                    break
        return got

    for _ in range(6):
        label = fill(2 * x @ centre.T - (centre * centre).sum(1), most)
        centre = np.stack([x[label == p].mean(0) if (label == p).any() else x[rng.integers(n)] for p in range(parts)])
    for _ in range(8):
        votes = np.zeros((n, parts))
        flat = np.repeat(np.arange(n), graph.shape[1])
        np.add.at(votes, (flat, label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), label[flat]), 1)
        votes[np.arange(n), label] += 0.5
        moved = fill(votes, int(most * 1.05) + 1)
        if (moved == label).all():
            break
        label = moved
    return label


@dataclass(frozen=True)
class Router:
    """The fitted classifier; ``probes`` partitions are visited by a query."""

    mean: np.ndarray
    scale: float
    layers: tuple[np.ndarray, ...]
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(((x - self.mean) / self.scale) @ a + b, 0) @ c + d


def fit(x: np.ndarray, parts: int = PARTITIONS, target: float = TARGET, hidden: int = 128, epochs: int = 30, seed: int = 1) -> Router:
    """The router of a sample. With fewer vectors than a few for each partition there is one partition."""
    rng = np.random.default_rng(seed)
    every, dim = x, x.shape[1]
    # What the calibration asks for is kept out of the fit.
    order = rng.permutation(len(x))
    ask, x = order[: min(1024, len(x) // 8)], x[order[min(1024, len(x) // 8) :]]
    n = len(x)
    parts = max(1, min(parts, n // 16))
    mean, scale = x.mean(0), float(x.std()) or 1.0
    if parts == 1:
        return Router(mean, scale, (np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    z = (x - mean) / scale
    k = min(NEIGHBOURS, n - 1)
    graph = nearest(z, z, k, np.arange(n))
    label = balanced(z, graph, parts, seed)
    aim = np.zeros((n, parts))
    np.add.at(aim, (np.repeat(np.arange(n), k), label[graph.ravel()]), 1 / (k + 1))
    aim[np.arange(n), label] += 1 / (k + 1)
    w = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 3e-3 * (1 - epoch / epochs)
        for lo in range(0, n, 256):
            b = order[lo : lo + 256]
            h = np.maximum(z[b] @ w[0] + w[1], 0)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - aim[b]) / len(b)
            gh = (g @ w[2].T) * (h > 0)
            grads = [z[b].T @ gh + 1e-4 * w[0], gh.sum(0), h.T @ g + 1e-4 * w[2], g.sum(0)]
            t += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    draft = Router(mean, scale, tuple(w), 1)
    # Calibration: where do the neighbours of vectors that the fit hasn't seen lie in the routes of these?
    true = nearest(every, every[ask], min(10, len(every) - 1), ask)
    logits = draft.logits(every)
    home = logits.argmax(1)
    rank = np.empty((len(ask), parts), np.int64)
    np.put_along_axis(rank, np.argsort(-logits[ask], axis=1), np.arange(parts)[None], axis=1)
    depth = np.take_along_axis(rank, home[true], axis=1)
    share = np.cumsum(np.bincount(depth.ravel(), minlength=parts)) / depth.size
    return Router(mean, scale, tuple(w), int(np.searchsorted(share, target) + 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of rows that take part: an id, no null or non-finite component, not all zero."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(finite)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, every: int = 100, k: int = 10, parts: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """The k nearest rows found for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without vec_id or with another number of components than
    most of the sample. Candidates are all rows whose vec_id isn't the query's;
    ties go to the smaller vec_id; a vec_id that is repeated is found as often
    as it has rows, and asks as often, each row with its own ranks. An empty
    table gives an empty result. ``parts`` grows with the table unless given.
    """
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not len(drawn):
        return spark.createDataFrame([], out_schema)
    sizes = drawn["v"].combine_chunks().value_lengths().to_numpy()
    dim = int(np.bincount(sizes).argmax())
    if parts is None:
        parts = max(PARTITIONS, min(rows.count() // PART_ROWS, len(drawn) // PART_SAMPLE))
    router = fit(_matrix(drawn["v"].combine_chunks().filter(pa.array(sizes == dim))), parts, target)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(-router.logits(_matrix(b["v"])), axis=1, kind="stable").astype(np.int32)
            asks = b["vec_id"].to_numpy() % every == 0
            probes = pa.array([o[: router.probes] if a else None for o, a in zip(order, asks)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(order[:, 0]), probes], ["vec_id", "v", "part", "probes"])

    routed = written(rows.where(F.size("v") == dim).mapInArrow(route, "vec_id long, v array<double>, part int, probes array<int>").withColumn("row", F.monotonically_increasing_id()))
    held = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # as many rows as partitions
    asks = routed.where(F.col("probes").isNotNull()).select(F.col("vec_id").alias("query_id"), "row", "v", F.explode("probes").alias("part"))
    asked = {r["part"]: r["n"] for r in asks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    row_blocks = {p: -(-n // ROW_BLOCK) for p, n in held.items()}
    query_blocks = {p: -(-n // QUERY_BLOCK) for p, n in asked.items()}

    def of(counts: dict, default: int):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in ({-1: 0} | counts).items() for x in kv]), F.col("part")), F.lit(default))

    def dealt(df: DataFrame, key: str, own: dict, other: dict, mine: str, theirs: str) -> DataFrame:
        """Each row in one block of its own kind, repeated for the blocks of the other kind that it has to meet."""
        return df.withColumn(mine, F.pmod(F.xxhash64(key), of(own, 1)).cast("int")).withColumn("_n", of(other, 0)).where("_n > 0").withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    left = dealt(routed.select("part", "row", "vec_id", "v"), "row", row_blocks, query_blocks, "rb", "qb")
    right = dealt(asks, "row", query_blocks, row_blocks, "qb", "rb")

    def compare(rows_: pa.Table, queries_: pa.Table) -> pa.Table:
        ids, x = rows_["vec_id"].to_numpy(), _matrix(rows_["v"])
        got: list[tuple[np.ndarray, ...]] = []
        for q, row, y in zip(queries_["query_id"].to_numpy(), queries_["row"].to_numpy(), _matrix(queries_["v"])):
            if not len(ids):
                break
            d = np.sqrt(((x - y) ** 2).sum(1))
            d[ids == q] = np.inf
            near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
            near = near[np.isfinite(d[near])]
            near = near[np.lexsort((ids[near], d[near]))][:k]
            got.append((np.full(len(near), q), np.full(len(near), row), ids[near], d[near]))
        cols = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "row", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    key = ["part", "rb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("query_id", "row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
