"""What the corpus operators share: scratch tables, bounded text batches, word hashing.

Rules that all operators of this package follow
------------------------------------------------
* Input columns are read by name and projected first, so extra columns (of any
  name) pass by without a clash.
* A null text counts as an empty text. A null id is an id of its own kind: such
  rows are processed and keep their null.
* Intermediate tables are parquet folders below ``spark.checkpoint.dir``, which
  every executor can reach; the setting is read from the session and set only
  where it is unset.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns over at once (a longer text goes alone).
SLICE_CHARS = 2_000_000
#: Entries of a per-worker word cache before it starts anew.
CACHE_ENTRIES = 400_000


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Delete the scratch tables of this driver; results that still read them must be stored before."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            return


atexit.register(drop_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(lengths: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` in length together, or one row."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first, end, texts) for slices of a column of bounded size: only one slice's texts are Python strings at a time."""
    import pyarrow.compute as pc

    for lo, hi in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def freed(run: Callable) -> Callable:
    """``run`` (batches -> batches) that gives memory back to the system at its end: Python workers live on for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def map_texts(df: DataFrame, ids: list[str], schema: str, make: Callable, text: str = "text") -> DataFrame:
    """``make()`` gives, once per task, a function (texts) -> dict of columns; ids are carried along.

    Rows are handed over in slices of bounded size, in order, one output row per
    row. The text may itself be one of the ids: it is sent once then.
    """
    own = text in ids and dict(df.dtypes)[text] == "string"
    want = df.select(*[F.col(f"`{c}`") for c in ids], *([] if own else [F.col(f"`{text}`").cast("string").alias("__text")]))
    fields = ", ".join(f"`{n}` {t}" for n, t in (want.dtypes if own else want.dtypes[:-1]))
    full = f"{fields}, {schema}" if fields else schema
    arrow = _arrow_schema(df.sparkSession, full)
    at = ids.index(text) if own else len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for lo, hi, texts in text_slices(b.column(at)):
                out = f(texts)
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(ids))]
                cols += [v if isinstance(v := out[n], pa.Array) else pa.array(v, arrow.field(n).type, from_pandas=False) for n in arrow.names[len(ids):]]
                yield pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(cols, arrow.types)], schema=arrow)

    return want.mapInArrow(freed(run), full)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Remembered(dict):
    """key -> make(key), remembered in two generations: what is used stays, what isn't goes; memory is bounded."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES, longest: int = 48):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries // 2, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def turn(self) -> None:
        """Call between texts: starts a new generation when this one is full."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


def _hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class WordHashes(Remembered):
    """word -> 64-bit hash; the same in every process."""

    def __init__(self):
        super().__init__(_hash_of)

    def of(self, words: list[str]) -> np.ndarray:
        self.turn()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words; one hash of all where there are fewer, none of no words."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    odd = np.uint64(_ODD)
    # Runs of 1, 2, 4, ... words are hashed from halves; those of k's binary digits are put together.
    level, size, out, have = mix(h), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                m = n - have - size + 1
                out = level[:m] if out is None else mix(out[:m] * odd + level[have : have + m])
                have += size
            if 2 * size > k:
                return out
            level = mix(level[:-size] * odd + level[size:])
            size *= 2


def words_of(text: str) -> list[str]:
    """The words of the near-duplicate operators: lower case, split at white space."""
    return text.lower().split()


#: Rows of ids (a few dozen bytes each) up to which a side is sent to every executor; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def joined(df: DataFrame, small: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """``df`` joined with a written table of short rows: without moving ``df`` while the table's counted size allows it."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)
