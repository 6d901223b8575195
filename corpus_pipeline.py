"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lines, minhash, packing, passages, quality
from tessera.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker rejects go."""
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    scored = quality.scored(docs.select(row.alias("__row"), "doc_id", "text"), ranker, ["__row", "doc_id", "text"])
    every = scored.where("predicted = 1").select("__row.*", "text")
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of lines are cut out; documents of which nothing is left go."""
    return lines.stage(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.near_duplicates_removed(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents of which nothing is left go."""
    return passages.repeated_removed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places."""
    import public_tokenizers

    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("row")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", passage_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The models and alignments of the stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
