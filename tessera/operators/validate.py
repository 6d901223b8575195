"""Constraints of the canonical record that its type doesn't enforce, as columns of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scratch import stored

STATUSES = ["resolved", "ambiguous", "unstructured_only", "missing"]


def _messages(*conditions: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(bad, text) for bad, text in conditions]), lambda x: x.isNotNull())


def between_errors(c: Column, path: str) -> Column:
    """Messages for a number outside 0 to 1."""
    shown = c.cast("string")
    return _messages(
        (c.isNull(), F.lit(f"{path}: None is not of type 'number'")),
        (c < 0, F.concat(F.lit(f"{path}: "), shown, F.lit(" is less than the minimum of 0"))),
        (c > 1, F.concat(F.lit(f"{path}: "), shown, F.lit(" is greater than the maximum of 1"))),
    )


def unique_errors(c: Column, path: str) -> Column:
    return _messages((F.size(F.array_distinct(c)) < F.size(c), F.lit(f"{path}: has non-unique elements")))


def enum_errors(c: Column, path: str, values: list[str] = STATUSES) -> Column:
    return _messages((~F.coalesce(c.isin(values), F.lit(False)), F.concat(F.lit(f"{path}: '"), F.coalesce(c, F.lit("None")), F.lit(f"' is not one of {values!r}"))))


def _each(column: str, item) -> Column:
    return F.flatten(F.transform(F.col(column), lambda x, i: item(x, i)))


def _item_confidence(column: str) -> Column:
    def item(x: Column, i: Column) -> Column:
        c = x["confidence"]
        where = F.concat(F.lit(f"$.{column}["), i.cast("string"), F.lit("].confidence: "), F.coalesce(c.cast("string"), F.lit("None")))
        return F.filter(F.array(F.when(c > 1, F.concat(where, F.lit(" is greater than the maximum of 1"))), F.when(c < 0, F.concat(where, F.lit(" is less than the minimum of 0")))), lambda e: e.isNotNull())

    return _each(column, item)


def errors(candidates: DataFrame) -> Column:
    """All messages of a canonical record, in a fixed order of paths."""
    parts = [_messages((F.coalesce(F.length("candidate_id"), F.lit(0)) < 1, F.lit("$.candidate_id: '' should be non-empty")))]
    for k in ("email", "phone"):
        parts += [between_errors(F.col(f"{k}_confidence"), f"$.{k}_confidence"), _item_confidence(f"{k}_details"), enum_errors(F.col(f"{k}_resolution_status"), f"$.{k}_resolution_status"), unique_errors(F.col(f"{k}s"), f"$.{k}s"), unique_errors(F.col(f"secondary_{k}s"), f"$.secondary_{k}s")]
    parts += [_item_confidence(c) for c in ("experience", "provenance", "skills")]
    parts += [unique_errors(F.col("links.other"), "$.links.other"), between_errors(F.col("overall_confidence"), "$.overall_confidence")]
    parts.append(_messages((F.col("years_experience") < 0, F.concat(F.lit("$.years_experience: "), F.col("years_experience").cast("string"), F.lit(" is less than the minimum of 0")))))
    return F.array_sort(F.flatten(F.array(*parts)))


def validated(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates without errors, (candidate_id, message) of the others). The candidates are stored once for both."""
    candidates = stored(candidates)
    judged = candidates.withColumn("__errors", errors(candidates))
    bad = judged.where(F.size("__errors") > 0).select("candidate_id", F.explode("__errors").alias("message"))
    return judged.where(F.size("__errors") == 0).drop("__errors"), bad


def checked(observations: DataFrame) -> DataFrame:
    """``observations``; reading one whose confidence is missing or beyond 0 to 1 fails."""
    c = F.col("confidence")
    wrong = F.raise_error(F.lit("confidence must be between 0.0 and 1.0")).cast("double")
    return observations.withColumn("confidence", F.when(c.between(0.0, 1.0), c).otherwise(wrong))
