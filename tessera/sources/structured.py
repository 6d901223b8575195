"""Structured exports (CSV) as observations."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.constants import COLUMN_ALIASES, CONFIDENCE

OBSERVATION = "record_id string, field_path string, raw_value string, normalized_value string, source struct<source_type:string,source_id:string,locator:string>, method string, confidence double"
DIAGNOSTIC = "source_id string, row long, seq int, message string"

#: field -> (name of the normalizer in method strings, whether a cell may hold several values, what a warning calls it)
FIELDS = {
    "candidate_ref": ("normalize_candidate_ref", False, None),
    "full_name": ("normalize_name", False, None),
    "emails": ("normalize_email", True, "email"),
    "application.id": ("normalize_application_ref", False, None),
    "application.applied_at": ("normalize_application_time", False, "application time"),
    "phones": ("normalize_phone", True, "phone"),
    "experience.company": ("normalize_company", False, None),
    "experience.title": ("normalize_text", False, None),
    "experience.start": ("normalize_experience_date", False, "experience start date"),
    "experience.end": ("normalize_experience_date", False, "experience end date"),
    "links.github": ("normalize_github_url", False, "GitHub URL"),
}


def header_name(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", (text or "").strip().lower()).strip("_")


def quoted(c: Column) -> Column:
    """A value as it is shown in messages."""
    plain = F.concat(F.lit("'"), c, F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(plain)


def _normalized(field: str, c: Column, region: str | None) -> Column:
    return {
        "candidate_ref": N.candidate_ref, "full_name": N.name, "emails": N.email_any, "application.id": N.candidate_ref, "application.applied_at": N.application_time,
        "phones": lambda x: N.phone(x, region), "experience.company": lambda x: N.company(x, fold=True), "experience.title": N.name,
        "experience.start": N.experience_date, "experience.end": lambda x: N.experience_date(x, True), "links.github": N.github_url,
    }[field](c)


def _tagged(seq: int, field: str, column: Column):
    return lambda p: F.struct(F.lit(seq).alias("seq"), F.lit(field).alias("field_path"), column.alias("column"), p.alias("raw"))


def claims(rows: DataFrame, header: list[str], source_id: str, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, diagnostics) of rows with columns row, _c0, _c1, ... under a header (original names, by place).

    The last of equal headers counts; of a field's aliases the first whose cell
    means something. Invalid cells become diagnostics in the order of row and field.
    """
    lookup = {header_name(h): (i, h) for i, h in enumerate(header)}
    items = []
    for seq, (field, (_, several, _)) in enumerate(FIELDS.items()):
        own = [lookup[a] for a in COLUMN_ALIASES[field] if a in lookup]
        if not own:
            continue
        cells = [N.clean_cell(F.col(f"_c{i}")) for i, _ in own]
        value = F.coalesce(*cells)
        column = F.coalesce(*[F.when(c.isNotNull(), F.lit(h)) for c, (_, h) in zip(cells, own)])
        parts = F.filter(F.transform(F.split(value, "[;,]"), N.strip), lambda x: x != "") if several else F.array(value)
        some = F.coalesce(F.when(value.isNotNull(), parts), F.array().cast("array<string>"))
        items.append(F.transform(some, _tagged(seq, field, column)))
    if not items:
        spark = rows.sparkSession
        return spark.createDataFrame([], OBSERVATION), spark.createDataFrame([], DIAGNOSTIC)
    long = rows.select("row", F.posexplode(F.concat(*items)).alias("pos", "x")).select("row", "pos", "x.*").where("raw is not null")
    norm = reduce(lambda acc, f: F.when(F.col("field_path") == f, _normalized(f, F.col("raw"), region)).otherwise(acc), FIELDS, F.lit(None).cast("string"))
    pick = lambda f: F.element_at(F.create_map(*[F.lit(x) for k in FIELDS for x in (k, f(k))]), F.col("field_path"))
    long = long.withColumn("norm", norm)
    seen = long.where("norm is not null").select(
        F.concat(F.lit(f"recruiter_csv:{source_id}:row="), "row").alias("record_id"), "field_path", F.col("raw").alias("raw_value"), F.col("norm").alias("normalized_value"),
        F.struct(F.lit("recruiter_csv").alias("source_type"), F.lit(source_id).alias("source_id"), F.concat(F.lit("row="), "row", F.lit(",column="), "column").alias("locator")).alias("source"),
        F.concat(F.lit("csv_column:"), "column", F.lit(" -> "), pick(lambda k: FIELDS[k][0])).alias("method"), pick(lambda k: CONFIDENCE["recruiter_csv"][k]).alias("confidence"),
    )
    named = {k: v[2] for k, v in FIELDS.items() if v[2]}
    local = (F.col("field_path") == "phones") & F.lit(region is None) & ~F.col("raw").startswith("+")
    what = F.when(local, "Local phone requires an explicit region").otherwise(F.concat(F.lit("Invalid "), pick(lambda k: named.get(k, k))))
    bad = long.where(F.col("norm").isNull() & F.col("field_path").isin(list(named)))
    bad = bad.select(F.lit(source_id).alias("source_id"), F.col("row").cast("long").alias("row"), F.col("pos").cast("int").alias("seq"), F.concat(what, F.lit(" at row="), "row", F.lit(", column="), "column", F.lit(": "), quoted(F.col("raw"))).alias("message"))
    return seen, bad


def read_csv(spark: SparkSession, path: str, source_id: str | None = None, region: str | None = None) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """(observations, diagnostics, warnings, errors) of a file with a header; rows are numbered from 2.

    Cells may span lines, so a file is read by one task; many files are read side by side.
    """
    empty = spark.createDataFrame([], OBSERVATION), spark.createDataFrame([], DIAGNOSTIC)
    if not os.path.exists(path):
        return *empty, [], [f"CSV file does not exist: {path}"]
    if os.path.isdir(path):
        return *empty, [], [f"CSV path is a directory, not a file: {path}"]
    source_id = source_id or os.path.realpath(path)
    raw = spark.read.options(header=False, multiLine=True, escape='"', quote='"', mode="PERMISSIVE", encoding="UTF-8").csv(os.path.abspath(path))
    if not raw.columns:
        return *empty, [f"CSV file has no header row: {path}"], []
    numbered = raw.withColumn("row", F.monotonically_increasing_id() + 1)
    first = numbered.where("row = 1").first()
    if first is None:
        return *empty, [f"CSV file has no header row: {path}"], []
    header = [(v or "").lstrip("﻿") for v in first[: len(raw.columns)]]
    seen, bad = claims(numbered.where("row > 1"), header, source_id, region)
    return seen, bad, [], []
