"""The whole plan: sources, resolution, fusion, validation, projection, and the output document."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fuse import fuse
from tessera.operators.project import assemble, config_errors, project
from tessera.operators.resolve import resolve
from tessera.operators.scratch import stored
from tessera.operators.validate import checked, validated
from tessera.sources import notes as notes_source
from tessera.sources import profile as profile_source
from tessera.sources.structured import OBSERVATION, read_csv


@dataclass
class Result:
    """What a run gives: lazy tables, and the messages of all steps in order."""

    observations: DataFrame | None = None
    clusters: DataFrame | None = None
    candidates: DataFrame | None = None
    projected: list[dict] | None = None
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def run(
    spark: SparkSession,
    csv_paths: list[str] = (),
    note_paths: list[str] = (),
    profile_urls: list[str] = (),
    note_refs: dict[str, str] | None = None,
    config: dict | None = None,
    region: str | None = None,
    captured: DataFrame | None = None,
    fetch: Callable | None = None,
    enrich: bool = False,
) -> Result:
    """Read all sources, resolve, fuse, validate and project.

    A config is checked before anything is read. Notes take references by full
    path, then by file name. Profiles come from ``captured`` payloads and, for
    other urls, from ``fetch`` (``profile.http_fetch`` reads them over HTTP);
    without either a profile url is a claim alone.
    """
    out = Result()
    if config is not None and (problems := config_errors(config)):
        out.errors += problems
        return out
    parts: list[DataFrame] = []
    for p in csv_paths:
        seen, bad, warnings, errors = read_csv(spark, p, region=region)
        parts.append(seen)
        out.warnings += [r.message for r in bad.orderBy("row", "seq").collect()] + warnings
        out.errors += errors
    refs, texts = note_refs or {}, []
    by_name = {os.path.basename(k): v for k, v in refs.items()}
    for p in note_paths:
        text, warnings, errors = notes_source.read_note(p)
        out.warnings += warnings
        out.errors += errors
        if text is not None:
            texts.append((os.path.realpath(p), text, refs.get(os.path.realpath(p), refs.get(p, by_name.get(os.path.basename(p))))))
    if texts:
        seen, bad = notes_source.note_claims(spark.createDataFrame(texts, "source_id string, text string, candidate_ref string"), region)
        parts.append(seen)
        order = {t[0]: i for i, t in enumerate(texts)}
        out.warnings += [r.message for r in sorted(bad.collect(), key=lambda r: (order[r.source_id], r.row, r.seq))]
    urls = list(profile_urls)
    if enrich and parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        urls += [r.u for r in found.where("field_path = 'links.github'").select(F.col("normalized_value").alias("u")).distinct().orderBy("u").collect()]
    if urls or captured is not None:
        got = profile_source.fetched(spark, urls, fetch or (lambda u: (None, None, "ok"))) if urls else None
        captured = got if captured is None else captured if got is None else profile_source.together(captured, got)
        seen, bad = profile_source.payload_claims(captured)
        parts.append(seen)
        out.warnings += [r.message for r in bad.orderBy("url", "message").collect()]
    every = spark.createDataFrame([], OBSERVATION)
    for p in parts:
        every = every.unionByName(p)
    out.observations = stored(checked(every))
    if out.observations.isEmpty():
        out.warnings.append("No observations were extracted from the provided sources.")
        out.projected = [] if config else None
        return out
    record_cluster, out.clusters, said = resolve(out.observations)
    out.warnings += [r.message for r in said.orderBy("order", "key").collect()]
    good, bad = validated(fuse(out.observations, record_cluster))
    out.errors += [f"canonical schema validation failed: {r.candidate_id}: {r.message}" for r in bad.orderBy("candidate_id", "message").collect()]
    out.candidates = good
    if config is not None:
        out.projected = []
        for r in project(good, config).orderBy("candidate_id").collect():  # the sink: one document
            shape, problems = assemble(r["values"])
            problems = [*r.errors, *problems]
            out.errors += [f"{r.candidate_id}: {e}" for e in problems]
            if not problems:
                out.projected.append(shape)
    return out


def envelope(result: Result, projected: bool) -> dict[str, Any]:
    """The output document."""
    if projected:
        rows = result.projected or []
    else:
        rows = [json.loads(r[0]) for r in result.candidates.orderBy("candidate_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()] if result.candidates is not None else []
    status = "success" if not result.errors else "partial_success" if rows else "failed"
    return {"status": status, "kind": "projected" if projected else "canonical", "candidate_count": len(rows), "candidates": rows, "warnings": result.warnings, "errors": result.errors}


def dumped(document: dict) -> str:
    return json.dumps(document, indent=2, sort_keys=True)


def read_manifest(path: str) -> tuple[list[str], list[str], dict[str, str], list[str]]:
    """(csv paths, note paths, references by note path, profile urls); paths are relative to the manifest."""
    with open(path, encoding="utf-8") as f:
        m = json.load(f)
    if not isinstance(m, dict):
        raise ValueError("manifest must be an object")
    unknown = [k for k in m if k not in ("csv", "notes", "github")]
    if unknown:
        raise ValueError(f"manifest.{unknown[0]} is not supported")
    base = os.path.dirname(os.path.realpath(path))

    def entries(kind: str, key: str) -> list[dict]:
        out = []
        for i, e in enumerate(m.get(kind, [])):
            e = {key: e} if isinstance(e, str) else e
            if not isinstance(e, dict) or not isinstance(e.get(key), str) or not e[key].strip():
                raise ValueError(f"manifest.{kind}[{i}] must be a string or an object with {key}")
            out.append(e)
        return out

    where = lambda p: os.path.realpath(p if os.path.isabs(p) else os.path.join(base, p))
    notes = entries("notes", "path")
    return [where(e["path"]) for e in entries("csv", "path")], [where(e["path"]) for e in notes], {where(e["path"]): e["candidate_ref"] for e in notes if e.get("candidate_ref") is not None}, [e["url"] for e in entries("github", "url")]
