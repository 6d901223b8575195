"""The projection language: paths into canonical records, type checks, missing policies, normalizers.

A path is compiled into a column once; what depends on the row (missing values,
nulls in lists) becomes a column of errors. The projected record is JSON text,
as leaving out missing fields makes its shape differ by row.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.functions.normalize import phone, skill

TYPES = ["any", "string", "number", "boolean", "object", "array", "string[]"]
POLICIES = ["null", "omit", "error"]
NORMALIZERS = ["E164", "canonical"]
_PART = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(?:\[(\d*)\])?")


class PathError(ValueError):
    pass


def parse_path(path: str) -> list[tuple[str, str | None]]:
    """(name, index) parts: index None for a field, a number for an element, "" for all elements."""
    parts = []
    for p in path.split("."):
        m = _PART.fullmatch(p)
        if not m:
            raise PathError(f"Invalid path segment {p!r} in {path!r}")
        parts.append((m[1], m[2]))
    return parts


def compile_path(schema: t.StructType, path: str) -> tuple[Column, t.DataType] | None:
    """The column of a path and its type; None if the schema has no such field."""
    parts = parse_path(path)

    def step(c: Column | None, kind: t.DataType, rest: list[tuple[str, str | None]]) -> tuple[Column, t.DataType] | None:
        if not rest:
            return c, kind
        name, index = rest[0]
        if not isinstance(kind, t.StructType) or name not in kind.fieldNames():
            return None
        inner = F.col(f"`{name}`") if c is None else c[name]
        dt = kind[name].dataType
        if index is None:
            return step(inner, dt, rest[1:])
        if not isinstance(dt, t.ArrayType):
            return None
        if index:
            return step(F.get(inner, F.lit(int(index))), dt.elementType, rest[1:])
        # All elements: nulls are kept, lists in lists are flattened by one level.
        probe = step(inner, dt.elementType, rest[1:])
        if probe is None:
            return None
        if isinstance(probe[1], t.ArrayType):
            nested = F.transform(inner, lambda x: F.coalesce(step(x, dt.elementType, rest[1:])[0], F.array().cast(probe[1])))
            return F.flatten(nested), probe[1]
        return F.transform(inner, lambda x: step(x, dt.elementType, rest[1:])[0]), t.ArrayType(probe[1])

    return step(None, schema, parts)


def read_path(df: DataFrame, path: str) -> Column:
    got = compile_path(df.schema, path)
    return F.lit(None) if got is None else got[0]


def missing_error(value: Column, out: str, source: str, required: bool, policy: str) -> Column:
    """The message where a value is missing and may not be; required comes before the policy."""
    if required:
        return F.when(value.isNull(), F.lit(f"Required field {out!r} is missing from {source!r}"))
    if policy == "error":
        return F.when(value.isNull(), F.lit(f"Field {out!r} is missing from {source!r}"))
    return F.lit(None).cast("string")


def _kind(dt: t.DataType) -> str:
    if isinstance(dt, t.StringType):
        return "string"
    if isinstance(dt, t.BooleanType):
        return "boolean"
    if isinstance(dt, t.NumericType):
        return "number"
    return "array" if isinstance(dt, t.ArrayType) else "object"


def type_error(dt: t.DataType, value: Column, out: str, wanted: str) -> Column:
    """The message where a value isn't of the wanted type. Null passes; a null in a list is no string."""
    none = F.lit(None).cast("string")
    kind = _kind(dt)
    got = {"string": "str", "number": "float", "boolean": "bool", "array": "list", "object": "dict"}[kind]
    message = F.lit(f"Field {out!r}: expected {wanted}, got {got}")
    if wanted == "any" or wanted == kind:
        return none
    if wanted == "string[]" and kind == "array" and isinstance(dt.elementType, t.StringType):
        return F.when(F.exists(value, lambda x: x.isNull()), message)
    return F.when(value.isNotNull(), message)


def _one_of(at: str, value: Any, allowed) -> list[str]:
    if not isinstance(value, str):
        return [f"{at} must be a string"]
    return [] if value in allowed else [f"{at} must be one of {sorted(allowed)}"]


def _flag(at: str, value: Any) -> list[str]:
    return [] if isinstance(value, bool) else [f"{at} must be a boolean"]


def config_errors(config: Any) -> list[str]:
    """All that is wrong with a projection config, in order. Keys that aren't known are ignored; no fields are fine."""
    if not isinstance(config, dict):
        return ["config must be an object"]
    fields, listed = config.get("fields"), isinstance(config.get("fields"), list)
    out = [] if listed else ["config.fields must be a list"]
    policy = config.get("on_missing", "null")
    problems = _one_of("config.on_missing", policy, POLICIES)
    out += problems
    for k in ("include_confidence", "include_provenance"):
        out += _flag(f"config.{k}", config.get(k, False))
    for i, f in enumerate(fields if listed else []):
        at = f"config.fields[{i}]"
        if not isinstance(f, dict):
            out.append(f"{at} must be an object")
            continue
        for k, v in (("path", f.get("path")), ("from", f.get("from", f.get("path")))):
            out += [] if isinstance(v, str) and v else [f"{at}.{k} must be a non-empty string"]
        out += _one_of(f"{at}.type", f.get("type", "any"), TYPES)
        out += _flag(f"{at}.required", f.get("required", False))
        out += _one_of(f"{at}.on_missing", f.get("on_missing", "null" if problems else policy), POLICIES)
        if f.get("normalize") is not None:
            out += _one_of(f"{at}.normalize", f["normalize"], NORMALIZERS)
    return out


def project(candidates: DataFrame, config: dict) -> DataFrame:
    """candidate_id, values (JSON object by output path, in order), errors: a row per candidate.

    ``values`` holds only what is to be written; ``assemble`` nests it.
    """
    pairs, errors = [], []
    fields = list(config["fields"])
    if config.get("include_confidence"):
        fields.append({"path": "overall_confidence"})
    if config.get("include_provenance"):
        fields.append({"path": "provenance"})
    for n, f in enumerate(fields):
        out, source = f["path"], f.get("from", f["path"])
        policy = f.get("on_missing", config.get("on_missing", "null"))
        try:
            got = compile_path(candidates.schema, source)
        except PathError as e:
            errors.append(F.lit(f"Invalid input path for {out!r}: {e}"))
            continue
        if any(i is not None for _, i in _safe(out)):
            errors.append(F.lit(f"Invalid output path {out!r}: array syntax is not supported"))
            continue
        value, dt = got or (F.lit(None).cast("string"), t.StringType())
        missing = missing_error(value, out, source, bool(f.get("required")), policy)
        bad = type_error(dt, value, out, f.get("type", "any"))
        if f.get("normalize"):
            one = phone if f["normalize"] == "E164" else skill
            if isinstance(dt, t.StringType):
                value = one(value)
            elif isinstance(dt, t.ArrayType) and isinstance(dt.elementType, t.StringType):
                value = F.transform(value, one)
            else:
                bad = F.coalesce(bad, F.when(value.isNotNull(), F.lit(f"Field {out!r}: {f['normalize']} needs a string or a list of strings")))
        errors.append(F.coalesce(missing, bad))
        shown = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        pairs.append(F.when(value.isNotNull() | F.lit(policy != "omit"), F.struct(F.lit(n).alias("n"), F.lit(out).alias("path"), shown.alias("value"))))
    kept = F.filter(F.array(*pairs), lambda x: x.isNotNull()) if pairs else F.array().cast("array<struct<n:int,path:string,value:string>>")
    problems = F.filter(F.array(*errors), lambda x: x.isNotNull())
    return candidates.select("candidate_id", kept.alias("values"), problems.alias("errors"))


def _safe(path: str) -> list[tuple[str, str | None]]:
    try:
        return parse_path(path)
    except PathError:
        return [(path, "")]


def assemble(values: list) -> tuple[dict, list[str]]:
    """The nested object of one row's values, for the sink; writing below a scalar is an error."""
    import json

    out: dict = {}
    errors = []
    for v in values:
        at, parts = out, v["path"].split(".")
        for p in parts[:-1]:
            nxt = at.get(p)
            if nxt is None:
                nxt = at[p] = {}
            if not isinstance(nxt, dict):
                errors.append(f"Cannot write {v['path']!r}: {p!r} is not an object")
                break
            at = nxt
        else:
            at[parts[-1]] = json.loads(v["value"]).get("v")
    return out, errors
