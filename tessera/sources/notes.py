"""Free-text notes as observations: one Arrow function finds values with their places, negation included."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.constants import AMBIGUOUS_SKILLS, ATTRIBUTES, CONFIDENCE, COPULAS, NEGATION_CUES, NEGATION_WINDOW, PHONE_RULES, PSEUDO_NEGATIONS, SCOPE_BREAKERS, SKILL_ALIASES
from tessera.sources.structured import DIAGNOSTIC, OBSERVATION, quoted

# What values look like in text.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
PHONE = re.compile(r"(?<![\w+])\+?\d(?:[\s().-]{0,2}\d){6,14}(?!\w)")
GITHUB = re.compile(r"(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9-]+(?:/[^\s,)]*)?", re.I)
LINKEDIN = re.compile(r"(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_%.-]+(?:/[^\s,;)]*)?", re.I)
_URL = r"(?:(?:https?://|www\.)[^\s,;<>\[\]{}()]+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?:/[^\s,;<>\[\]{}()]*)?)"
LABELLED = re.compile(rf"\b(?P<label>portfolio(?:\s+(?:url|link))?|website|homepage|personal\s+(?:site|website)|blog|other\s+(?:url|link))\s*[:=-]\s*(?P<url>{_URL})", re.I)
LOCAL_PHONE = re.compile(r"\b(?:phone|mobile|tel(?:ephone)?|contact)\s*[:=-]?\s*(?P<number>\d(?:[\s().-]*\d){6,14})", re.I)
WORD = re.compile(r"[A-Za-z0-9+#]+(?:\.[A-Za-z0-9+#]+)*(?:['’][A-Za-z]+)?")
CLAUSE = re.compile(r"[.!?;\r\n]")
_NUMBERS = [(cc, re.compile(cc + national)) for cc, _, national in dict.fromkeys(PHONE_RULES.values())]


def _cue(words: list[str], i: int) -> bool:
    return i < len(words) and words[i] in NEGATION_CUES and tuple(words[i : i + 2]) not in PSEUDO_NEGATIONS


def negated(text: str, start: int, end: int, words: list[tuple[str, int, int]]) -> bool:
    """Whether a mention is denied by the words of its clause: a cue in the eight before, or right behind it."""

    def scope(order, edge: int, side: int) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        for w in order:
            gap = text[w[2] : edge] if side < 0 else text[edge : w[1]]
            if CLAUSE.search(gap) or w[0] in SCOPE_BREAKERS:
                break
            out.append(w)
            edge = w[1] if side < 0 else w[2]
            if len(out) == NEGATION_WINDOW:
                break
        return out

    before = [w[0] for w in scope([w for w in reversed(words) if w[2] <= start], start, -1)][::-1]
    if any(_cue(before, i) for i in range(len(before))):
        return True
    behind = scope([w for w in words if w[1] >= end], end, 1)
    after = [w[0] for w in behind]
    if _cue(after, 0):
        return "," not in text[end : behind[0][1]]
    at = 1 if after and after[0] in ATTRIBUTES else 0
    if at and _cue(after, at):
        return True
    return at < len(after) and after[at] in COPULAS and _cue(after, at + 1)


def phones(text: str) -> list[tuple[str, int]]:
    """(run, start) of what looks like a phone. A run that fits no number of its country ends where a number of it ends."""
    out, at = [], 0
    while m := PHONE.search(text, at):
        run, at = m[0].strip(), m.end()
        digits = re.sub(r"\D", "", run)
        rules = [r for cc, r in _NUMBERS if digits.startswith(cc)]
        if run.startswith("+") and rules and not any(r.fullmatch(digits) for r in rules):
            ends = [e.end() for e in re.finditer(r"\d(?!\d)", run)]
            fits = [e for e in ends if any(r.fullmatch(re.sub(r"\D", "", run[:e])) for r in rules)]
            if fits:
                run, at = run[: fits[-1]], m.start() + fits[-1]
        out.append((run, m.start()))
    return out


def find(text: str, aliases: dict[str, str]) -> list[tuple[str, str, int, str]]:
    """(kind, raw value, start, label) of all that a text holds, by kind and place."""
    # What a pattern needs is looked for first, in the cases that re.I takes as one.
    low = text.replace("İ", "i").lower().replace("ſ", "s").replace("ı", "i")
    has = lambda *parts: any(p in low for p in parts)
    out = [("email", m[0], m.start(), "") for m in EMAIL.finditer(text)] if has("@") else []
    out += [("phone", v, at, "") for v, at in phones(text)]
    if has("github.com/"):
        out += [("github", v, m.start(), "") for m in GITHUB.finditer(text) if (v := m[0].rstrip(".,;:]})"))]
    if has("linkedin.com/in/"):
        out += [("linkedin", m[0].rstrip(".,;:!?\"'’]})"), m.start(), "") for m in LINKEDIN.finditer(text)]
    if has("portfolio", "website", "homepage", "personal", "blog", "other"):
        out += [("labelled", m["url"].rstrip(".,;:!?\"'’]})"), m.start("url"), " ".join(m["label"].lower().split())) for m in LABELLED.finditer(text)]
    words = None
    seen = set()
    for alias in sorted(aliases, key=len, reverse=True):
        if alias in AMBIGUOUS_SKILLS or aliases[alias] in seen or (alias.isascii() and not has(alias.lower())):
            continue
        for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(alias)}(?![A-Za-z0-9])", text, re.I):
            if words is None:
                words = [(w[0].lower().replace("’", "'"), w.start(), w.end()) for w in WORD.finditer(text)]
            if not negated(text, m.start(), m.end(), words):
                seen.add(aliases[alias])
                out.append(("skill", m[0], m.start(), ""))
                break
    if has("phone", "mobile", "tel", "contact"):
        out += [("local", m["number"].strip(), m.start("number"), str(m.end("number"))) for m in LOCAL_PHONE.finditer(text)]
    return out


def note_claims(notes: DataFrame, region: str | None = None, aliases: dict[str, str] = SKILL_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(observations, diagnostics) of notes (source_id, text, candidate_ref). Null texts hold nothing.

    Within a note the first place of a value counts; a note's denial never takes back another note's claim.
    """

    def run(batches):
        for pdf in batches:
            rows = [(s, k, v, a, label, n) for s, text in zip(pdf.source_id, pdf.text) if text for n, (k, v, a, label) in enumerate(find(text, aliases))]
            yield pd.DataFrame(rows, columns=["source_id", "kind", "raw", "start", "label", "seq"])

    found = notes.select("source_id", "text").mapInPandas(run, "source_id string, kind string, raw string, start int, label string, seq int")
    k, raw = F.col("kind"), F.col("raw")
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    norm = F.when(k == "email", N.email_any(raw)).when(k == "phone", N.phone(raw, region)).when(k == "github", N.github_url(raw)).when(k == "skill", F.try_element_at(table, F.lower(raw))).when(k != "local", N.url(raw))
    other = (F.col("label") == "blog") | F.col("label").startswith("other ")
    field = F.when(k == "email", "emails").when(k == "phone", "phones").when(k == "github", "links.github").when(k == "linkedin", "links.linkedin").when(k == "skill", "skills").when(other, "links.other").otherwise("links.portfolio")
    method = (
        F.when(k == "email", "regex_email -> normalize_email").when(k == "phone", "phonenumbers_matcher -> normalize_phone").when(k == "github", "regex_github_url -> normalize_github_url")
        .when(k == "linkedin", "regex_linkedin_profile_url -> normalize_url").when(k == "skill", "skill_dictionary_match -> normalize_skill")
        .otherwise(F.concat(F.lit("labeled_"), F.replace(F.col("label"), F.lit(" "), F.lit("_")), F.lit("_url -> normalize_url")))
    )
    good = found.withColumn("norm", norm).withColumn("field_path", field).where("kind <> 'local' and norm is not null")
    good = good.where("not (kind = 'labelled' and (startswith(norm, 'https://github.com/') or startswith(norm, 'https://linkedin.com/in/')))")
    once = good.groupBy("source_id", "field_path", "norm").agg(F.min(F.struct("seq", "raw", "start", method.alias("method"))).alias("x"))
    conf = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE["recruiter_notes"].items() for x in kv]), F.col("field_path"))
    place = F.concat(F.lit("chars="), F.col("x.start"), F.lit(":"), F.col("x.start") + F.length("x.raw"))
    record = F.concat(F.lit("recruiter_notes:"), "source_id")
    seen = once.select(record.alias("record_id"), "field_path", F.col("x.raw").alias("raw_value"), F.col("norm").alias("normalized_value"), F.struct(F.lit("recruiter_notes").alias("source_type"), "source_id", place.alias("locator")).alias("source"), F.col("x.method").alias("method"), conf.alias("confidence"))
    refs = notes.withColumn("norm", N.candidate_ref(F.col("candidate_ref"))).where("candidate_ref is not null")
    given = refs.where("norm is not null").select(record.alias("record_id"), F.lit("candidate_ref").alias("field_path"), F.col("candidate_ref").alias("raw_value"), F.col("norm").alias("normalized_value"), F.struct(F.lit("ingestion_manifest").alias("source_type"), "source_id", F.lit("candidate_ref").alias("locator")).alias("source"), F.lit("provided_candidate_ref -> normalize_candidate_ref").alias("method"), F.lit(CONFIDENCE["ingestion_manifest"]["candidate_ref"]).alias("confidence"))
    blank = refs.where("norm is null").select("source_id", F.lit(0).cast("long").alias("row"), F.lit(0).alias("seq"), F.concat(F.lit("Provided candidate_ref for notes source "), quoted(F.col("source_id")), F.lit(" is empty")).alias("message"))
    local = found.where(F.lit(region is None) & (k == "local")).select("source_id", F.lit(1).cast("long").alias("row"), "seq", F.concat(F.lit("Local phone in notes requires an explicit region at chars="), "start", F.lit(":"), "label", F.lit(": "), quoted(raw)).alias("message"))
    return given.unionByName(seen), blank.unionByName(local)


def note_values(notes: DataFrame, pattern: str, holds: str, norm) -> DataFrame:
    """(source_id, value): what a pattern of the caller's finds in notes (source_id, text), normalized by ``norm``, once a note.

    Native, for values of one kind whose places aren't asked for. Only texts that
    hold ``holds``, a part of every match, are searched.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: norm(x)))
    return notes.where(F.contains("text", F.lit(holds))).select("source_id", F.explode(found).alias("value")).where("value is not null").distinct()


def read_note(path: str) -> tuple[str | None, list[str], list[str]]:
    """(text, warnings, errors) of a note file in strict UTF-8."""
    if not os.path.exists(path):
        return None, [], [f"Notes file does not exist: {path}"]
    if os.path.isdir(path):
        return None, [], [f"Notes path is a directory, not a file: {path}"]
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except (UnicodeDecodeError, OSError) as e:
        return None, [], [f"Could not read notes file {path}: {e}"]
    return (text, [], []) if text.strip() else (None, [f"Notes file is empty: {path}"], [])


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], OBSERVATION), spark.createDataFrame([], DIAGNOSTIC)
