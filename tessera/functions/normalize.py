"""Scalar normalizers as column expressions: null, blank and invalid values give null.

All are built-in functions; ``unicode_fold`` is the one Arrow function, applied
only to values beyond ASCII.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.constants import LEGAL_SUFFIXES, NULL_LIKE, PHONE_RULES, SKILL_ALIASES

_SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    plain = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(plain, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def clean_cell(c: Column) -> Column:
    """A stripped cell; what means nothing (n/a, none, - ...) is null."""
    s = strip(c)
    return F.when(~F.lower(s).isin(NULL_LIKE), s)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.nullif(strip(F.regexp_replace(c, _SPACE, " ")), F.lit(""))


def email(c: Column) -> Column:
    e = F.lower(strip(c))
    parts = F.split(e, "@")
    local, domain = parts[0], F.get(parts, F.lit(1))
    labels = F.split(domain, r"\.")
    ok = (
        (F.size(parts) == 2) & (F.length(e) <= 254) & F.length(local).between(1, 64) & local.rlike(r"^[a-z0-9!#$%&'*+/=?^_`{|}~.-]+$")
        & ~local.rlike(r"^\.|\.$|\.\.") & (F.length(domain) <= 253) & (F.size(labels) >= 2)
        & F.forall(labels, lambda x: x.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"))
    )
    return F.when(ok, e)


@F.pandas_udf(StringType())
def idna_domain(s: pd.Series) -> pd.Series:
    """Addresses with a domain beyond ASCII in its ASCII form; null where there is none."""

    def one(v):
        if v is None or v.count("@") != 1:
            return None
        local, domain = v.strip().lower().split("@")
        try:
            return f"{local}@{domain.encode('idna').decode()}"
        except UnicodeError:
            return None

    return s.map(one)


def email_any(c: Column) -> Column:
    """``email``, with domains of other scripts too; only these leave the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), email(idna_domain(c))).otherwise(email(c))


name = squeeze


@F.pandas_udf(StringType())
def unicode_fold(s: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC)."""
    import unicodedata

    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def company(c: Column, fold: bool = False) -> Column:
    """A company's name without legal designators; ``fold`` also unifies compatibility characters."""
    v = squeeze(c)
    if fold:
        v = F.when(v.rlike(r"[^\x00-\x7F]"), unicode_fold(v)).otherwise(v)
    v = F.regexp_replace(v, r"^[ ,;:-]+|[ ,;:-]+$", "")
    # Designators may stand one behind another, with punctuation between: all at the end go at once.
    one = "|".join(p.removesuffix("$") for p in LEGAL_SUFFIXES)
    v = F.regexp_replace(v, rf"(?i)(?:(?:{one})[ ,;:-]*)+$", "")
    v = F.regexp_replace(v, r"^[ ,;:-]+|[ ,;:-]+$", "")
    return F.nullif(v, F.lit(""))


def _key(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def company_key(c: Column) -> Column:
    return _key(company(c))


def title_key(c: Column) -> Column:
    return _key(squeeze(c))


def phone(c: Column, region: str | None = None) -> Column:
    """E.164 by dialling rules: international numbers (+ or 00), national ones only with a region.

    Countries without a rule are checked for length (8 to 15 digits).
    """
    s = strip(c)
    shape = s.rlike(r"^\+?[\d\s().\-/]+$")
    digits = F.regexp_replace(s, r"\D", "")
    out = F.lit(None).cast("string")
    abroad = s.startswith("+")
    known = F.lit(False)
    for cc, trunk, national in dict.fromkeys(PHONE_RULES.values()):
        hit = digits.startswith(cc)
        known = known | hit
        rest = F.regexp_extract(digits, f"^{cc}(?:\\(0\\))?({national})$", 1)
        out = F.when(abroad & hit & (rest != ""), F.concat(F.lit("+" + cc), rest)).otherwise(out)
    out = F.when(abroad & ~known & digits.rlike(r"^[1-9]\d{7,14}$"), F.concat(F.lit("+"), digits)).otherwise(out)
    if region in PHONE_RULES:
        cc, trunk, national = PHONE_RULES[region]
        rest = F.regexp_extract(digits, f"^(?:{trunk})?({national})$" if trunk else f"^({national})$", 1)
        out = F.when(~abroad & (rest != ""), F.concat(F.lit("+" + cc), rest)).otherwise(out)
    return F.when(shape, out)


def url(c: Column) -> Column:
    """https, host in lower case without one www., path without slashes at its end; no parameters, query or fragment."""
    s = strip(c)
    u = F.when(s.rlike(r"^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    rest = F.regexp_replace(F.regexp_replace(u, r"^https?://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/]*(/.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", "")
    return F.when((s != "") & (host != "") & ~host.rlike(r"[\[\]]"), F.concat(F.lit("https://"), host, path))


def github_url(c: Column) -> Column:
    u = url(c)
    user = F.regexp_extract(u, r"^https://github\.com/([^/]+)", 1)
    return F.when(user != "", F.concat(F.lit("https://github.com/"), user))


def skill(c: Column, aliases: dict[str, str] = SKILL_ALIASES) -> Column:
    v = squeeze(c)
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(v)), v)


def candidate_ref(c: Column) -> Column:
    return blank_to_null(c)


def experience_date(c: Column, allow_present: bool = False) -> Column:
    """A partial date in its own precision: YYYY, YYYY-MM or YYYY-MM-DD; ``present`` if allowed."""
    v = squeeze(c)
    month = lambda p, o: F.date_format(F.try_to_timestamp(v, F.lit(p)), o)
    y, m, d = (F.regexp_extract(v, r"^(\d{4})(?:[-/.](\d{1,2}))?(?:[-/.](\d{1,2}))?$", i) for i in (1, 2, 3))
    numeric = F.concat_ws("-", y, F.nullif(F.lpad(m, 2, "0"), F.lit("00")), F.nullif(F.lpad(d, 2, "0"), F.lit("00")))
    words = r"^(?:\d{1,2} )?(?i:[a-z]{3,9}) \d{4}$|^\d{4} (?i:[a-z]{3,9})$"
    title = F.initcap(v)
    named = lambda p, o: F.date_format(F.try_to_timestamp(title, F.lit(p)), o)
    out = (
        F.when(v.rlike(r"^\d{4}$"), F.when(v != "0000", v))
        .when(v.rlike(r"^\d{4}[-/.]\d{1,2}$"), F.when((y != "0000") & m.try_cast("int").between(1, 12), F.concat_ws("-", y, F.lpad(m, 2, "0"))))
        .when(v.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"), F.when(y != "0000", F.date_format(F.try_to_timestamp(numeric, F.lit("yyyy-MM-dd")), "yyyy-MM-dd")))
        .when(v.rlike(r"^\d{6}$"), month("yyyyMM", "yyyy-MM"))
        .when(v.rlike(r"^\d{8}$"), month("yyyyMMdd", "yyyy-MM-dd"))
        .when(v.rlike(words), F.coalesce(named("MMM yyyy", "yyyy-MM"), named("MMMM yyyy", "yyyy-MM"), named("yyyy MMM", "yyyy-MM"), named("yyyy MMMM", "yyyy-MM"), named("d MMM yyyy", "yyyy-MM-dd"), named("d MMMM yyyy", "yyyy-MM-dd")))
    )
    if allow_present:
        out = F.when(F.regexp_replace(F.lower(v), r"\.+$", "").isin("current", "now", "ongoing", "present"), F.lit("present")).otherwise(out)
    return out


def application_time(c: Column) -> Column:
    """A date or timestamp as UTC ISO-8601 with Z, kept as text; fractions as far as the source has them."""
    s = strip(c)
    t = F.regexp_replace(s, r"[zZ]$", "+00:00")
    iso = r"^\d{4}-\d{2}-\d{2}(?:.\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?(?:[+-]\d{2}:?\d{2})?)?$"
    day, clock, zone = F.substring(t, 1, 10), F.regexp_extract(t, r"^.{11}(\d{2}(?::\d{2}(?::\d{2})?)?)", 1), F.regexp_extract(t, r"^.{13,}([+-]\d{2}:?\d{2})$", 1)
    full = F.concat(day, F.lit(" "), F.when(clock == "", F.lit("00:00:00")).when(F.length(clock) == 2, F.concat(clock, F.lit(":00:00"))).when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock))
    zoned = F.concat(full, F.when(zone == "", F.lit("+00:00")).when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone))
    fraction = F.regexp_extract(t, r"[.,](\d{1,6})", 1)
    at = F.date_format(F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd HH:mm:ssXXX")), "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.when(F.rpad(fraction, 6, "0") == "000000", F.lit("")).when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), F.rpad(fraction, 6, "0")))
    plain = lambda p: F.date_format(F.try_to_timestamp(s, F.lit(p)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(t.rlike(iso), F.concat(at, micro, F.lit("Z"))).when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), plain("yyyy/M/d")).when(s.rlike(r"^\d{8}$"), plain("yyyyMMdd"))


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def names_compatible(a: Column, b: Column) -> Column:
    x, y = F.sort_array(name_tokens(a)), F.sort_array(name_tokens(b))
    return (F.size(x) > 0) & (x == y)


def github_company(c: Column) -> Column:
    return squeeze(F.regexp_replace(strip(c), "^@", ""))


def cluster_id(keys: Column) -> Column:
    """``cand_`` and 16 hex digits of the sha256 of the sorted keys, joined by bars."""
    return F.concat(F.lit("cand_"), F.substring(F.sha2(F.array_join(F.array_sort(keys), "|"), 256), 1, 16))


# Hundredths k whose k + 0.5 hundredths, as the nearest double, lie below the half, so that two-decimal
# rounding by exact value goes down there; made by rule.
_DOWN = [k for k in range(100) if round((k + 0.5) / 100, 2) * 100 < k + 0.5]


def round2(c: Column) -> Column:
    """Two decimals, 0 to 1, rounded by the exact binary value as IEEE rounding to decimal does."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    k = F.floor(v * 100).cast("int")
    tie = v == (k + F.lit(0.5)) / F.lit(100.0)
    return F.when(tie & k.isin(_DOWN), k / F.lit(100.0)).when(tie, (k + 1) / F.lit(100.0)).otherwise(F.round(v, 2))


def coalesce_all(cols: list[Column]) -> Column:
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
