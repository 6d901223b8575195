"""Fusion: the claims of a cluster become one canonical record.

All steps are grouped aggregations and ranking windows keyed by the cluster, so
Spark shuffles claims by that key; nothing runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.constants import OVERALL, SOURCE_PRIORITY
from tessera.functions.normalize import _key, blank_to_null, company, name, round2, title_key
from tessera.operators.scratch import stored


def _priority(c: Column) -> Column:
    out = F.lit(99)
    for k, v in SOURCE_PRIORITY.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def claims_of(observations: DataFrame, record_cluster: DataFrame) -> DataFrame:
    """Claims with a value, flat, with their cluster."""
    flat = observations.select("record_id", "field_path", "normalized_value", blank_to_null(F.col("normalized_value")).alias("value"), "source.source_type", "source.source_id", "source.locator", "method", "confidence")
    return flat.where("value is not null").join(record_cluster, "record_id")


def label() -> Column:
    return F.concat_ws(":", "source_type", "source_id")


def best_order() -> list[Column]:
    """Confidence, then longer values, then the source's priority, then value and place."""
    return [F.desc("confidence"), F.desc(F.length("value")), _priority(F.col("source_type")), F.col("value"), F.coalesce("locator", F.lit(""))]


def best(claims: DataFrame, by: list[str]) -> DataFrame:
    """The best claim of each group."""
    w = Window.partitionBy(*by).orderBy(*best_order())
    return claims.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def record_applications(claims: DataFrame) -> DataFrame:
    """Per record: at (latest application time) and app (its id or else time)."""
    ids = F.min(F.when(F.col("field_path") == "application.id", F.col("value")))
    at = F.max(F.when(F.col("field_path") == "application.applied_at", F.col("value")))
    return claims.where(F.col("field_path").isin("application.id", "application.applied_at")).groupBy("record_id").agg(at.alias("at"), F.coalesce(F.concat(F.lit("id:"), ids), F.concat(F.lit("time:"), at)).alias("app"))


def contact_details(claims: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, value): confidence with corroboration, sources, latest application, counts of applications and notes."""
    csv, notes = F.col("source_type") == "recruiter_csv", F.col("source_type") == "recruiter_notes"
    grouped = claims.join(records, "record_id", "left").groupBy(*by, "value").agg(
        F.max("confidence").alias("top"),
        F.array_sort(F.collect_set(label())).alias("sources"),
        F.max(csv).alias("has_csv"),
        F.max(F.when(csv, F.col("at"))).alias("latest"),
        F.count_distinct(F.when(csv, F.col("app"))).cast("int").alias("n_apps"),
        F.count_distinct(F.when(notes, F.col("source_id"))).cast("int").alias("n_notes"),
    )
    noted = F.when(F.col("has_csv") & (F.col("n_notes") > 0), F.lit(0.03) + F.lit(0.01) * (F.col("n_notes") - 1)).otherwise(F.lit(0.0))
    bonus = F.least(noted + F.lit(0.02) * F.greatest(F.lit(0), F.col("n_apps") - 1), F.lit(0.05))
    return grouped.withColumn("confidence", F.least(F.lit(0.99), round2(F.col("top") + bonus))).drop("top")


def select_contact(details: DataFrame, by: list[str], what: str) -> DataFrame:
    """Adds status, reason, is_primary and rank (from 1, the primary first) to contact details."""
    w = Window.partitionBy(*by)
    csv = F.col("has_csv")
    d = details.withColumn("n_csv", F.sum(csv.cast("int")).over(w)).withColumn("n_dated", F.sum((csv & F.col("latest").isNotNull()).cast("int")).over(w))
    d = d.withColumn("last", F.max(F.when(csv, F.col("latest"))).over(w)).withColumn("complete", F.col("n_csv") == F.col("n_dated"))
    newest = csv & F.col("complete") & (F.col("latest") == F.col("last"))
    d = d.withColumn("n_new", F.sum(F.coalesce(newest, F.lit(False)).cast("int")).over(w)).withColumn("contends", F.when(F.col("complete"), newest).otherwise(csv))
    d = d.withColumn("best", F.max(F.when(F.col("contends"), F.col("confidence"))).over(w))
    top = F.col("contends") & (F.col("confidence") == F.col("best"))
    d = d.withColumn("n_top", F.sum(F.coalesce(top, F.lit(False)).cast("int")).over(w))
    by_date = F.col("complete") & (F.col("n_new") == 1)
    primary = F.when(F.col("n_csv") == 1, csv).when(by_date, newest).when(F.col("n_top") == 1, top).otherwise(F.lit(False))
    d = d.withColumn("is_primary", F.coalesce(primary, F.lit(False)))
    status = F.when(F.col("n_csv") == 0, "unstructured_only").when((F.col("n_csv") == 1) | by_date | (F.col("n_top") == 1), "resolved").otherwise("ambiguous")
    own = F.when(F.col("n_notes") > 0, f"csv_{what}_corroborated_by_notes").when(F.col("n_apps") > 1, "repeated_distinct_applications").otherwise(F.when(F.col("n_csv") == 1, f"only_csv_{what}").otherwise(f"highest_{what}_confidence"))
    reason = F.when(F.col("n_csv") == 0, f"no_structured_csv_{what}").when((F.col("n_csv") > 1) & by_date, "latest_csv_application").when(F.col("is_primary"), own).when(status == "ambiguous", f"equal_csv_{what}_evidence")
    d = d.withColumn("status", status).withColumn("reason", F.max(reason).over(w))
    order = Window.partitionBy(*by).orderBy(F.desc("is_primary"), F.desc("confidence"), F.desc(F.coalesce("latest", F.lit(""))), "value")
    d = d.withColumn("rank", F.row_number().over(order))
    return d.drop("n_csv", "n_dated", "last", "complete", "n_new", "contends", "best", "n_top")


def contacts(claims: DataFrame, records: DataFrame, field: str, what: str) -> DataFrame:
    """Per cluster: the contact columns of the canonical record."""
    d = select_contact(contact_details(claims.where(F.col("field_path") == field), records, ["cluster_id"]), ["cluster_id"], what)
    detail = F.struct("value", "confidence", "sources", F.col("latest").alias("latest_application_at"), F.col("n_apps").alias("distinct_application_count"), F.col("n_notes").alias("corroborating_notes_count"))
    rows = F.array_sort(F.collect_list(F.struct("rank", detail.alias("d"))))
    g = d.groupBy("cluster_id").agg(rows.alias("r"), F.max(F.when(F.col("is_primary"), F.col("value"))).alias("primary"), F.max(F.when(F.col("is_primary"), F.col("confidence"))).alias("chosen"), F.max("confidence").alias("strongest"), F.first("status").alias("status"), F.first("reason").alias("reason"))
    factor = F.when(F.col("status") == "resolved", 1.0).when(F.col("status") == "ambiguous", 0.5).otherwise(0.75)
    values = F.transform("r", lambda x: x["d"]["value"])
    return g.select(
        "cluster_id",
        values.alias(f"{what}s"),
        F.col("primary").alias(f"primary_{what}"),
        F.filter(values, lambda v: F.col("primary").isNull() | (v != F.col("primary"))).alias(f"secondary_{what}s"),
        F.transform("r", lambda x: x["d"]).alias(f"{what}_details"),
        F.col("status").alias(f"{what}_resolution_status"),
        F.col("reason").alias(f"{what}_selection_reason"),
        round2(F.coalesce("chosen", "strongest") * factor).alias(f"{what}_confidence"),
    )


def skills(claims: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, value): confidence with 0.05 for each further source, and the sources."""
    g = claims.groupBy(*by, "value").agg(F.max("confidence").alias("top"), F.array_sort(F.collect_set(label())).alias("sources"))
    return g.select(*by, F.col("value").alias("name"), round2(F.col("top") + F.lit(0.05) * (F.size("sources") - 1)).alias("confidence"), "sources")


def hundredths_mean(c: Column) -> Column:
    """The mean of two-decimal numbers by whole hundredths, so that the order of addition can't matter."""
    return F.sum(F.round(c * 100).cast("long")) / F.lit(100.0) / F.count(c)


EXPERIENCE = ["company", "title", "start", "end"]
_CLAIM = ["value", "confidence", "source_type", "source_id", "locator", "method", "normalized_value"]


def experience_records(claims: DataFrame) -> DataFrame:
    """cluster_id, record_id and a struct for each experience field: its best claim in the record, null if there is none."""
    order = [F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("_c"), (-F.length("value")).alias("_l"), _priority(F.col("source_type")).alias("_p"), F.col("value").alias("_v"), F.coalesce("locator", F.lit("")).alias("_o")]
    pick = lambda f: F.min(F.when(F.col("field_path") == f"experience.{f}", F.struct(*order, F.struct(*_CLAIM).alias("claim"))))["claim"]
    # Dealt once by record: claims of a record meet in one sort.
    e = claims.where("field_path like 'experience.%'").repartition("cluster_id", "record_id")
    return e.groupBy("cluster_id", "record_id").agg(*[pick(f).alias(f) for f in EXPERIENCE]).where("company is not null or title is not null")


def experience_rows(records: DataFrame) -> DataFrame:
    """The claims of ``experience_records``, a row each."""
    row = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.lit(f"experience.{f}").alias("field_path"), *[F.col(f)[c].alias(c) for c in _CLAIM]))
    return records.select("cluster_id", "record_id", F.inline(F.filter(F.array(*[row(f) for f in EXPERIENCE]), lambda x: x.isNotNull())))


def experience(records: DataFrame) -> DataFrame:
    """Per role: the best company, title, start and end, the mean confidence, the sources, and the first record.

    Records of equal values are put together first, so that names are cleaned
    once for all of them. Where a name might be without letter or digit once it
    is cleaned, a record stands for itself (a cleaned name keeps its first letter).
    """
    plain = lambda f: F.col(f)["value"].rlike(r"^[\p{L}\p{N}]")
    shared = F.coalesce(plain("company") & plain("title"), F.lit(False))
    own = [F.when(F.col(f).isNotNull(), F.concat_ws(":", F.col(f)["source_type"], F.col(f)["source_id"])) for f in EXPERIENCE]
    number = lambda g: sum((F.when(F.col(f).isNotNull(), g(F.col(f))).otherwise(F.lit(0).cast("long")) for f in EXPERIENCE[1:]), F.when(F.col("company").isNotNull(), g(F.col("company"))).otherwise(F.lit(0).cast("long")))
    rank = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.coalesce(-F.col(f)["confidence"], F.lit(float("inf"))).alias("c"), _priority(F.col(f)["source_type"]).alias("p"), F.coalesce(F.col(f)["locator"], F.lit("")).alias("o")))
    flat = records.select(
        "cluster_id", "record_id", F.when(~shared, F.col("record_id")).alias("lone"), *[F.col(f)["value"].alias(f) for f in EXPERIENCE], *[rank(f).alias(f"{f}_r") for f in EXPERIENCE],
        number(lambda x: F.round(x["confidence"] * 100).cast("long")).alias("h"), number(lambda x: F.when(x["confidence"].isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("n"), F.array_compact(F.array_distinct(F.array(*own))).alias("labels"),
    )
    alike = flat.groupBy("cluster_id", "lone", *EXPERIENCE).agg(*[F.min(f"{f}_r").alias(f"{f}_r") for f in EXPERIENCE], F.sum("h").alias("h"), F.sum("n").alias("n"), F.collect_set("labels").alias("labels"), F.min("record_id").alias("first"))
    keyed = alike.withColumn("_v", company(F.col("company"))).withColumns({
        "k1": F.coalesce(_key(F.col("_v")), F.concat(F.lit("missing-company:"), "lone")), "k2": F.coalesce(title_key(F.col("title")), F.concat(F.lit("missing-title:"), "lone")),
        "k3": F.coalesce(F.lower("start"), F.lit("")), "k4": F.coalesce(F.lower("end"), F.lit("")),
    })
    v = F.col("_v")
    penalty = F.when(v.rlike(r"\p{L}") & ((v == F.upper(v)) | (v == F.lower(v))), 1).otherwise(0)
    r = lambda f, k: F.col(f"{f}_r")[k]
    named = F.struct(r("company", "c"), penalty, r("company", "p"), F.lower(F.coalesce(v, F.lit(""))), r("company", "o"), F.col("company").alias("value"), v.alias("v"))
    valued = lambda f: F.struct(r(f, "c"), -F.length(f), r(f, "p"), F.col(f).alias("v"), r(f, "o"))
    pick = lambda f, s: F.min(F.when(F.col(f).isNotNull(), s))["v"]
    g = keyed.groupBy("cluster_id", "k1", "k2", "k3", "k4").agg(
        pick("company", named).alias("company"), name(pick("title", valued("title"))).alias("title"), pick("start", valued("start")).alias("start"), pick("end", valued("end")).alias("end"),
        round2(F.sum("h") / F.lit(100.0) / F.sum("n")).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("labels"))))).alias("sources"), F.min("first").alias("first"),
    )
    return g.drop("k1", "k2", "k3", "k4")


def provenance(parts: list[DataFrame]) -> DataFrame:
    """Per cluster: claims that count, each once, in a fixed order."""
    keys = ["field_path", "normalized_value", "source_type", "source_id", "locator", "method"]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("cluster_id", *keys).agg(F.first("confidence").alias("confidence"))
    s = F.struct("field_path", F.col("normalized_value").alias("value"), "source_type", "source_id", F.coalesce("locator", F.lit("")).alias("_l"), "method", "locator", "confidence")
    row = F.array_sort(F.collect_list(s))
    return once.groupBy("cluster_id").agg(row.alias("p")).select("cluster_id", F.transform("p", lambda x: F.struct(x["field_path"].alias("field_path"), x["value"].alias("value"), x["source_type"].alias("source_type"), x["source_id"].alias("source_id"), x["locator"].alias("locator"), x["method"].alias("method"), x["confidence"].alias("confidence"))).alias("provenance"))


def overall(parts: dict[str, Column]) -> Column:
    """The weighted sum of confidences, added from the left; what is missing counts 0."""
    total = F.lit(0.0)
    for k, w in OVERALL.items():
        total = total + F.lit(w) * F.coalesce(parts[k], F.lit(0.0))
    return round2(total)


#: Fields that a canonical record is made of, besides those of experience.
KNOWN = ["full_name", "emails", "phones", "skills", "headline", "links.github", "links.linkedin", "links.portfolio", "links.other", "application.id", "application.applied_at"]


def fuse(observations: DataFrame, record_cluster: DataFrame) -> DataFrame:
    """One canonical record per cluster. Claims without a value don't count; a cluster of only such claims is an empty record."""
    claims = stored(claims_of(observations, record_cluster))
    # Fields without a claim are known, so that plans leave out what is made of them.
    worked_at = F.col("field_path").startswith("experience.")
    listed = claims.where(worked_at | F.col("field_path").isin(KNOWN)).select(F.when(worked_at, "experience").otherwise(F.col("field_path")).alias("f")).distinct()
    present = {r.f for r in listed.collect()}
    of = lambda *f: claims.where(F.col("field_path").isin(*f)) if present & set(f) else claims.limit(0)
    records = record_applications(of("application.id", "application.applied_at"))
    single = {"full_name": "full_name", "links.github": "github", "links.linkedin": "linkedin", "links.portfolio": "portfolio", "headline": "headline"}
    chosen = best(of(*single), ["cluster_id", "field_path"])
    scalars = chosen.groupBy("cluster_id").agg(
        *[F.max(F.when(F.col("field_path") == k, F.col("value"))).alias(v) for k, v in single.items()],
        F.max(F.when(F.col("field_path") == "full_name", F.col("confidence"))).alias("name_c"), F.max(F.when(F.col("field_path") == "links.github", F.col("confidence"))).alias("github_c"),
    )
    other = of("links.other").groupBy("cluster_id", "value").agg(F.max("confidence").alias("c")).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("c"), F.col("value").alias("v")))).alias("o")).select("cluster_id", F.transform("o", lambda x: x["v"]).alias("other"))
    sk = skills(of("skills"), ["cluster_id"])
    sk = sk.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("_c"), "name", "confidence", "sources"))).alias("s"), hundredths_mean(F.col("confidence")).alias("skill_c"))
    sk = sk.select("cluster_id", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"), x["sources"].alias("sources"))).alias("skills"), "skill_c")
    worked = experience_records(claims if "experience" in present else claims.limit(0))
    ex = experience(worked).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("_c"), F.coalesce("company", F.lit("")).alias("_o"), F.coalesce("title", F.lit("")).alias("_t"), F.col("first").alias("_f"), "company", "title", "start", "end", "confidence", "sources"))).alias("e"),
        hundredths_mean(F.col("confidence")).alias("experience_c"),
    )
    ex = ex.select("cluster_id", F.transform("e", lambda x: F.struct(x["company"].alias("company"), x["title"].alias("title"), x["start"].alias("start"), x["end"].alias("end"), F.lit(None).cast("string").alias("summary"), x["confidence"].alias("confidence"), x["sources"].alias("sources"))).alias("experience"), "experience_c")
    cols = ["cluster_id", "field_path", "normalized_value", "source_type", "source_id", "locator", "method", "confidence"]
    listed = of("emails", "phones", "links.other", "application.applied_at", "application.id")
    skilled = of("skills").withColumn("field_path", F.concat(F.lit("skills["), F.col("value"), F.lit("]")))
    seen = provenance([x.select(*cols) for x in (chosen, listed, skilled, experience_rows(worked))])
    out = record_cluster.select("cluster_id").distinct()
    for part in (scalars, contacts(of("emails"), records, "emails", "email"), contacts(of("phones"), records, "phones", "phone"), other, sk, ex, seen):
        out = out.join(part, "cluster_id", "left")
    text = F.lit(None).cast("string")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    missing = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return out.select(
        F.col("cluster_id").alias("candidate_id"), "full_name", empty("emails").alias("emails"), empty("phones").alias("phones"),
        F.struct(text.alias("city"), text.alias("region"), text.alias("country")).alias("location"),
        F.struct("linkedin", "github", "portfolio", empty("other").alias("other")).alias("links"),
        "headline", F.lit(None).cast("double").alias("years_experience"), empty("skills").alias("skills"), empty("experience").alias("experience"),
        F.array().cast("array<struct<institution:string,degree:string,field:string,end_year:int,confidence:double,sources:array<string>>>").alias("education"),
        empty("provenance").alias("provenance"),
        overall({"full_name": F.col("name_c"), "email": F.col("email_confidence"), "phone": F.col("phone_confidence"), "github": F.col("github_c"), "skills": F.col("skill_c"), "experience": F.col("experience_c")}).alias("overall_confidence"),
        "primary_email", empty("secondary_emails").alias("secondary_emails"), empty("email_details").alias("email_details"), missing("email_resolution_status", "missing").alias("email_resolution_status"), "email_selection_reason", missing("email_confidence", 0.0).alias("email_confidence"),
        "primary_phone", empty("secondary_phones").alias("secondary_phones"), empty("phone_details").alias("phone_details"), missing("phone_resolution_status", "missing").alias("phone_resolution_status"), "phone_selection_reason", missing("phone_confidence", 0.0).alias("phone_confidence"),
    )
