"""Captured profile payloads (JSON) as observations; fetching is a pluggable function and off by default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.constants import CONFIDENCE, LANGUAGE_CONFIDENCE

PAYLOAD = "struct<login:string,name:string,email:string,html_url:string,blog:string,bio:string,company:string,public_repos:int>"
REPOSITORIES = "array<struct<full_name:string,name:string,language:string,fork:boolean>>"
#: API field -> (field path, name of the normalizer, key of the confidence)
API = {
    "name": ("full_name", "normalize_name", "full_name"), "email": ("emails", "normalize_email", "emails"), "html_url": ("links.github", "normalize_github_url", "html_url"),
    "blog": ("links.portfolio", "normalize_url", "blog"), "bio": ("headline", "normalize_name", "bio"), "company": ("experience.company", "_normalize_company", "company"),
}
PAGE = 100


def _norm(field: str, c):
    return {"name": N.name, "email": N.email_any, "html_url": N.github_url, "blog": N.url, "bio": N.name, "company": N.github_company}[field](c)


def payload_claims(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, (url, message)) of captured payloads (url, profile: JSON, repositories: JSON, status).

    The url itself is a claim whatever its payload; a status other than null or
    "ok" is a warning, and what payload there is beside it still counts. Repositories that are forks or
    have no language show no skill.
    """
    rows = captured.withColumn("norm", N.github_url(F.col("url")))
    bad = rows.where("norm is null").select("url", F.concat(F.lit("Invalid GitHub profile URL: '"), F.coalesce("url", F.lit("")), F.lit("'")).alias("message"))
    rows = rows.where("norm is not null").withColumn("p", F.from_json("profile", PAYLOAD)).withColumn("r", F.slice(F.from_json("repositories", REPOSITORIES), 1, PAGE))
    user = F.regexp_extract("norm", r"^https://github\.com/([^/]+)", 1)
    # A payload that isn't the expected kind of JSON counts as a failure of its own.
    label, repos_label = F.concat(F.lit("GitHub profile '"), user, F.lit("'")), F.concat(F.lit("GitHub repositories for '"), user, F.lit("'"))
    odd = lambda c, first: F.col(c).isNotNull() & ~F.ltrim(c).startswith(first)
    shape = F.lit(" returned an unexpected JSON shape.")
    failed = rows.where("status is not null and status <> 'ok'").select("url", F.col("status").alias("message"))
    shapes = rows.where(odd("profile", "{")).select("url", F.concat(label, shape).alias("message")).unionByName(rows.where(~odd("profile", "{") & odd("repositories", "[")).select("url", F.concat(repos_label, shape).alias("message")))
    many = rows.where(f"p.public_repos > {PAGE}").select("url", F.concat(label, F.lit(" has "), F.col("p.public_repos").cast("string"), F.lit(f" public repositories; language evidence is limited to the first {PAGE}.")).alias("message"))
    failed = failed.unionByName(shapes)
    record = F.concat(F.lit("github_profile:"), "norm")
    source = lambda locator: F.struct(F.lit("github_profile").alias("source_type"), F.col("norm").alias("source_id"), locator.alias("locator"))
    conf = CONFIDENCE["github_profile"]
    url = rows.select(record.alias("record_id"), F.lit("links.github").alias("field_path"), F.col("url").alias("raw_value"), F.col("norm").alias("normalized_value"), source(F.lit("input_url")).alias("source"), F.lit("github_profile_url -> normalize_github_url").alias("method"), F.lit(conf["input_url"]).alias("confidence"))
    ok = rows.where("p is not null")
    items = F.array(*[F.struct(F.lit(f).alias("field_path"), F.col(f"p.{k}").alias("raw_value"), _norm(k, F.col(f"p.{k}")).alias("normalized_value"), F.lit(f"profile.{k}").alias("where"), F.lit(f"github_api:{k} -> {n}").alias("method"), F.lit(conf[c]).alias("confidence")) for k, (f, n, c) in API.items()])
    fields = ok.select("norm", F.inline(items)).where("normalized_value is not null").select(record.alias("record_id"), "field_path", "raw_value", "normalized_value", source(F.col("where")).alias("source"), "method", "confidence")
    repos = ok.select("norm", F.explode("r").alias("x")).where("not coalesce(x.fork, false)").withColumn("language", N.skill(F.col("x.language"))).where("language is not null")
    label = F.coalesce(N.strip(F.coalesce("x.full_name", "x.name")), F.lit("unknown_repository"))
    langs = repos.groupBy("norm", "language").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("repos"))
    tiers = F.array(*[F.lit(x) for x in LANGUAGE_CONFIDENCE])
    skills = langs.select(record.alias("record_id"), F.lit("skills").alias("field_path"), F.col("language").alias("raw_value"), F.col("language").alias("normalized_value"), source(F.concat(F.lit("repositories:"), "repos")).alias("source"), F.concat(F.lit("github_repositories[].language -> normalize_skill ("), "n", F.lit(" non-fork repositories)")).alias("method"), F.element_at(tiers, F.least(F.col("n"), F.lit(len(LANGUAGE_CONFIDENCE))).cast("int")).alias("confidence"))
    return url.unionByName(fields).unionByName(skills), bad.unionByName(failed).unionByName(many)


def _get(url: str, headers: dict[str, str], timeout: float, label: str) -> tuple[str | None, str | None]:
    """(body, None) of a JSON resource, or (None, what went wrong)."""
    import json
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as response:
            code, body = response.status, response.read()
    except urllib.error.HTTPError as e:
        code, body = e.code, b""
    except OSError as e:
        return None, f"Could not fetch {label}: {e}"
    if code != 200:
        reason = {404: "profile or resource was not found", 403: "request was forbidden or rate-limited", 429: "request was forbidden or rate-limited"}.get(code, f"unexpected HTTP status {code}")
        return None, f"Could not fetch {label}: {reason}."
    try:
        text = body.decode("utf-8")
        json.loads(text)
    except ValueError as e:
        return None, f"Could not decode {label} response as JSON: {e}"
    return text, None


def http_fetch(token: str | None = None, timeout: float = 5.0, base: str = "https://api.github.com") -> Callable[[str], tuple[str | None, str | None, str]]:
    """A ``fetch`` for ``fetched``: two requests, for the profile and the first page of its repositories. A failure is told, never raised."""
    headers = {"Accept": "application/vnd.github+json", "User-Agent": "tessera", "X-GitHub-Api-Version": "2026-03-10"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def fetch(url: str) -> tuple[str | None, str | None, str]:
        from urllib.parse import quote, urlsplit

        user = urlsplit(url).path.strip("/").split("/", 1)[0]
        if not user:
            return None, None, "ok"
        at = f"{base}/users/{quote(user)}"
        profile, wrong = _get(at, headers, timeout, f"GitHub profile {user!r}")
        if profile is None or not profile.lstrip().startswith("{"):
            return profile, None, wrong or "ok"
        repositories, wrong = _get(f"{at}/repos?type=owner&sort=full_name&direction=asc&per_page={PAGE}&page=1", headers, timeout, f"GitHub repositories for {user!r}")
        return profile, repositories, wrong or "ok"

    return fetch


def together(captured: DataFrame, more: DataFrame) -> DataFrame:
    """``captured`` payloads, and those of ``more`` whose normalized url isn't among them."""
    key = F.coalesce(N.github_url(F.col("url")), "url")
    seen = captured.select(key.alias("_k")).distinct()
    return captured.unionByName(more.withColumn("_k", key).join(seen, "_k", "left_anti").drop("_k"), allowMissingColumns=True)


def fetched(spark: SparkSession, urls: list[str], fetch: Callable[[str], tuple[str | None, str | None, str]]) -> DataFrame:
    """Captured payloads of urls (each normalized one once) by ``fetch(url) -> (profile, repositories, status)``, on the executors."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(u, *fetch(u)) for u in pdf.url], columns=["url", "profile", "repositories", "status"])

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string")
    key = F.coalesce(N.github_url(F.col("url")), "url")
    df = df.groupBy(key.alias("_k")).agg(F.min_by("url", "i").alias("url")).select("url")
    return df.mapInPandas(run, "url string, profile string, repositories string, status string")
