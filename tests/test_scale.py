"""Findings on larger tables: results on what only those hold, and steps that must not grow."""

import datetime

import duckdb

import __spark_entry__ as entry
from tessera.functions.constants import SKILL_ALIASES
from tessera.operators import components, scratch
from tessera.operators import fuse as U
from tessera.sources.notes import find, note_claims
from tessera.sources.structured import OBSERVATION


def same_as_sql(spark, name, folder, **tables):
    """A query and its SQL over small tables give the same rows."""
    with duckdb.connect() as c:
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        got = entry.queries()[name](spark, str(folder))
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want, key=repr)
    return rows


def test_phones_beside_other_numbers(spark, tmp_path):
    texts = ["a +1 (826) 555-4081 190.137.223.204 b", "+1 (826) 555-4081 +1 (826) 555-4082", "x+1 (607) 555-6433, +44 20 7946 0958", "+1 (126) 555-4081", None, ""]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    assert len(same_as_sql(spark, "phone_e164", tmp_path, documents=(docs, "doc_id long, text string"))) == 4
    notes = spark.createDataFrame([("n", "+1 (826) 555-4081 190.137.223.204; +91 98765 43210 12", None)], "source_id string, text string, candidate_ref string")
    assert sorted(r.normalized_value for r in note_claims(notes)[0].where("field_path = 'phones'").collect()) == ["+18265554081", "+919876543210"]


def test_addresses_as_in_sql(spark, tmp_path):
    texts = ["a@x.com A@X.com .b@x.com c..d@x.com e@-y.com", "l" * 70 + "@x.com " + "m" * 250 + "@x.com", "f@z.com1@w.org", "no address", None]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    assert len(same_as_sql(spark, "email_extract", tmp_path, documents=(docs, "doc_id long, text string"))) == 5
    plan = entry.queries()["email_extract"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapIn" not in plan  # no text leaves the JVM


def test_find_looks_first():
    kinds = lambda t: [x[:2] for x in find(t, SKILL_ALIASES)]
    assert kinds("Dıstrıbuted ſystems, Kubernetes") == [("skill", "Dıstrıbuted ſystems"), ("skill", "Kubernetes")]
    assert kinds("GİTHUB.com/x; my Website: x.org. No Python") == [("github", "GİTHUB.com/x"), ("labelled", "x.org")]


def test_experience_ranks_no_lines(spark, tmp_path):
    day = datetime.datetime
    line = lambda s, o, n, f, t, at: (o, 7, s, n, f, t, at)
    rows = [line(1, 1, 1, "N", "O", day(1996, 9, 13)), line(1, 2, 2, "N", "O", day(1996, 9, 20)), line(1, 2, 2, "N", "O", day(1996, 9, 20)), line(1, 3, 1, "N", "F", day(1996, 9, 13)), line(2, 4, 1, "A", "O", day(1997, 1, 1))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    assert len(same_as_sql(spark, "experience_group", tmp_path, lineitem=(rows, schema))) == 3
    plan = entry.queries()["experience_group"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_roles_of_like_names(spark):
    claim = lambda r, f, v, c: ("c", r, f"experience.{f}", v, v, "recruiter_csv", f"s{r}", "l", "m", c)
    rows = [claim("1", "company", "Acme Inc.", 0.8), claim("1", "title", "Dev", 0.8), claim("2", "company", "ACME", 0.8), claim("2", "title", "dev.", 0.9), claim("2", "title", "Chef", 0.7)]
    rows += [claim(r, "company", v, 0.9) for r, v in (("3", "?!"), ("4", "?!"))] + [claim("5", "title", "Dev", 0.9), claim("6", "title", "Dev", 0.9), claim("7", "start", "2020", 0.9)]
    claims = spark.createDataFrame(rows, "cluster_id string, record_id string, field_path string, value string, normalized_value string, source_type string, source_id string, locator string, method string, confidence double")
    got = sorted((r.first, r.company, r.title, r.confidence, r.sources) for r in U.experience(U.experience_records(claims)).collect())
    one = lambda r: [f"recruiter_csv:s{r}"]
    assert got == [("1", "Acme", "dev.", 0.82, one(1) + one(2)), ("3", "?!", None, 0.9, one(3)), ("4", "?!", None, 0.9, one(4)), ("5", None, "Dev", 0.9, one(5)), ("6", None, "Dev", 0.9, one(6))]
    assert U.experience_rows(U.experience_records(claims)).count() == 8


def test_stars_are_settled_as_they_come(spark, tmp_path, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "stored", lambda df: tables.append(1) or scratch.stored(df))
    assert components.components(spark.createDataFrame([("b", "a"), ("c", "a"), ("e", "d")], "a string, b string")).count() == 3
    assert len(tables) == 1
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, i % 3, ("purchase", "view", "signup")[i % 3 if i < 6 else 1], f'{{"k": {i // 4}}}') for i in range(12)]
    same_as_sql(spark, "constrained_components", tmp_path, events=(rows, "event_id long, ts timestamp, user_id long, event_type string, props string"))


def test_fusion_leaves_out_what_no_claim_makes(spark, tmp_path):
    rows = [(i, f"Name{i}", ("A", "B")[i % 2]) for i in range(7)]
    same_as_sql(spark, "fused_candidates", tmp_path, customer=(rows, "c_custkey long, c_name string, c_mktsegment string"))
    same_as_sql(spark, "projected_candidates", tmp_path, customer=(rows, "c_custkey long, c_name string, c_mktsegment string"))
    seen = spark.createDataFrame([("r", "full_name", "Ann", "Ann", ("t", "s", "l"), "m", 0.9)], OBSERVATION)
    plan = U.fuse(seen, spark.createDataFrame([("r", "c")], "record_id string, cluster_id string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3  # names and provenance; seven more tables before
