"""Resolution, fusion, projection and the command line on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import project as P
from tessera.operators import resolve as R
from tessera.operators.components import components
from tessera.operators.fuse import fuse
from tessera.operators.validate import validated
from tessera.plans.cli import main
from tessera.sources.notes import find, negated, note_claims
from tessera.sources.profile import payload_claims
from tessera.sources.structured import OBSERVATION


def claim(record, field, value, source="recruiter_csv", confidence=0.9, locator="l"):
    return (record, field, value, value, (source, "src", locator), "m", confidence)


def observations(spark, rows):
    return spark.createDataFrame([claim(*r) if isinstance(r[-1], str) and len(r) <= 4 else claim(*r) for r in rows], OBSERVATION)


def groups(spark, rows):
    rc, _, said = R.resolve(observations(spark, rows))
    out = {}
    for r in rc.collect():
        out.setdefault(r.cluster_id, []).append(r.record_id)
    return sorted(sorted(g) for g in out.values()), [r.message for r in said.orderBy("order", "key").collect()]


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    for n in (5, 40):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n)]
        root = list(range(n))

        def find_root(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = sorted((find_root(a), find_root(b)))
            root[y] = x
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {i: got.get(i, i) for i in range(n)} == {i: find_root(i) for i in range(n)}


def test_keys_chain_records(spark):
    rows = [("r1", "emails", "a@x.com"), ("r2", "emails", "a@x.com"), ("r2", "links.github", "https://github.com/a"), ("r3", "links.github", "https://github.com/a"), ("r4", "emails", "b@x.com")]
    assert groups(spark, rows)[0] == [["r1", "r2", "r3"], ["r4"]]


def test_contradicting_references_stay_apart(spark):
    rows = [("r1", "candidate_ref", "A"), ("r1", "emails", "a@x.com"), ("r2", "candidate_ref", "B"), ("r2", "emails", "a@x.com"), ("r3", "emails", "a@x.com"), ("r4", "emails", "a@x.com")]
    got, said = groups(spark, rows)
    assert got == [["r1"], ["r2"], ["r3", "r4"]]
    assert said == ["Entity resolution blocked merge on 'email:a@x.com': contradictory candidate_ref groups [('A',), ('B',)]. 2 reference-free component(s) remain separate because their referenced identity is ambiguous."]


def test_phones_need_more(spark):
    phone = lambda r, name: [(r, "phones", "+16502530000"), (r, "full_name", name)]
    assert groups(spark, phone("r1", "Ann Lee") + phone("r2", "LEE Ann") + phone("r3", "Bob"))[0] == [["r1", "r2"], ["r3"]]
    assert len(groups(spark, sum((phone(f"r{i}", "Ann Lee") for i in range(4)), []))[0]) == 4


def test_a_shared_address_makes_one_cluster_of_many(spark):
    assert len(groups(spark, [(f"r{i:04}", "emails", "a@x.com") for i in range(2000)])[0]) == 1


def fused(spark, rows):
    obs = observations(spark, rows)
    rc, _, _ = R.resolve(obs)
    return fuse(obs, rc).collect()


def test_latest_application_wins(spark):
    rows = [("r1", "candidate_ref", "A"), ("r1", "emails", "old@x.com", "recruiter_csv", 0.95), ("r1", "application.applied_at", "2024-01-01T00:00:00Z"), ("r2", "candidate_ref", "A"), ("r2", "emails", "new@x.com", "recruiter_csv", 0.95), ("r2", "application.applied_at", "2025-01-01T00:00:00Z")]
    (c,) = fused(spark, rows)
    assert (c.primary_email, c.email_selection_reason, c.emails, c.secondary_emails) == ("new@x.com", "latest_csv_application", ["new@x.com", "old@x.com"], ["old@x.com"])


def test_equal_evidence_is_ambiguous(spark):
    rows = [("r1", "candidate_ref", "A"), ("r1", "emails", "a@x.com", "recruiter_csv", 0.95), ("r1", "emails", "b@x.com", "recruiter_csv", 0.95)]
    (c,) = fused(spark, rows)
    assert (c.primary_email, c.email_resolution_status, c.email_confidence) == (None, "ambiguous", 0.47)


def test_notes_alone_have_no_primary(spark):
    (c,) = fused(spark, [("n", "emails", "a@x.com", "recruiter_notes", 0.76)])
    assert (c.primary_email, c.email_resolution_status, c.email_confidence, c.emails) == (None, "unstructured_only", 0.57, ["a@x.com"])


def test_roles_fold_and_validate(spark):
    rows = [("r1", "candidate_ref", "A"), ("r1", "experience.company", "ACME, INC."), ("r1", "experience.title", "Engineer"), ("r2", "candidate_ref", "A"), ("r2", "experience.company", "Acme"), ("r2", "experience.title", "engineer"), ("r2", "skills", "Python", "recruiter_notes", 0.68), ("r2", "skills", "Python", "github_profile", 0.64)]
    obs = observations(spark, rows)
    rc, _, _ = R.resolve(obs)
    good, bad = validated(fuse(obs, rc))
    (c,) = good.collect()
    assert bad.count() == 0 and [(e.company, e.title) for e in c.experience] == [("Acme", "Engineer")]
    assert [(s.name, s.confidence) for s in c.skills] == [("Python", 0.73)]
    broken, errors = validated(good.withColumn("overall_confidence", F.lit(1.5)))
    assert broken.count() == 0 and "greater than the maximum" in errors.first().message


def test_projection(spark):
    df = spark.createDataFrame([("c1", "Ann", [("py", 0.9), (None, 0.5)], ("u",), 0.8)], "candidate_id string, full_name string, skills array<struct<name:string,confidence:double>>, links struct<github:string>, overall_confidence double")
    config = {"fields": [{"path": "id", "from": "candidate_id"}, {"path": "who.name", "from": "full_name"}, {"path": "first", "from": "skills[0].name", "normalize": "canonical"}, {"path": "gone", "from": "skills[7].name", "on_missing": "omit"}, {"path": "names", "from": "skills[].name", "type": "string[]"}], "include_confidence": True}
    assert P.config_errors(config) == []
    r = P.project(df, config).first()
    shape, problems = P.assemble(r["values"])
    assert shape == {"id": "c1", "who": {"name": "Ann"}, "first": "Python", "names": ["py", None], "overall_confidence": 0.8} and problems == []
    assert r.errors == ["Field 'names': expected string[], got list"]
    assert P.config_errors([]) == ["config must be an object"] and P.config_errors({"fields": [], "odd": 1}) == []
    field = {"path": "name", "from": "full_name"}
    for config, message in (
        ({}, "config.fields must be a list"),
        ({"fields": [], "on_missing": []}, "config.on_missing must be a string"),
        ({"fields": [], "on_missing": "x"}, f"config.on_missing must be one of {sorted(P.POLICIES)}"),
        ({"fields": [field], "include_confidence": "yes"}, "config.include_confidence must be a boolean"),
        ({"fields": [field | {"on_missing": []}]}, "config.fields[0].on_missing must be a string"),
        ({"fields": [field | {"type": []}]}, "config.fields[0].type must be a string"),
        ({"fields": [field | {"required": "false"}]}, "config.fields[0].required must be a boolean"),
    ):
        assert P.config_errors(config) == [message]
    with pytest.raises(P.PathError):
        P.parse_path("a[-1]")


@pytest.mark.parametrize(
    ("text", "skills"),
    [("Strong Python. No JavaScript background.", {"Python"}), ("Not only Docker but also AWS", {"Docker", "AWS"}), ("Redis experience is lacking", set()), ("Has never used Azure; knows GCP", {"GCP"}), ("SQL, not Python", {"SQL"}), ("go to Kubernetes", {"Kubernetes"})],
)
def test_negation(spark, text, skills):
    notes = spark.createDataFrame([("n1", text, None)], "source_id string, text string, candidate_ref string")
    seen, _ = note_claims(notes)
    assert {r.normalized_value for r in seen.where("field_path = 'skills'").collect()} == skills


def test_places_are_code_points(spark):
    text = "é😀 Contact ann@x.com. Portfolio: ann.dev/work, blog: https://b.io"
    assert negated("no x", 3, 4, [("no", 0, 2)])
    got = {k: text[s : s + len(v)] for k, v, s, _ in find(text, {})}
    assert got["email"] == "ann@x.com" and got["labelled"] == "https://b.io"


def test_payloads(spark):
    rows = [("https://github.com/Ann", json.dumps({"name": "Ann L", "company": "@acme", "public_repos": 101, "blog": ""}), json.dumps([{"full_name": "a/x", "language": "py", "fork": False}, {"full_name": "a/y", "language": "Python", "fork": False}, {"full_name": "a/z", "language": "Go", "fork": True}]), "ok"), ("not-a-url", None, None, "ok"), ("github.com/bob", None, None, "HTTP 403")]
    seen, said = payload_claims(spark.createDataFrame(rows, "url string, profile string, repositories string, status string"))
    got = {(r.record_id, r.field_path): (r.normalized_value, r.confidence) for r in seen.collect()}
    assert got["github_profile:https://github.com/Ann", "skills"] == ("Python", 0.54)
    assert got["github_profile:https://github.com/Ann", "experience.company"] == ("acme", 0.56)
    assert ("github_profile:https://github.com/bob", "links.github") in got and said.count() == 3


def test_profiles_over_http():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    from tessera.sources.profile import http_fetch

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            code, body = {"/users/ann": (200, b'{"name": "Ann"}'), "/users/cut": (200, b"{"), "/users/full": (403, b""), "/users/odd": (500, b"")}.get(self.path, (200, b"[]") if self.path.startswith("/users/ann/repos?") else (404, b""))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a): ...

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    fetch = http_fetch(timeout=5, base=f"http://127.0.0.1:{server.server_port}")
    said = lambda u: fetch(f"https://github.com/{u}")[2]
    assert fetch("https://github.com/ann") == ('{"name": "Ann"}', "[]", "ok")
    assert said("full") == "Could not fetch GitHub profile 'full': request was forbidden or rate-limited."
    assert said("gone") == "Could not fetch GitHub profile 'gone': profile or resource was not found."
    assert said("odd") == "Could not fetch GitHub profile 'odd': unexpected HTTP status 500."
    assert said("cut").startswith("Could not decode GitHub profile 'cut' response as JSON: ")
    server.shutdown()
    server.server_close()
    assert said("ann").startswith("Could not fetch GitHub profile 'ann': ")


def test_observations_are_checked(spark):
    from tessera.operators.validate import checked

    assert checked(observations(spark, [("r1", "emails", "a@x.com")])).count() == 1
    with pytest.raises(Exception, match="confidence must be between"):
        checked(observations(spark, [("r1", "emails", "a@x.com", "recruiter_csv", 1.5)])).collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text('﻿Candidate ID,Name,Email,Phone,current_company\nX-1,Ann Lee,"ann@x.com; ann@x.com",+16502530000,"Acme, Inc."\n\nX-2,"Bob\nB",bad@@x,12345,n/a\n', encoding="utf-8")
    (tmp_path / "n.txt").write_text("Knows Docker.", encoding="utf-8")
    (tmp_path / "m.json").write_text(json.dumps({"csv": ["a.csv"], "notes": [{"path": "n.txt", "candidate_ref": "X-1"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"fields": [{"path": "name", "from": "full_name"}, {"path": "mail", "from": "primary_email", "required": True}, {"path": "skills", "from": "skills[].name"}]}))
    out = tmp_path / "deep" / "out.json"
    args = ["--manifest", str(tmp_path / "m.json"), "--config", str(tmp_path / "c.json"), "--output", str(out)]
    assert main(args, spark) == 1 and not out.exists()
    assert main([*args, "--allow-partial"], spark) == 0
    got = json.loads(out.read_text())
    assert got["status"] == "partial_success" and got["candidates"] == [{"name": "Ann Lee", "mail": "ann@x.com", "skills": ["Docker"]}]
    assert got["warnings"] == ["Invalid email at row=3, column=Email: 'bad@@x'", "Local phone requires an explicit region at row=3, column=Phone: '12345'"]
    assert main(["--config", str(tmp_path / "none.json")], spark) == 1
    capsys.readouterr()
