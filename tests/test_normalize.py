"""Scalar normalizers against worked examples."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize as N

CASES = [
    (N.email_any, [(" Ann.B@Example.COM ", "ann.b@example.com"), ("a..b@x.com", None), (".a@x.com", None), ("a@x", None), ("a@@x.com", None), ("", None), (None, None), ("a@-x.com", None), ("u@bücher.de", "u@xn--bcher-kva.de")]),
    (N.name, [("  Ann   B\t", "Ann B"), (" ", None), (None, None)]),
    (N.company, [("Acme, Inc.", "Acme"), ("Foo Pvt. Ltd.", "Foo"), ("Bar Private Limited", "Bar"), ("X Corp. Ltd.", "X"), ("Alphabet", "Alphabet"), (" ,; ", None)]),
    (N.company_key, [("ACME, Inc.", "acme"), ("A-B  C GmbH", "a b c")]),
    (lambda c: N.phone(c, "IN"), [("9876543210", "+919876543210"), ("09876543210", "+919876543210"), ("+91 98765 43210", "+919876543210"), ("12345", None), ("+1 (650) 253-0000", "+16502530000")]),
    (lambda c: N.phone(c, "US"), [("6502530000", "+16502530000"), ("(650) 253-0000", "+16502530000")]),
    (N.phone, [("9876543210", None), ("+44 2079460958", "+442079460958"), ("x", None), (None, None)]),
    (N.url, [("http://www.X.com/a/?q=1#f", "https://x.com/a"), ("x.com", "https://x.com"), ("HTTP://x.com/a", "https://http://x.com/a"), ("//x.com", None), ("https://[x", None), ("", None), ("https://a.b/c;d?e", "https://a.b/c")]),
    (N.github_url, [("github.com/AnnB/repo", "https://github.com/AnnB"), ("https://www.github.com/x/", "https://github.com/x"), ("https://gitlab.com/x", None), ("github.com", None)]),
    (N.skill, [(" K8s ", "Kubernetes"), ("distributed  systems", "Distributed Systems"), ("Rust", "Rust"), ("", None)]),
    (lambda c: N.experience_date(c, True), [("2020", "2020"), ("0000", None), ("2020/3", "2020-03"), ("2020-13", None), ("2024.2.29", "2024-02-29"), ("2023-02-29", None), ("202001", "2020-01"), ("20200115", "2020-01-15"), ("jan 2020", "2020-01"), ("January 2020", "2020-01"), ("2020 Mar", "2020-03"), ("5 May 2021", "2021-05-05"), ("Present.", "present"), ("soon", None), (None, None)]),
    (N.application_time, [("2026-06-30T10:15:00+05:30", "2026-06-30T04:45:00Z"), ("2026-06-30", "2026-06-30T00:00:00Z"), ("2026/6/3", "2026-06-03T00:00:00Z"), ("20260603", "2026-06-03T00:00:00Z"), ("2026-06-30T10:15:00.5Z", "2026-06-30T10:15:00.500000Z"), ("2026", None), ("2026-02-30", None), ("2026-01-05T09", "2026-01-05T09:00:00Z"), ("soon", None)]),
    (N.clean_cell, [(" N/A ", None), ("-", None), (" x ", "x"), (None, None)]),
    (N.github_company, [("@acme  inc", "acme inc")]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_normalizer(spark, k):
    f, cases = CASES[k]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = {r.i: r.o for r in df.select("i", f(F.col("v")).alias("o")).collect()}
    assert {i: got[i] for i in got} == {i: e for i, (_, e) in enumerate(cases)}


def test_rounding_is_that_of_exact_values(spark):
    values = [k / 1000 for k in range(1001)] + [0.95 * 0.9, 0.95 * 0.5, 0.97 * 0.5, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", N.round2(F.col("v")).alias("o")).collect():
        assert r.o == round(r.v, 2), r


def test_names_and_ids(spark):
    df = spark.createDataFrame([("Ann Lee", "LEE, ann"), ("Ann", "Anna"), ("陳", "陳")], "a string, b string")
    assert [r[0] for r in df.select(N.names_compatible(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert df.select(N.cluster_id(F.array(F.lit("email:b"), F.lit("candidate_ref:a")))).first()[0].startswith("cand_")
