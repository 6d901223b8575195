"""Observations that arrive in two batches give the records of both."""

from tessera.sources.structured import OBSERVATION
from tessera.streaming.ingest import ingest


def test_two_batches(spark, tmp_path):
    row = lambda r, f, v: (r, f, v, v, ("recruiter_csv", "s", "l"), "m", 0.9)
    seen = {}
    for n, rows in enumerate([[row("r1", "emails", "a@x.com"), row("r1", "full_name", "Ann")], [row("r2", "emails", "a@x.com"), row("r2", "skills", "Python")]]):
        spark.createDataFrame(rows, OBSERVATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(OBSERVATION).parquet(f"{tmp_path}/in")
        q = ingest(stream, f"{tmp_path}/table", f"{tmp_path}/ck", lambda df, k: seen.update({k: df.select("full_name", "skills").collect()}))
        q.awaitTermination(120)
        assert q.exception() is None, n
    (c,) = seen[max(seen)]
    assert c.full_name == "Ann" and [s.name for s in c.skills] == ["Python"]
