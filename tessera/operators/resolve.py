"""Entity resolution: records that share identity keys become one cluster, unless their references contradict.

Keys give star edges (each record to the smallest of its key), so a key that
many records share costs no pairs. Records with references form groups that stay
apart; components of records without reference that touch several groups are
replayed, one component at a time, in the fixed order of keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.constants import PHONE_BUCKET
from tessera.functions.normalize import blank_to_null, cluster_id, name_tokens
from tessera.operators.components import components
from tessera.operators.scratch import kept, stored

#: Key kinds by field, in the order in which they are merged; phones are last and conditional.
KINDS = {"candidate_ref": (0, "candidate_ref:"), "links.github": (1, "github:"), "emails": (2, "email:"), "phones": (3, "phone:")}


def identity_keys(observations: DataFrame) -> DataFrame:
    """(record_id, priority, key), distinct: the identity keys of each record."""
    value = blank_to_null(F.col("normalized_value"))
    priority, prefix = F.lit(None).cast("int"), F.lit(None).cast("string")
    for field, (p, text) in KINDS.items():
        priority = F.when(F.col("field_path") == field, p).otherwise(priority)
        prefix = F.when(F.col("field_path") == field, F.lit(text)).otherwise(prefix)
    return observations.select("record_id", priority.alias("priority"), F.concat(prefix, value).alias("key")).where("key is not null").distinct()


def phone_pairs(keys: DataFrame, observations: DataFrame, most: int = PHONE_BUCKET) -> DataFrame:
    """(key, a, b): pairs of records of a phone shared by at most ``most`` records, that share another key or a name.

    Larger buckets are left out before any pair is made.
    """
    phones = keys.where("priority = 3").select("key", "record_id")
    small = phones.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("key")
    few = phones.join(small, "key")
    pairs = kept(few.select("key", F.col("record_id").alias("a")).join(few.select("key", F.col("record_id").alias("b")), "key").where("a < b"))
    tokens = F.sort_array(name_tokens(F.col("normalized_value")))
    names = observations.where("field_path = 'full_name'").select("record_id", tokens.alias("t")).where("size(t) > 0").distinct().select("record_id", F.concat(F.lit("name:"), F.array_join("t", " ")).alias("why"))
    shared = keys.where("priority < 3").select("record_id", F.col("key").alias("why")).union(names)
    l, r = shared.select(F.col("record_id").alias("a"), "why"), shared.select(F.col("record_id").alias("b"), "why")
    return pairs.join(l, "a").join(r, ["b", "why"], "left_semi").select("key", "a", "b").distinct()


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """A component of records without reference that touches several reference groups: its keys in order, blocked where groups differ.

    Rows: kind k (priority, key, node a, refs of the node if it is a group) or p
    (an eligible phone pair of records ra and rb, of nodes a and b). Out: the
    root of each node (the group in it, if there is one), and warnings with
    their place in the order of keys.
    """
    parent: dict[str, str] = {}
    refs: dict[str, tuple] = {}
    group: dict[str, str] = {}
    said: list[tuple] = []
    emitted: set[tuple] = set()

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in pdf.itertuples():
        for x, held in ((r.a, r.refs), (r.b, r.refs_b)):
            if x is not None:
                find(x)
                if held is not None:
                    refs[x], group[x] = tuple(held), x

    def union(a: str, b: str, key: str, order: int, ra: str, rb: str) -> None:
        x, y = find(a), find(b)
        if x == y:
            return
        if x in refs and y in refs:
            mark = (*sorted((x, y)), key)
            if mark not in emitted:
                said.append((order, key, " ".join(sorted((group[x], group[y]))), ra, rb, _blocked(key, ra, rb, refs[x], refs[y])))
            emitted.add(mark)
            return
        low, high = sorted((x, y))
        parent[high] = low
        if high in refs:
            refs[low], group[low] = refs[high], group[high]

    keyed = pdf[pdf.kind == "k"].drop_duplicates(["key", "a"])
    for (order, key), own in sorted(keyed.groupby(["priority", "key"])):
        roots = sorted({find(a) for a in own.a})
        if len(roots) < 2:
            continue
        held = [x for x in roots if x in refs]
        free = [x for x in roots if x not in refs]
        joint = free if len(held) > 1 else [*held, *free]
        shown = sorted(refs[x] for x in held)
        for x in joint[1:]:
            union(joint[0], x, key, order, joint[0], x)
        if len(held) > 1:
            said.append((order, key, None, None, None, _ambiguous(key, shown[:5], len(shown), len(free))))
    for r in pdf[pdf.kind == "p"].sort_values(["key", "ra", "rb"]).itertuples():
        union(r.a, r.b, r.key, 3, r.ra, r.rb)
    rows = [(x, group.get(find(x), find(x)), None, None, None) for x in parent if x not in group or group[x] != x] + [(None, None, *s) for s in said]
    rows = [r if len(r) == 8 else (*r, None, None, None) for r in rows]
    return pd.DataFrame(rows, columns=["record_id", "root", "order", "key", "mark", "ra", "rb", "message"]).astype({"order": "Int32"})


def _blocked(key: str, ra: str, rb: str, x: tuple, y: tuple) -> str:
    return f"Entity resolution blocked merge on {key!r} between records {ra!r} and {rb!r}: contradictory candidate_ref values {list(x)!r} and {list(y)!r}."


def _ambiguous(key: str, shown: list[tuple], n: int, free: int) -> str:
    more = f" (+{n - 5} more)" if n > 5 else ""
    alone = f" {free} reference-free component(s) remain separate because their referenced identity is ambiguous." if free else ""
    return f"Entity resolution blocked merge on {key!r}: contradictory candidate_ref groups {shown!r}{more}.{alone}"


def _star(keyed: DataFrame) -> DataFrame:
    """Edges of each record to the smallest of its key."""
    return keyed.join(keyed.groupBy("key").agg(F.min("record_id").alias("a")), "key").select("a", F.col("record_id").alias("b"))


def resolve(observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record_cluster, clusters, warnings).

    record_cluster: record_id, cluster_id. clusters: cluster_id, record_ids,
    identity_keys (both sorted). warnings: order, key, message, in the order of
    keys once sorted by the first two. Clusters and warnings are worked out when they are read.

    Records that references tie form groups, which no other key can join with
    each other. So only records without reference carry the effect of one key to
    another: they are taken in components of their own, in which groups are mere
    labels. A component with one label or none joins it as a whole; only one
    that touches several labels is replayed in the order of its keys.
    """
    records = observations.select("record_id").distinct()
    keys = stored(identity_keys(observations))
    pairs = kept(phone_pairs(keys, observations))
    refs = keys.where("priority = 0")
    tied = components(_star(refs))
    held = stored(refs.select("record_id").distinct().join(tied.select(F.col("node").alias("record_id"), F.col("root").alias("g")), "record_id", "left").select("record_id", F.coalesce("g", "record_id").alias("g")))
    labels = held.join(refs, "record_id").groupBy("g").agg(F.array_sort(F.collect_set(F.expr("substring(key, length('candidate_ref:') + 1)"))).alias("refs"))
    members = stored(keys.where("priority in (1, 2)").join(held, "record_id", "left"))
    on = lambda k: held.select(F.col("record_id").alias(k), F.col("g").alias(f"g{k}"))
    tied_pairs = kept(pairs.join(on("a"), "a", "left").join(on("b"), "b", "left"))
    edges = _star(members.where("g is null").select("key", "record_id")).union(tied_pairs.where("ga is null and gb is null").select("a", "b"))
    flat = components(edges)
    free = stored(records.join(held, "record_id", "left_anti").join(flat.select(F.col("node").alias("record_id"), "root"), "record_id", "left").select("record_id", F.coalesce("root", "record_id").alias("c")))
    # All records without reference of a key are of one component.
    of_key = stored(members.where("g is null").join(free, "record_id").groupBy("priority", "key").agg(F.min("c").alias("c")))
    named = stored(members.where("g is not null").select("priority", "key", "g").distinct())
    beside = tied_pairs.where("(ga is null) <> (gb is null)").select(F.when(F.col("ga").isNull(), F.col("a")).otherwise(F.col("b")).alias("record_id"), F.coalesce("ga", "gb").alias("g")).join(free, "record_id").select("c", "g")
    touched = kept(named.join(of_key, ["priority", "key"]).select("c", "g").union(beside).groupBy("c").agg(F.min("g").alias("x"), F.max("g").alias("y")))
    # A component of one key alone, without pairs, needs no replay: its records join each other and no group.
    mixed = tied_pairs.where("ga is null or gb is null").select(F.when(F.col("ga").isNull(), F.col("a")).otherwise(F.col("b")).alias("record_id")).join(free, "record_id").select("c").distinct()
    several = touched.where("x <> y").select("c")
    plain = kept(of_key.join(several, "c", "left_semi").join(mixed, "c", "left_anti").groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("priority", "key")).alias("k")).where("n = 1").select("c", "k.*"))
    open_ = kept(several.join(plain, "c", "left_anti"))
    none = lambda t: F.lit(None).cast(t)
    shape = ["c", "kind", "priority", "key", "a", "refs", "b", "refs_b", "ra", "rb"]
    row = lambda df, kind, **k: df.select(*[(F.lit(kind) if c == "kind" else k.get(c, F.col(c) if c in df.columns else none("array<string>" if c.startswith("refs") else "string"))).alias(c) for c in shape])
    inside = free.join(open_, "c", "left_semi")
    lone = row(members.where("g is null").join(inside, "record_id"), "k", a=F.col("record_id"))
    groups = row(named.join(of_key, ["priority", "key"]).join(open_, "c", "left_semi").join(labels, "g"), "k", a=F.col("g"))
    node = lambda k: inside.select(F.col("record_id").alias(k), F.col("c").alias(f"c{k}"))
    of = lambda k: labels.select(F.col("g").alias(f"g{k}"), F.col("refs").alias(f"r{k}"))
    p = tied_pairs.join(node("a"), "a", "left").join(node("b"), "b", "left").where("ca is not null or cb is not null").join(of("a"), "ga", "left").join(of("b"), "gb", "left")
    p = p.withColumn("c", F.coalesce("ca", "cb")).select("c", "key", "a", "b", "ga", "gb", F.col("ra").alias("la"), F.col("rb").alias("lb"))
    paired = row(p, "p", priority=F.lit(3), a=F.coalesce("ga", "a"), b=F.coalesce("gb", "b"), refs=F.col("la"), refs_b=F.col("lb"), ra=F.col("a"), rb=F.col("b"))
    replayed = kept(lone.union(groups).union(paired).groupBy("c").applyInPandas(_replay, "record_id string, root string, order int, key string, mark string, ra string, rb string, message string"))
    settled = free.join(open_, "c", "left_anti").join(touched.where("x = y").select("c", F.col("x").alias("g")), "c", "left").select("record_id", F.coalesce("g", "c").alias("root"))
    final = stored(held.select("record_id", F.col("g").alias("root")).union(settled).union(replayed.where("record_id is not null").select("record_id", "root")))
    # Keys that join no group, and pairs of records with references: they contradict.
    lonely = free.join(plain, "c").groupBy("priority", "key").agg(F.count("*").alias("free"))
    alone = named.join(of_key.join(plain, "c", "left_anti"), ["priority", "key"], "left_anti")
    told = alone.groupBy("priority", "key").agg(F.count("*").alias("n")).where("n > 1").join(lonely, ["priority", "key"], "left").na.fill(0, ["free"])
    first = Window.partitionBy("priority", "key").orderBy("refs")
    few = alone.join(told, ["priority", "key"]).join(labels, "g").withColumn("k", F.row_number().over(first)).where("k <= 5").groupBy("priority", "key", "n", "free").agg(F.array_sort(F.collect_list("refs")).alias("shown"))
    # Two groups contradict once for each phone: by the first of the pairs that would have joined them.
    apart = tied_pairs.where("ga <> gb").join(of("a"), "ga").join(of("b"), "gb").select("key", F.concat_ws(" ", F.least("ga", "gb"), F.greatest("ga", "gb")).alias("mark"), F.col("a").alias("first"), F.col("b").alias("second"), "ra", "rb", none("string").alias("message"))
    marked = replayed.where("message is not null and order = 3").select("key", "mark", F.col("ra").alias("first"), F.col("rb").alias("second"), none("array<string>").alias("ra"), none("array<string>").alias("rb"), "message")
    once = apart.union(marked).groupBy("key", "mark").agg(F.min(F.struct("first", "second", "ra", "rb", "message")).alias("m")).select("key", "m.*")

    def ambiguous(batches):
        for b in batches:
            b["message"] = [_ambiguous(k, [tuple(x) for x in shown], n, free) for k, shown, n, free in zip(b.key, b.shown, b.n, b.free)]
            yield b[["order", "key", "message"]]

    def blocked(batches):
        for b in batches:
            b["message"] = [r.message or _blocked(r.key, r.first, r.second, r.ra, r.rb) for r in b.itertuples()]
            yield b.assign(order=3)[["order", "key", "message"]]

    out = "order int, key string, message string"
    warnings = replayed.where("message is not null and order < 3").select("order", "key", "message").union(few.withColumnRenamed("priority", "order").mapInPandas(ambiguous, out)).union(once.mapInPandas(blocked, out))
    # A cluster is named by its strong keys; one without any, by its records.
    strong = final.join(keys.where("priority < 3").select("record_id", "key"), "record_id", "left").groupBy("root").agg(F.collect_set("key").alias("strong"), F.collect_set(F.when(F.col("key").isNull(), F.concat(F.lit("record:"), "record_id"))).alias("bare"))
    names = stored(strong.select("root", cluster_id(F.when(F.size("strong") > 0, F.col("strong")).otherwise(F.col("bare"))).alias("cluster_id")))
    clusters = final.join(keys, "record_id", "left").groupBy("root").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"), F.array_sort(F.collect_set("key")).alias("identity_keys")).join(names, "root")
    record_cluster = final.join(names, "root").select("record_id", "cluster_id")
    return record_cluster, clusters.select("cluster_id", "record_ids", "identity_keys"), warnings
