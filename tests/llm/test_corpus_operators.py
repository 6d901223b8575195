"""Near duplicates, lines, passages, pages, vectors and the pipeline, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import html, lines, minhash, neighbours, passages

RND = random.Random(7)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def words(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


def edited(w, k):
    w = list(w)
    for _ in range(k):
        w[RND.randrange(len(w))] = RND.choice(VOCABULARY)
    return w


def documents():
    rows, n = [], 0
    for _ in range(25):
        base = words(RND.randint(40, 200))
        for k in range(RND.randint(1, 5)):
            w = edited(base, RND.choice([0, 0, 1, 2, 5]))
            rows.append((n, "\n".join(" ".join(w[i : i + 17]) for i in range(0, len(w), 17))))
            n += 1
    shared = words(60)
    for _ in range(4):
        rows.append((n, " ".join(words(30) + edited(shared, 2) + words(30))))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE "), (n + 4, "a b c"), (n + 5, " \n "), (5, rows[5][1]), (None, "without an id"), (n + 6, " ".join(words(20_000)))]


ROWS = documents()


def table(spark, rows=None):
    return spark.createDataFrame([(i, t, "e", 1, 2, "s") for i, t in (ROWS if rows is None else rows)], "doc_id long, text string, node string, h1 long, th long, gone string")


def shingles(text, k=5):
    w = (text or "").lower().split()
    k = min(k, len(w)) or 1
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jp(a, b):
    every = set(a) | set(b)
    if not a or not b:
        return float(a == b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in set(a) & set(b))


def test_classes_against_brute_force(spark):
    rows = [(i, t) for i, t in ROWS if i is not None and len(t or "") < 5000]
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and (set(sets[x]) & set(sets[y]) or not (sets[x] or sets[y])) and jp(sets[x], sets[y]) >= 0.8:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in minhash.classes(table(spark, rows)).collect()}
    assert got == {i: find(i) for i in ids}
    kept = minhash.near_duplicates_removed(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in ids})
    assert minhash.classes(table(spark, [])).count() == 0


def test_classes_keep_all_rows(spark):
    got = minhash.classes(table(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)


def test_group_blocks_find_all_links():
    sets = [minhash.weighted(t or "", minhash.WordHashes()) for _, t in ROWS[:60]]
    for split in (None, 20):
        a, b = (sets, None) if split is None else (sets[:split], sets[split:])
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in minhash.links_between(a, b):
            x, y = find(i), find(j + (split or 0))
            root[max(x, y)] = min(x, y)
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if (split is None or i < split <= j) and minhash.similarity(sets[i], sets[j]) >= 0.8:
                    assert find(i) == find(j)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(1, 2**60, 300).astype(np.uint64))
    b = np.sort(np.r_[a[:200], rng.integers(1, 2**60, 80).astype(np.uint64)])
    wa, wb = rng.integers(1, 4, len(a)).astype(float), rng.integers(1, 4, len(b)).astype(float)
    s = minhash.registers([a, b], [wa, wb], 8192)
    assert abs((s[0] == s[1]).mean() - minhash.similarity((a, wa), (b, wb))) < 0.03


def test_lines_against_brute_force(spark):
    rows = [(i, t) for i, t in ROWS if i is not None and len(t or "") < 5000]
    rows += [(9000, rows[0][1] + "\nA  tab\there\n\n"), (9001, "a tab here"), (9002, "\n\n")]
    seen, expected = [], {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        if t is None:
            expected[i] = (None, 0, 0)
            continue
        kept, gone = [], 0
        for line in t.split("\n"):
            s = frozenset(shingles(line))
            late = bool(s) and any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen)
            gone += late
            if not late:
                kept.append(line)
            if s:
                seen.append(s)
        expected[i] = ("\n".join(kept) if gone else t, t.count("\n") + 1, gone)
    got = lines.deduplicated(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_lines, r.n_removed) == expected[r.doc_id], r.doc_id
    assert lines.stage(table(spark, rows)).columns == table(spark, rows).columns
    assert lines.deduplicated(table(spark, [])).count() == 0


def test_lines_rarity_is_of_a_sample_and_only_orders(spark, monkeypatch):
    one_id = spark.range(4000).selectExpr("1L as doc_id", "concat('text ', id) as text")
    one_text = spark.range(4000).selectExpr("id as doc_id", "'the same text' as text")
    for docs in (one_id, one_text):
        assert 350 < lines.sampled(docs).count() < 650  # an eighth is 500
    rows = [(i, t) for i, t in ROWS if len(t or "") < 5000]
    cut = lambda: sorted((str(r.doc_id), str(r.text), r.n_removed) for r in lines.deduplicated(table(spark, rows)).collect())
    expected = cut()
    for rarity in (bytes(lines.SKETCH), bytes(i % 128 for i in range(lines.SKETCH))):
        monkeypatch.setattr(lines, "sketch", lambda _, r=rarity: r)
        assert cut() == expected


def test_lines_run_no_python(spark):
    plan = lines.deduplicated(table(spark, ROWS[:3]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_passages_cover_all_repeats(spark):
    rows = [(i, t) for i, t in ROWS if i is not None]
    got = passages.passages(table(spark, rows)).collect()
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.run_start, r.run_end))
        assert r.other_id < r.doc_id and r.identity >= 0.8
    seen = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").lower().split()
        grams = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, g in enumerate(grams):
            if g in seen and seen[g] < i:
                # The earliest holder of a seed may deviate near an end that a later one shares.
                assert len(set(range(k, k + 50)) - covered.get(i, set())) <= 5, i
        for g in grams:
            seen.setdefault(g, i)
    cut = {r.doc_id: r.text for r in passages.repeated_removed(table(spark, rows)).collect() if r.doc_id is not None}
    for i, t in rows:
        if i not in covered:
            assert cut[i] == t
    assert passages.passages(table(spark, [])).count() == 0


def test_fuzzy_passage_is_found(spark):
    base = words(80)
    rows = [(1, " ".join(words(50) + base + words(50))), (2, " ".join(words(20) + base[:30] + words(2) + base[32:55] + base[56:] + words(20))), (3, " ".join(words(200)))]
    got = passages.passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2, 1)}
    assert got[0].run_start <= 20 and got[0].run_end >= 98


def test_cut_texts_go_out_in_bounded_slices():
    import pyarrow as pa

    from tessera.llm.common import SLICE_CHARS

    n = 4000
    texts = [None if i % 100 == 7 else "" if i % 100 == 8 else " ".join(f"{i}w{k}" for k in range(300)) for i in range(n)]
    spans = [[{"run_start": 10, "run_end": 60}, {"run_start": 290, "run_end": 400}] if i % 50 == 0 else [{"run_start": 0, "run_end": 300}] if i % 50 == 1 else [] if i % 50 == 2 else None for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([{"doc_id": i} for i in range(n)]), pa.array(texts), pa.array(spans, pa.list_(pa.struct({"run_start": pa.int32(), "run_end": pa.int32()})))], ["__row", "text", "__spans"])
    got = []
    for b in passages.without_spans(iter([batch])):
        assert sum(len(t or "") for t in b["text"].to_pylist()) <= SLICE_CHARS
        got += zip(b["__row"].to_pylist(), b["text"].to_pylist(), b["gone"].to_pylist())
    assert len(got) == n
    for i, (row, text, gone) in enumerate(got):
        w = (texts[i] or "").split()
        expected = texts[i]
        if i % 50 == 0:
            expected = " ".join(w[:10] + w[60:290])
        elif i % 50 == 1:
            expected = None
        assert (row, text, gone) == ({"doc_id": i}, expected, i % 50 == 1), i


def test_passages_with_foreign_words_between(spark):
    rnd = random.Random(11)
    own = lambda n: ["".join(rnd.choice("klmnopqrst") for _ in range(9)) for _ in range(n)]
    rows, pairs = [], {}
    for n in (30, 50, 80, 100):
        for both in (False, True):
            a, b, at = own(60), own(60), 2 * len(pairs)
            rows.append((at, " ".join(own(40) + a + own(n) + b + own(40))))
            rows.append((at + 1, " ".join(own(20) + a + (own(n) if both else []) + b + own(20))))
            pairs[at + 1] = (n, both)
    covered = {}
    for r in passages.passages(table(spark, rows)).collect():
        assert r.other_id == r.doc_id - 1 and r.identity >= 0.8
        covered.setdefault(r.doc_id, set()).update(range(r.run_start, r.run_end))
    for d, (n, both) in pairs.items():
        second = 80 + (n if both else 0)
        assert set(range(20, 80)) | set(range(second, second + 60)) <= covered[d], (n, both)
        assert n == 30 or len(covered[d]) <= 126, (n, both)


def test_parts_inside_an_anchor():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**32, 300).astype(np.uint32), rng.integers(0, 2**32, 300).astype(np.uint32)
    b[20:80] = a[20:80]
    for k in range(96, 200, 24):
        b[k : k + 8] = a[k : k + 8]
    got = passages.parts(a, b, [(20, 20, 180)], 20, 0.8)
    assert any(s <= 20 and e >= 80 for s, e, *_ in got)
    assert all(same >= 0.8 * max(e - s, u - t) for s, e, t, u, same in got)


def test_html(spark):
    nav = "<nav><ul><li>Home</li><li>About us all</li></ul></nav><div class='cookie-notice'>We use cookies</div>"
    art = lambda t: f"<html><head><title>x</title></head><body>{nav}<article><h1>{t} &amp; co</h1><p>Body  of\n{t}<p>Second</article><footer>f</footer>"
    bare = lambda t: f"<div>Home News Sport Weather Contact Page</div><p>{' '.join(t + str(k) for k in range(9))}</p><div>All rights reserved by this host</div>"
    pages = [(1, "http://a.com/1", art("one")), (2, "http://a.com/2", art("one")), (3, "http://b.com/1", bare("alpha")), (4, "http://b.com/2", bare("beta")), (5, "http://b.com/3", bare("gamma")), (6, None, None), (7, "odd", ""), (8, "http://c.com", "plain < text &lt;b&gt; <script>no()</script><!-- c -->"), (8, "http://c.com", "<p>" + "w " * 100_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    got = html.main_text(df).collect()
    assert len(got) == len(pages)
    by = {(r.page_id, r.n_chars > 1000): r.text for r in got}
    assert by[1, False] == by[2, False] == "one & co\nBody of one\nSecond"
    assert by[3, False] == " ".join(f"alpha{k}" for k in range(9)) and by[5, False].startswith("gamma")
    assert by[6, False] == "" and by[7, False] == "" and by[8, False] == "plain < text <b>"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(df.where("false")).count() == 0


def test_html_repetition_decides_beside_and_in_articles():
    foot = "<p>All rights reserved by this one host</p>"
    more = "<p>Read our daily letter for more of this</p>"
    own = lambda k: " ".join(f"{k}{i}" for i in range(12))
    page = lambda k: f"<p>{own('intro' + k)}</p><article><p>{own(k)}</p><p>{own(k + k)}</p>{more}</article>{foot}"
    got = html._group([html.blocks(page(k)) for k in "abc"], html.RUN, html.PAGES)
    for k, (text, removed) in zip("abc", got):
        assert text == "\n".join([own("intro" + k), own(k), own(k + k)]) and removed == 15
    copies = [f"<article><p>{own('x')}</p><p>{own('y')}</p></article><p>{own(k)}</p>" for k in "de"]
    assert all(own("x") in t and own("y") in t for t, _ in html._group(list(map(html.blocks, copies)), html.RUN, html.PAGES))


def test_html_does_not_depend_on_the_size_of_groups(spark):
    own = lambda k: " ".join(f"{k}w{i}" for i in range(12))
    rows = []
    for k in range(60):
        pair = k // 2
        box = f"<p>one block that pair {pair} of this host shares</p>"
        inside = f"<article><p>{own(f'a{k}')}</p><p>{own(f'b{k}')}</p>{box}</article>" if k % 4 < 2 else f"<p>{own(f'c{k}')}</p>{box}"
        rows.append((k, f"http://big.com/{k}", inside))
    rows += [(100, "http://big.com/100", rows[0][2]), (101, "http://small.com/", "<p>only page</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, html.main_text(df).collect()))
    assert all("shares" not in r[2] for r in whole)
    assert sorted(map(tuple, html.main_text(df, group=5).collect())) == whole
    assert sorted(map(tuple, html.main_text(df, least=3, group=5).collect())) == sorted(map(tuple, html.main_text(df, least=3).collect()))


def test_html_names_inside_articles():
    kept = '<h2 id="related-work">A</h2><section id="search-methods">B</section><p id="social-effects">C</p><div class="share-price-table">D</div><h3 id="notice-period">E</h3><p class="comment">F</p>'
    gone = '<div class="share-buttons">S</div><section class="related-posts">R</section><div class="x comments">M</div><div class="ad">N</div><div role="search">Q</div>'
    assert html.blocks(f"<article>{kept}{gone}</article>") == [(t, 2) for t in "ABCDEF"] + [(t, 0) for t in "SRMNQ"]
    assert html.blocks('<div id="cookie-notice">S</div>') == [("S", 0)]


def test_suffix_classes_are_equal_beginnings():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 200)
    for depth, rank in html.suffix_ranks(tokens, [1, 2, 3, 4, 5, 8]):
        keys = [tuple(tokens[i : i + depth]) + (-1,) * (depth - len(tokens[i : i + depth])) for i in range(200)]
        assert all((rank[i] == rank[j]) == (keys[i] == keys[j]) for i in range(0, 200, 3) for j in range(200))


def test_covered_equals_brute_force():
    rng = random.Random(8)

    def brute(parsed, run, pages):
        kinds = list({tuple(b): None for b in parsed})
        streams = [[w for t, s in b if s != 2 for w in t.split()] for b in kinds]
        at = [[tuple(s[i : i + run]) for i in range(len(s) - run + 1)] for s in streams]
        out = []
        for b in parsed:
            k, place, got = kinds.index(tuple(b)), 0, []
            repeated = {i + j for i, r in enumerate(at[k]) if sum(r in a for a in at) >= pages for j in range(run)}
            for t, s in b:
                n = len(t.split())
                whole = s == 2 and n >= run and sum((t, 2) in o for o in kinds) >= pages
                got.append((0 if s == 2 else sum(place + i in repeated for i in range(n)), whole))
                place += 0 if s == 2 else n
            out.append(got)
        return out

    for _ in range(150):
        pool = [" ".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 4, 5, 9, 40]))) for _ in range(6)]
        parsed = [[(rng.choice(pool), rng.choice([0, 1, 2])) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(7))]
        for pages in (2, 3):
            assert html.covered(parsed, 4, pages) == brute(parsed, 4, pages)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) + rng.integers(0, 8, 3000)[:, None]
    x[7] = x[9] = x[11]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(4000, None, 0), (4100, [0.0] * 16, 0), (4200, [float("nan")] * 16, 0), (4300, [1.0] * 5, 0), (None, x[0].tolist(), 0), (4400, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = neighbours.search(df).collect()
    v = x.astype(np.float32).astype(float)
    recall = []
    for q in range(0, 3000, 100):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(3000), d))[:10]
        recall.append(len(set(true) & {r.vec_id for r in own}) / 10)
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
    assert {r.query_id for r in got} == set(range(0, 3000, 100)) and np.mean(recall) >= 0.9
    assert neighbours.search(df.where("false")).count() == 0
    few = neighbours.search(df.where("vec_id <= 4")).collect()
    assert len(few) == 4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(c.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/s{k}")
        at = spark.read.parquet(f"{tmp_path}/s{k}")
    assert at.count() == c.run(spark, str(tmp_path)).count() > 0


def test_chain_scores_equal_those_of_comparing_all():
    import random

    from tessera.llm import passages as P

    def slow(anchors):
        score = []
        for i, (x, y, n) in enumerate(anchors):
            before = [score[j] + P.GAP_COST * (u + v + 2 * m - x - y) for j, (u, v, m) in enumerate(anchors[:i]) if u + m <= x and v + m <= y and max(x - u - m, y - v - m) <= P.GAP_MOST]
            score.append(n + max([0, *before]))
        return score

    rng = random.Random(5)
    cases = [[(0, 0, 504), *[(654 + 12 * i, 654 + 12 * i, 8) for i in range(4)]]]
    cases += [sorted({(rng.randrange(900), rng.randrange(900), rng.choice([8, 20, 90])) for _ in range(rng.randrange(1, 40))}) for _ in range(200)]
    for anchors in cases:
        assert P._scores(anchors)[0] == pytest.approx(slow(anchors))


def test_minimizers_are_those_of_all_windows():
    import random

    from tessera.llm import passages as P

    rng = random.Random(3)
    for n in (0, 5, 8, 9, 23, 24, 300):
        h = np.array([rng.randrange(1, 30) for _ in range(n)], np.uint64)
        got = P.minimizers(h)
        if n < P.K:
            assert not len(got)
            continue
        g = P.mix(P.windows(h, P.K))
        g = g & ~np.uint64(0xFFFFF) | np.arange(len(g)).astype(np.uint64)
        w = min(P.WINDOW, len(g))
        assert got.tolist() == sorted({i + int(g[i : i + w].argmin()) for i in range(len(g) - w + 1)})


def test_neighbours_of_a_repeated_query(spark):
    rows = [(int(i), [float(i), 1.0]) for i in range(1, 60)] + [(100, [5.0, 1.0]), (100, [30.0, 1.0]), (200, [7.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), k=5).collect()
    assert sorted(r["rank"] for r in got if r.query_id == 100) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert {r.vec_id for r in got if r.query_id == 100} >= {5, 30, 4, 6, 29, 31}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 200), key=lambda r: r["rank"])][:2] == [7, 6]
