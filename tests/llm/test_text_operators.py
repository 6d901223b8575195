"""Media, licence, BPE, quality: whole texts, edge rows, brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, licences, media, quality

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, feature string, labels string, score double, n_words long"
ROWS = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "no id"), (5, "long " * 60_000), (6, "x" * 70_000), (7, "é中\U0001f600 \u0000 end\n\n"), (8, " \t\n")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "f", "l", 0.5, 1) for i, t in rows], SCHEMA)


def test_media_round_trip(spark):
    got = media.media_columns(table(spark), keep_media=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        track = media.index(bytes(r.media))[0]
        back = media.samples(bytes(r.media), track)
        assert len(back) == r.payload_bytes and r.payload_bytes % 64 == 0 and r.payload_bytes >= 64
        assert hashlib.sha256(back).hexdigest() == r.payload_sha256 and zlib.crc32(back[-64:]) == r.tail_crc32
        assert set(back[r.n_bytes :]) <= {0} and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
        for k in r.keyframes:
            assert bytes(r.media)[k.offset : k.offset + k.size] in back
    by = {r.doc_id: r for r in got}
    assert by[1].payload_sha256 == by[2].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert media.media_columns(table(spark, [])).count() == 0


def test_media_damaged_and_varied_files():
    data = media.mux(media.pad(bytes(range(256)) * 40), per_chunk=7)
    for n in range(0, len(data), 97):
        media.index(data[:n])
    rnd = random.Random(1)
    for _ in range(200):
        b = bytearray(data)
        b[rnd.randrange(len(b) - 10000)] ^= 1 << rnd.randrange(8)
        media.index(bytes(b))
    assert media.index(b"") == [] and media.index(b"not a file at all") == []


def licence_brute(text):
    import regex

    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_licences_against_brute_force(spark):
    rnd = random.Random(2)
    parts = ["GNU General Public License", "Apache License", "MIT license", "CC BY", "CC-BY-NC 4.0", "mit", "license", "x", "é", ",", "\n", "1", "gnu", "SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0)\n"]
    rows = ROWS + [(100 + i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(300)]
    for r, (_, text) in zip(sorted(licences.scan(table(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licence_expressions():
    assert licences.parse("mit or apache-2.0 and bsd") == ["mit", "apache-2.0", "bsd", "and", "or"]
    assert licences.parse("(mit") is None and licences.parse("mit or") is None and licences.parse("mit bsd") is None and licences.parse("") is None
    assert licences.evaluate(licences.parse("(a or b) and c")) == ({"c"}, set("abc"))
    assert licences.evaluate(licences.parse("a or b")) != licences.evaluate(licences.parse("a and b"))
    assert licences.evaluate(licences.parse("gpl-2.0 with x")) == ({"gpl-2.0 with x"}, {"gpl-2.0 with x"})
    many = " and ".join(f"(a{i} or b{i})" for i in range(500))
    assert licences.evaluate(licences.parse(many + " and c"))[0] == {"c"}
    assert licences.tagged(" (mit or bsd) and more words")[0] == "(mit or bsd) and more"


def test_bpe_is_the_librarys(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(3)
    rows = ROWS[:5] + [(i, "".join(rnd.choice(["a", "th", "e", "ing", " ", "  ", "\n", "\t", "é", "中", "1", ".", "'s", "\0", "は", "\xa0"]) for _ in range(rnd.randint(0, 60)))) for i in range(10, 300)]
    for by_space in (True, False):
        for r in bpe.encoded(table(spark, rows), path, public_tokenizers.PATTERN, keep_ids=True, by_space=by_space).collect():
            texts = [t for i, t in rows if i == r.doc_id]
            ids = own.encode_ordinary(texts[0] or "")
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((texts[0] or "").encode()).hexdigest()


def test_bpe_long_pieces():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own, mine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Bpe(ranks)
    rnd = random.Random(4)
    for _ in range(20):
        piece = "".join(rnd.choice("abcdeth") for _ in range(3000))
        assert mine.encode(piece.encode()) == own.encode_ordinary(piece)


def test_quality_learns_and_holds_out(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9)))
    good = [" ".join(word() for _ in range(rnd.randint(20, 80))) + "." for _ in range(150)]
    bad = [" ".join(word() + rnd.choice(["###", "$$$", "!!"]) for _ in range(rnd.randint(20, 80))) for _ in range(50)]
    rows = list(enumerate(good + bad)) + [(900, None), (901, ""), (None, "no id"), (902, "x" * 50_000)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    ranker = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.scored(docs, ranker).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and not any(got[i].held_out for i in range(200) if i not in held)
    assert np.mean([got[i].predicted == int(i < 150) for i in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    flat = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.scored(docs, flat).collect()} == {0.5}


def test_licence_evaluation_equals_listing_every_way():
    import random

    rng = random.Random(2)

    def ways(postfix):
        stack = []
        for t in postfix:
            if t not in ("and", "or"):
                stack.append([frozenset([t])])
                continue
            b, a = stack.pop(), stack.pop()
            stack.append(a + b if t == "or" else [x | y for x in a for y in b])
        return stack[0]

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("abcd")
        return f"({expression(depth - 1)} {rng.choice(['and', 'or'])} {expression(depth - 1)})"

    for _ in range(300):
        postfix = licences.parse(expression(3))
        every = ways(postfix)
        assert licences.evaluate(postfix) == (set(frozenset.intersection(*every)), set(frozenset.union(*every)))


def test_media_index_answers_for_any_bytes():
    import random

    rng = random.Random(6)
    whole = media.mux(media.pad(b"x" * 1000, media.UNIT), media.UNIT)
    deep = b""
    for _ in range(3000):
        deep = (len(deep) + 8).to_bytes(4, "big") + b"moov" + deep
    cases = [deep, b"", b"\0" * 40, whole[:-1]]
    for _ in range(1500):
        raw = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(min(len(raw), 700))] = rng.choice([0, 1, 255, rng.randrange(256)])
        cases.append(bytes(raw[: rng.choice([len(raw), rng.randrange(len(raw))])]))
    for kind in (b"mdhd", b"stz2", b"stsz", b"stsc", b"stco"):
        inner = (8).to_bytes(4, "big") + kind
        cases.append((len(inner) + 8).to_bytes(4, "big") + b"trak" + inner)
    for data in cases:
        for t in media.index(data):
            media.samples(data, t)
