"""Packing: plans over counts, token pieces, placed pieces."""

import random
import zlib

import pytest

from tessera.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_a_gapless_packing_of_all_counts(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([8, 16, 64, 2048])
    counts = {rnd.randint(1, cap): rnd.randint(1, rnd.choice([3, 50, 1000])) for _ in range(rnd.randint(1, min(cap, 200)))}
    bins, ranks = {}, {}
    for length, rank, n, first, each, at in packing.plan(counts, cap):
        for j in range(n):
            ranks.setdefault(length, []).append(rank + j)
            bins.setdefault(first + j // each, []).append((at + (j % each) * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    for items in bins.values():
        place = 0
        for at, length in sorted(items):
            assert at == place
            place += length
        assert place <= cap
    # best-fit decreasing over single items makes as many bins
    rooms = []
    for length in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((r, i) for i, r in enumerate(rooms) if r >= length) if any(r >= length for r in rooms) else None
        if fit:
            rooms[fit[1]] -= length
        else:
            rooms.append(cap - length)
        if len(rooms) > 3000:
            return
    assert len(bins) == len(rooms)


TEXTS = ["", None, "Hello, WORLD!", "don't Stop... it's 42°C", "É'Éa.b,c!!", "a" * 3000 + " b", "ΑΣ ΟΔΟΣ. Σ", "İstanbul été", "x\x1cy <|endoftext|> z", "中文 テスト。", "one two " * 2500, "Don'T. we'LL! 3rd?"]


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = spark.createDataFrame([(i, x, "e") for i, x in enumerate(TEXTS)], "doc_id long, text string, piece string")
    got = packing.packed(packing.pieces(docs, path, keep_ids=True)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        rows = sorted(by[i], key=lambda r: r.piece)
        assert [v for r in rows for v in r.ids] == ids
        assert [r.start for r in rows] == list(range(0, len(ids), 2048))
        for r in rows:
            assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in r.ids))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in seqs.values():
        place = 0
        for at, length in sorted(items):
            assert at == place
            place += length
        assert place <= 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_word_ids_equal_the_tokenizer_on_odd_texts():
    import random
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    ids_of = packing.word_ids(path)
    rng = random.Random(1)
    letters = "abcXYZ 'sStTrvemld  .,!?&%12 34ÀÉéßİıŸſɐʰ̀Σσ ­²½ª\xa0\x00\x01\x7f\x80\x85\x9f˿ͅ中\n\t\x1c "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["", "<|endoftext|> <|startoftext|>", "it's we've I'll"]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert ids_of(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_plan_comes_without_python_workers(spark):
    cut = spark.range(50).selectExpr("id as doc_id", "id as row", "0 as piece", "id % 7 + 1 as length")
    made = packing.packed(cut, 16)
    assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 50
