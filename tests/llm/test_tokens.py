import random
from pathlib import Path

import pytest

from brindle.llm import bpe, packing

HAVE = Path(bpe.DEFAULT_RANKS).exists()
needs = pytest.mark.skipif(not HAVE, reason="no vocabulary file")
TEXTS = ["", None, "Hello, world!", " \n\n  x ", "<|endoftext|> is text", "Zażółć gęślą jaźń 🙂🙂", "a" * 20_000, "ab" * 9000, "=-" * 5000, "日本語テキスト", "don't we'll I'm", "\x00\x01 ﻿", "0123456789" * 50, "   " * 40 + "end"]


@needs
def test_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(bpe.DEFAULT_RANKS).with_suffix(".json")))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice("abc ABC\n\t'.,;12éß🙂") for _ in range(rng.randrange(200))) for _ in range(300)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.encoder().encode(x) for x in texts] == want


@needs
def test_frame(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")
    rows = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert rows[0] == [] and rows[1] == [] and len(rows) == len(TEXTS)
    assert {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()} == {k: len(v) for k, v in rows.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def _check(spark, sizes, kinds, **kw):
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "doc_id bigint, tokens bigint, bin_id int").repartition(4)
    bins = packing.pack(df, kinds, **kw)
    rows = packing.assignments(bins).collect()
    for kind, cap in kinds:
        mine = [r for r in rows if r.container == kind]
        per_doc, per_bin = {}, {}
        for r in mine:
            per_doc.setdefault(r.doc_id, []).append((r.part, r.tokens))
            per_bin[r.bin_id] = per_bin.get(r.bin_id, 0) + r.tokens
        assert set(per_doc) == set(range(len(sizes))) and max(per_bin.values(), default=0) <= cap
        for i, n in enumerate(sizes):
            parts = sorted(per_doc[i])
            assert sum(t for _, t in parts) == max(n or 0, 0) and [p for p, _ in parts] == list(range(len(parts)))
            assert len(parts) == max(1, -(-max(n or 0, 0) // cap))
    return {r.container: r for r in packing.summary(bins).collect()}


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 60, 200, 511, 512, 513, 3000]) for _ in range(800)] + [None, -3, 100_000]
    s = _check(spark, sizes, [("s", 512), ("m", 2048)], block=100, merge_bins=10)
    assert s["m"].fill > 0.9
    s = _check(spark, [rng.randrange(20, 300) for _ in range(1500)], [("s", 512)])
    assert s["s"].fill > 0.97


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), [("s", 10)]).count() == 0
    _check(spark, [0] * 50, [("s", 10)])
    _check(spark, [6] * 40, [("s", 10)])
    for bad in ([], [("s", 0)], [("s", None)]):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 1)], "doc_id bigint, tokens bigint"), bad)


def test_best_fit_takes_the_tightest_bin():
    fit = packing.BestFit(10)
    bins = [fit.add(n) for n in (6, 7)]
    assert fit.add(3) is bins[1] and fit.add(4) is bins[0] and len(fit.take(0)) == 2
