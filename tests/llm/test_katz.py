import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bioquery.llm import katz, words


def plain(rows, held, order=2):
    """The same model with dictionaries and recursion; also checks that every context sums to 1."""
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split()
    texts = {i: [*low(t), "</s>"] for i, t in rows}
    grams = lambda t, n: zip(*[(["<s>"] * (n - 1) + t)[k:] for k in range(n)], strict=False)
    counts = [Counter(g for i, t in texts.items() if not held(i) for g in grams(t, n)) for n in range(1, order + 1)]
    context = [Counter() for _ in counts]
    for c, of in zip(counts, context, strict=True):
        for g, v in c.items():
            of[g[:-1]] += v
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.CUTOFF + 2)]
    discounts = [katz.Discounts(of(c)) for c in counts]
    mass = lambda n, g: float(discounts[n].mass(counts[n][g]))
    total = sum(counts[0].values())
    unknown = 1 - sum(mass(0, g) for g in counts[0]) / total if total else 1.0
    after = [defaultdict(list) for _ in counts]
    for n, c in enumerate(counts):
        for g in c:
            after[n][g[:-1]].append(g[-1])
    alphas = {}

    def p(h, w):
        n = len(h)
        if counts[n][(*h, w)]:
            return mass(n, (*h, w)) / context[n][h]
        if not n:
            return unknown
        if not context[n][h]:
            return p(h[1:], w)
        if h not in alphas:
            seen = after[n][h]
            alphas[h] = (1 - sum(p(h, x) for x in seen)) / (1 - sum(p(h[1:], x) for x in seen))
        return alphas[h] * p(h[1:], w)

    one = counts[0]
    for h in list(after[-1])[:20]:
        assert sum(p(h, w) for (w,) in one) + p(h, object()) == pytest.approx(1, abs=1e-9)
    out = {}
    for i, t in texts.items():
        base = sum(math.log10((one[w,] + 1) / (total + len(one) + 1)) for w in t)
        out[i] = (held(i), len(t), sum(one[w,] > 0 for w in t), total, base, sum(math.log10(p(g[:-1], g[-1])) for g in grams(t, order)))
    return out


@pytest.mark.parametrize(("order", "keys"), [(2, 2 << 20), (2, 100), (3, 150), (4, 2 << 20)])
def test_equals_dictionaries(spark, monkeypatch, order, keys):
    """Few keys a part make many parts, so that contexts of many words are dealt by both."""
    monkeypatch.setattr(katz, "KEYS_A_PART", keys)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 4000)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=r.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "never Seen W1 w1"), (1003, "É é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as held").repartition(3)
    got = {x.doc_id: x for x in katz.score(df, F.col("doc_id") % 4 == 3, order=order).collect()}
    want = plain(rows, lambda i: i % 4 == 3, order)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base, value) in want.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, total)
        assert x.base_score == pytest.approx(base, rel=1e-9)
        assert x.score == pytest.approx(value, rel=1e-8, abs=1e-8)


def test_repeated_rows_and_a_very_long_text(spark):
    long = "one two three " * 700_000
    rows = [(1, "one two"), (1, "one two"), (2, long)]
    got = sorted((x.doc_id, x.n_tokens, x.train_tokens) for x in katz.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), order=3).collect())
    assert got == [(1, 3, 2_100_007), (1, 3, 2_100_007), (2, 2_100_001, 2_100_007)]


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert {x.doc_id: (x.n_tokens, x.train_tokens) for x in katz.score(df, F.lit(False)).collect()} == {None: (3, 4), 1: (1, 4)}
    assert [x.score for x in katz.score(df, F.lit(True)).collect()] == [0.0, 0.0]
    assert katz.score(df.limit(0), F.lit(False)).count() == 0


def test_scratch_of_counting(monkeypatch):
    """What a task that counts pairs holds at most, and that its answers go in small batches."""
    r = np.random.default_rng(1)
    n, heads = 400_000, 100_000
    asks = []
    for _ in range(4):
        own = lambda k: np.sort(r.integers(0, 1 << 63, k, dtype=np.uint64))
        asks.append(katz._pack(first=own(heads), hot=np.zeros(heads, dtype=bool), run=np.full(heads, n // heads, dtype=np.uint8), second=katz._top_bytes(own(n)), seen=np.ones(n, dtype=np.uint8), single=np.ones(n, dtype=np.uint8)))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, type=pa.int32()), pa.array(range(4)), pa.array(asks, type=pa.binary())], names=["part", "block", "ask"])
    unigrams = katz.Unigrams(10, 5, [1] * (katz.CUTOFF + 1), 0)
    list(katz._count_grams(unigrams)([batch]))
    tracemalloc.start()
    list(katz._count_grams(unigrams)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("bytes a pair", peak / (4 * n))
    assert peak < 100 * 4 * n
    monkeypatch.setattr(katz, "BATCH_BYTES", 1000)
    assert [b.num_rows for b in katz._answers([(k, 0, bytes(600)) for k in range(5)])] == [2, 2, 1]


def test_scratch_of_a_block():
    """What the pairs of a block take at most."""
    r = np.random.default_rng(1)
    vocabulary = np.unique(np.append(r.integers(0, 1 << 63, 50_000, dtype=np.uint64), words.END))
    n = 1_000_000
    texts = katz._pack(ids=np.arange(1000), known=np.ones(1000, dtype=bool), held=np.zeros(1000, dtype=np.uint8), lengths=np.full(1000, n // 1000, dtype=np.uint16), index=r.integers(0, len(vocabulary), n, dtype=np.uint32))
    own = katz._pack(vocabulary=vocabulary, counts=np.full(len(vocabulary), 20, dtype=np.uint8))
    unigrams = katz.Unigrams(10 * n, len(vocabulary), [1] * (katz.CUTOFF + 1), 0)
    katz.Block(texts, own, unigrams, 50)
    tracemalloc.start()
    katz.Block(texts, own, unigrams, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("bytes a token", peak / n)
    assert peak < 80 * n
