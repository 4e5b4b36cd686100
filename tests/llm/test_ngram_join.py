import random
import re

import numpy as np
import pytest

from bioquery.llm import ngram_join as nj


def brute(rows, width, numerator, denominator):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n, vocabulary=400):
    r = random.Random(seed)
    base = [[f"w{r.randrange(vocabulary)}" for _ in range(r.choice([1, 2, 3, 5, 9, 20, 45, 80, 200, 500]))] for _ in range(n // 4)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE")]
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 12])):
            at = r.randrange(len(w))
            if r.random() < 0.4 and len(w) > 1:
                del w[at]
            else:
                w[at] = f"x{r.randrange(50)}"
        rows.append((10 + i, r.choice([" ", "  ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize(("width", "numerator", "seed"), [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_equals_brute_force(spark, width, numerator, seed):
    rows = corpus(seed, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "2 as component")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df, width, numerator, 100, block=8, split_above=12 if seed < 3 else 10**6).collect())
    assert got == brute(rows, width, numerator, 100)


def test_chain_of_near_copies(spark):
    """Neighbours link, others need not: the tiles hold several components before the blocks are compared."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = words[1:] + [f"n{i}"] if i % 2 else words
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df, block=8).collect())
    assert got == brute(rows, 3, 90, 100)


def test_bands_cover_linked_sizes():
    for numerator in (60, 80, 90, 95):
        t = nj.Threshold(numerator)
        for size in range(1, 3000):
            assert t.edge(t.band(size)) <= size < t.edge(t.band(size) + 1)
            mine = {b for b, _, _ in t.bands(size)}
            for other in {t.smallest(size), size, (t.smallest(size) + size) // 2}:
                assert mine & {b for b, _, _ in t.bands(other)}


def test_empty_table(spark):
    assert nj.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packed_members_of_shared_tiles():
    """Tasks send a frequent tile once each; what several sets share comes out whole, and nothing else."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(5)
    tiles = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    tasks = [(tiles[np.append(r.integers(0, 300, 120), [7] * 50)], r.integers(0, 40, 170).astype(np.uint64)) for _ in range(4)]
    parts = pd.concat([nj._packed(t, d, 16).to_pandas() for t, d in tasks])
    got = pd.concat([nj._shared_members(p) for _, p in parts.groupby("bucket")])
    members = {(int(t), int(d)) for task in tasks for t, d in zip(*task, strict=True)}
    owners = {}
    for t, d in members:
        owners.setdefault(t, set()).add(d)
    got = {(int(np.int64(t).view(np.uint64)), int(d)) for t, d in zip(got["tile"], got["node"], strict=True)}
    assert got == {(t, d) for t, d in members if len(owners[t]) > 1}


def test_packing_without_shared_tiles():
    """A task may hold no tile with several members."""
    tile, node = np.arange(1, 40, dtype=np.uint64) << np.uint64(50), np.arange(39, dtype=np.uint64)
    rows = nj._packed(tile, node, 4).to_pandas()
    assert not rows["shared"].any()
    assert len(nj._shared_members(rows)) == 0


def test_classes_that_share_a_name(spark, monkeypatch):
    rows = corpus(7, 60)
    real = nj._digest
    monkeypatch.setattr(nj, "_digest", lambda grams: (len(grams) % 3, real(grams)[1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)
