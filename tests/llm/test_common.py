import random

import numpy as np
import pytest

from bioquery.llm import common, words


@pytest.mark.parametrize("shape", ["random", "path", "star", "pairs"])
@pytest.mark.parametrize("task_edges", [7, 10**6])
def test_components(spark, monkeypatch, shape, task_edges):
    monkeypatch.setattr(common, "EDGES_A_TASK", task_edges)
    r = random.Random(5)
    edges = {
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)],
        "path": [(i, i + 1) for i in range(50)],
        "star": [(49, i) for i in range(45)],
        "pairs": [(i, i + 100) for i in range(30)] + [(3, 3), (None, 4)],
    }[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in common.components(spark, spark.createDataFrame(edges, "a long, b long"), common.Store(spark)).collect()}
    assert got == {x: find(x) for x in parent}


def test_word_hashes_are_those_of_the_words():
    import pyarrow as pa

    texts = ["The cat", None, "", "the  CAT\nthe\tÉ é", " x", "cat"]
    seen = {}
    rows = []
    for _, raw, offsets in words.chunks(pa.array(texts)):
        hashes, row = words.word_hashes(words.lower(raw), offsets)
        rows += row.tolist()
    expected = [(i, w) for i, t in enumerate(texts) for w in "".join(c.lower() if c.isascii() else c for c in t or "").split()]
    assert rows == [i for i, _ in expected]
    for h, (_, w) in zip(hashes.tolist(), expected, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(words.shingles(hashes, 3)) == len(hashes) - 2
    assert len(words.shingles(hashes[:2], 3)) == 1
    assert len(words.shingles(np.zeros(0, dtype=np.uint64), 3)) == 0


def test_star_round_the_largest_id(spark, monkeypatch):
    """One end of more edges than a task takes is dealt to several."""
    monkeypatch.setattr(common, "EDGES_A_TASK", 50)
    edges = spark.createDataFrame([(10_000, k) for k in range(1, 400)] + [(20_000, 5), (30_000, 30_001)], "a long, b long")
    got = {r.node: r.component for r in common.components(spark, edges, common.Store(spark)).collect()}
    assert got == {**{k: 1 for k in range(1, 400)}, 10_000: 1, 20_000: 1, 30_000: 30_000, 30_001: 30_000}


def test_a_task_gives_freed_memory_back(spark):
    """100 MB freed in small pieces, below one that stays, leave the worker."""

    def small_pieces(batches):
        pieces = [bytes(1000) for _ in range(100_000)]
        yield from batches
        kept.append(bytes(bytearray(1000)))
        del pieces

    kept, lean = [], common.lean(small_pieces)

    def measured(batches):
        import re
        from pathlib import Path

        import pyarrow as pa

        for batch in batches:
            after = []
            for run in (small_pieces, lean):
                assert [b.num_rows for b in run(iter([batch]))] == [1]
                after.append(int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in after], names=["plain", "lean"])

    row = spark.range(1).coalesce(1).mapInArrow(measured, "plain long, lean long").first()
    assert row["plain"] - row["lean"] > 60


def test_tables_of_long_values_have_small_groups(spark, tmp_path):
    """A reader holds a group of rows at a time."""
    import pyarrow.parquet as pq

    rows = spark.range(24, numPartitions=1).selectExpr("id", "cast(repeat(cast(id as string), 600000) as binary) as value")
    stored = common.Store(spark).put(rows, "long", "none", common.BLOBS)
    (file,) = (f.removeprefix("file://") for f in stored.inputFiles())
    meta = pq.ParquetFile(file).metadata
    assert max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 8 << 20
    assert sorted(r.id for r in stored.collect()) == list(range(24))
