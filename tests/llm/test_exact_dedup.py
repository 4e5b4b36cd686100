import hashlib
import os
import random

from bioquery.llm import exact_dedup as ed


def test_grace_spills_and_compares_contents(tmp_path):
    r = random.Random(1)
    contents = [f"text {i}".encode() * 20 for i in range(300)]
    records = [(hash_ << 40, c, i) for i, (hash_, c) in enumerate((r.randrange(1 << 20) if k % 3 else 5, c) for k, c in enumerate(contents * 3))]
    records = [(int.from_bytes(hashlib.md5(c).digest()[:8], "big") if i % 2 else 7 << 50, c, v) for i, (_, c, v) in enumerate(records)]
    codes = {}
    records = [(codes.setdefault(c, code), c, v) for code, c, v in records]  # equal contents have equal hashes; others may share one
    for held in (0, 100):
        groups, whole = {}, {}
        for number, code, content, value in ed.grace(iter(records), budget=20_000, held=held, folder=str(tmp_path)):
            if content is None:
                assert number not in whole
                groups.setdefault(number, []).append(value)
            else:
                whole[number] = code, content
        assert sorted(map(sorted, groups.values())) == sorted([k, k + 300, k + 600] for k in range(300))
        assert all(records[v][:2] == whole[k] for k, g in groups.items() for v in g)
    assert not os.listdir(tmp_path)


def test_against_plain(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "", "A b", "a B", "É", "é", "x" * 5000, f"t{r.randrange(40)}"])) for i in range(500)] + [(None, "a b"), (None, "only"), (3, "t1"), (3, "t1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as grp", "2 as code").repartition(5)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = sorted(((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=str)
    got = ed.deduplicate(df, budget=2000).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=str) == want
    assert all(x.kept == (x.doc_id is not None and x.doc_id == x.keep_id) for x in got)
    assert ed.deduplicate(df.limit(0)).count() == 0


def test_ids_of_one_content_take_no_room():
    import tracemalloc

    tracemalloc.start()
    n = sum(1 for _ in ed.grace((5, b"same", i) for i in range(300_000)))
    assert n == 300_001
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()


def test_very_long_texts(spark):
    long = "Word " * 2_000_000
    df = spark.createDataFrame([(1, long), (2, long.lower()), (3, long + "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in ed.deduplicate(df).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
