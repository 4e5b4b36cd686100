import numpy as np

from bioquery.llm import vector_dedup as vd


def brute(rows):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True):
        a, b = good[i][0], good[j][0]
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def vectors(seed, n, d=16, groups=40):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, d))
    out = []
    for i in range(n):
        c = centre[r.integers(groups) if r.random() < 0.7 else 0]
        v = c + r.normal(size=d) * r.choice([0, 0.05, 0.15, 0.6])
        out.append((i * 3, [float(x) for x in v.astype(np.float32)]))
    return out


def test_links_against_brute_force(spark):
    rows = vectors(1, 1500) + [(7001, None), (7002, []), (7003, [0.0] * 16), (7004, [float("nan")] + [1.0] * 15), (7005, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "2 as same")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vd.link(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == (0, k, True) for k in range(7001, 7006))
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert all(got[k][0] <= want[k][0] for k in got)
    assert sum(got[k][1] == want[k][1] for k in got) >= 0.99 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(want)


def test_any_number_of_lengths(spark):
    """70 lengths of a few vectors each; every length is searched."""
    r = np.random.default_rng(5)
    rows = []
    for d in range(2, 72):
        v = r.normal(size=d)
        rows += [(10 * d + k, [float(x) for x in v + 0.02 * k]) for k in range(3)] + [(10 * d + 3, [float(-x) for x in v])]
    want = {}
    for d in range(2, 72):
        want |= brute([x for x in rows if x[0] // 10 == d])
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vd.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_graph_recall():
    r = np.random.default_rng(3)
    x = vd._unit(r.normal(size=(3000, 24)))
    graph = vd.Graph(x)
    ids, _ = graph.search(x[:300] + 0.01, 64)
    truth = np.argsort(-(x[:300] + 0.01) @ x.T, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) >= 9


def test_planted_duplicates_at_scale(spark, capsys):
    """20,000 vectors with planted near copies: recall of links against brute force, and what the audits report."""
    r = np.random.default_rng(11)
    x = r.normal(size=(20_000, 32)).astype(np.float32)
    for k in range(0, 3000, 3):  # near copies of the one before, some of them near the threshold
        x[k + 1] = x[k] + r.normal(size=32) * r.choice([0.02, 0.1, 0.3])
    x[15_000:15_400] = x[15_000] + r.normal(size=(400, 32)) * 0.05  # a dense group
    x[16_000:16_050] = x[16_000]  # exact copies
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    truth = np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), 2000):
        hit = unit[at : at + 2000] @ unit.T >= 0.95
        truth[at : at + 2000] = hit.sum(axis=1) - 1
    out, audits = vd.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6), report=True)
    got = {a.vec_id: a.n_links for a in out.collect()}
    found = sum(min(got[i], int(n)) for i, n in enumerate(truth)) / truth.sum()
    with capsys.disabled():
        print(f" recall {found:.5f} of {truth.sum() // 2} links")
    assert found >= 0.99
    assert all(got[i] <= n for i, n in enumerate(truth))
    report = audits.collect()
    assert {a.kind for a in report} == {"probes", "queries"}
    assert sum(a.found_links for a in report) >= 0.99 * sum(a.true_links for a in report) > 0


def test_rows_of_a_dense_group_grow_with_its_members(spark):
    from bioquery.llm import common

    r = np.random.default_rng(2)
    x = r.normal(size=(1, 16)) + r.normal(size=(1500, 16)) * 0.02
    rows = [(i, [float(v) for v in row], 1, f"{i}", i * 7919 % 1500) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "node long, v array<double>, copies long, same string, h long")
    assert vd._links(df, len(rows), common.Store(spark), 0.95, 24, 0.99).where("kind < 3").count() < 6 * 1500  # 1.1 million pairs
    got = vd.link(df.select(df.node.alias("vec_id"), df.v.alias("embedding"))).collect()
    assert {(a.n_links, a.component_id) for a in got} == {(1499, 0)}


def test_null_and_repeated_ids_and_ties(spark):
    rows = [(None, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, None), (9, [0.0, -1.0])]
    got = sorted((str(a.vec_id), a.n_links, str(a.component_id), a.kept) for a in vd.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([("None", 0, "None", False), ("5", 2, "5", True), ("6", 2, "5", False), ("6", 2, "5", False), ("None", 0, "None", False), ("9", 0, "9", True)])
    tie = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [19.0, 6.0, 1.0, 1.0])]
    a, b = np.array(tie[0][1]), np.array(tie[1][1])
    cosine = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    linked = {x.vec_id: x.n_links for x in vd.link(spark.createDataFrame(tie, "vec_id long, embedding array<double>"), threshold=cosine).collect()}
    assert linked == {1: 1, 2: 1}


def test_empty_table(spark):
    assert vd.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
