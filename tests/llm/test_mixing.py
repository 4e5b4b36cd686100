import numpy as np
import pytest

from bioquery.llm import mixing


def test_rake_meets_all_margins():
    r = np.random.default_rng(1)
    counts = r.integers(1, 1000, 60).astype(float)
    codes = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    shares = [r.dirichlet(np.ones(k)) for k in (5, 4, 3)]
    mass = counts * mixing.rake(counts, codes, shares)
    for code, share in zip(codes, shares, strict=True):
        assert np.bincount(code, mass) / counts.sum() == pytest.approx(share, abs=1e-9)


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", None][i % 3], ["en", "de"][i % 2]) for i in range(4000)] + [(None, None, "a", "en"), (1, "w ", "b", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as n_tokens", "2 as weight")
    got = mixing.mix(df, {"source": {"a": 0.6, "b": 0.3, "(none)": 0.1}, "lang": {"en": 0.5, "de": 0.5}}, rate=0.4).collect()
    assert len(got) == len(rows)
    total = sum(x.n_tokens for x in got)
    assert sum(x.n_tokens * x.weight for x in got if x.source == "a") / total == pytest.approx(0.6, abs=1e-6)
    assert sum(x.n_tokens * x.weight for x in got if x.lang == "en") / total == pytest.approx(0.5, abs=1e-6)
    kept = sum(x.n_tokens for x in got if x.kept and x.source == "a")
    assert kept == pytest.approx(sum(x.n_tokens * x.probability for x in got if x.source == "a"), rel=0.1)
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cells"):
        mixing.mix(df, max_cells=2)


def test_probabilities_hold_the_margins(spark):
    """Rare categories are lifted past probability 1 at this rate if cells are only clipped."""
    rows = [(i, "w " * (3 if i % 50 else 150), "rare" if i % 40 == 0 else "hot" if i % 3 else "other", "de" if i % 11 == 0 else "en") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"rare": 0.2, "hot": 0.5, "other": 0.3}, "lang": {"en": 0.7, "de": 0.3}}
    got = mixing.mix(df, targets, rate=0.3).collect()
    assert max(0.3 * r.weight for r in got) > 1
    assert max(r.probability for r in got) <= 1
    total = sum(r.n_tokens * r.probability for r in got)
    for margin, shares in targets.items():
        for name, share in shares.items():
            assert sum(r.n_tokens * r.probability for r in got if r[margin] == name) / total == pytest.approx(share, rel=1e-4)


def test_sampled_tokens_have_the_target_shares(spark):
    """What is drawn, not only what is expected; and the report agrees with it."""
    rows = [(i, "w " * (20 + i % 5), "rare" if i % 40 == 0 else "hot" if i % 3 else "other", "de" if i % 11 == 0 else "en", "x" if i % 2 else None) for i in range(60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    targets = {"source": {"rare": 0.05, "hot": 0.6, "other": 0.35}, "lang": {"en": 0.8, "de": 0.2}, "topic": {"x": 0.5, "(none)": 0.5}}
    drawn = [r for r in mixing.mix(df, targets, rate=0.4, topic_column="kind").collect() if r.kept]
    total = sum(r.n_tokens for r in drawn)
    report = {(r.margin, r.category): r for r in mixing.margins(df, targets, rate=0.4, topic_column="kind").collect()}
    for margin, shares in targets.items():
        for name, share in shares.items():
            assert sum(r.n_tokens for r in drawn if r[margin] == name) / total == pytest.approx(share, rel=0.05)
            assert report[margin, name].expected == pytest.approx(share, rel=0.005)
            assert report[margin, name].weighted == pytest.approx(share, rel=1e-6)


def test_columns_with_clashing_names_stay(spark):
    rows = [(i, None if i == 3 else "w " * i, "a", None, f"s{i}", i, "t") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __source string, __KEPT long, __tokens string")
    got = mixing.sample(df, rate=0.5)
    assert got.columns == df.columns
    kept = got.collect()
    assert 0 < len(kept) < 200
    assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}


def test_very_long_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "w " * 3_000_000, "a", "en"), (2, "", "a", "en"), (2, "", "a", "en")], "doc_id long, text string, source string, lang string")
    got = sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "n_tokens").collect())
    assert got == [(1, 3_000_000), (2, 0), (2, 0)]


def test_calibrate_lowers_a_rate_that_no_cells_can_hold():
    counts, codes = np.array([10.0, 990.0]), [np.array([0, 1])]
    weights = mixing.rake(counts, codes, [np.array([0.5, 0.5])])
    p, used = mixing.calibrate(counts, codes, weights, 0.5)
    assert p == pytest.approx([1, 10 / 990], rel=1e-3)
    assert used == pytest.approx(0.02, rel=1e-3)
