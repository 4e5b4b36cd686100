import glob
import os
import pathlib

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bioquery.operators import records, signal
from bioquery.plans import catalogue
from bioquery.sources.signal import samples

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    value = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(value(v) for _, v in sorted(r.items())) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = [r.asDict() for r in catalogue.queries()[name](spark, SF).collect()]
    result = duck.sql(catalogue.oracle_sql()[name])
    want = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert plain(got) == plain(want)


def test_partitions_do_not_matter(spark):
    df = samples(spark, SF)
    for n in (1, 7):
        part = df.repartition(n)
        assert signal.lift_levels(part).exceptAll(signal.lift_levels(df)).count() == 0
        assert signal.noise_floor(part).exceptAll(signal.noise_floor(df)).count() == 0


def test_blocks_do_not_matter(spark):
    """Channels dealt in blocks give what whole channels give, at borders too."""
    df = samples(spark, SF)
    quiet = df.withColumn("x", F.when(F.abs("x") < 3000, 0).otherwise(F.col("x")))
    for name, make in {
        "difference": lambda size: signal.first_difference(df, size=size),
        "trend": lambda size: signal.trend(df, size=size),
        "lift": lambda size: signal.lift(df, size=size),
        "unlift": lambda size: signal.unlift(signal.lift(df), size=size),
        "levels": lambda size: signal.lift_levels(df, size=size),
        "runs": lambda size: signal.zero_runs(quiet, size=size),
    }.items():
        whole = plain(r.asDict() for r in make(1 << 20).collect())
        assert plain(r.asDict() for r in make(64).collect()) == whole, name
    assert plain(r.asDict() for r in signal.unlift(signal.lift(df)).collect()) == plain(r.asDict() for r in df.collect())


def test_long_zero_runs_cross_blocks(spark):
    df = spark.createDataFrame([("a", t, 0 if 3 <= t < 40 or t == 50 else 1) for t in range(64)], "ch string, t long, x long")
    assert sorted((r.start_t, r.len) for r in signal.zero_runs(df, size=8).collect()) == [(3, 37), (50, 1)]


def test_digest_of_several_recordings(spark):
    import hashlib

    rows = [("r1", "b", 0, -1), ("r1", "a", 1, 5), ("r1", "a", 0, 7), ("r2", "a", 0, 2)]
    df = spark.createDataFrame(rows, "rec string, ch string, t long, x long")
    want = {r: hashlib.sha256(b"".join(x.to_bytes(8, "little", signed=True) for _, _, _, x in sorted(row for row in rows if row[0] == r))).hexdigest() for r in ("r1", "r2")}
    assert {r.rec: r.digest for r in signal.digest(df, ("rec",)).collect()} == want


def test_recursive_predictor_is_undone(spark):
    rows = catalogue.queries()["rls_roundtrip"](spark, SF).collect()
    x = {(r.ch, r.t): r.x for r in samples(spark, SF).collect()}
    assert {(r.ch, r.t): r.z for r in rows} == x
    assert any(r.y != r.z for r in rows)


def test_selection_fails_closed(spark):
    df = samples(spark, SF)
    with pytest.raises(PySparkException, match="no channel"):
        signal.select_channels(df, ["absent"]).collect()
    with pytest.raises(PySparkException, match="range ends"):
        signal.time_range(df, 0, 10**6).collect()
    with pytest.raises(ValueError, match="after start"):
        signal.time_range(df, 5, 5)


def test_hash_chain(spark):
    rows = {r.log: r.first_broken for r in catalogue.queries()["hash_chain_verify"](spark, SF).collect()}
    turns = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{SF}/conversations.parquet").where("text is not null").collect()}
    assert rows == {i: 1 for i, turn in turns if turn == 1 and i % 7 == 0} | {i: 0 for i, turn in turns if turn == 0 and i % 11 == 3}


def test_hash_chain_covers_whole_messages(spark):
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    assert max(len(t or "") for t in texts.values()) > 60
    assert {(r.log, r.line): r.msg for r in catalogue._log(spark, SF).collect()} == texts


def test_all_orders_are_events(spark):
    rows = catalogue.queries()["events_on_clock"](spark, SF).collect()
    assert {r.kind for r in rows} == {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    assert max(r.n for r in rows) > 400


def test_every_block_is_transformed(spark):
    sizes = {r.vec_id: len(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = catalogue.queries()["wht_level"](spark, SF).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in rows} == {i: 32 * -(-n // 32) for i, n in sizes.items()}
    df = spark.createDataFrame([(1, [1.0] * 33), (2, []), (3, None), (4, [2.0] * 32)], "id int, v array<double>")
    got = sorted((r.id, r.block, r.v) for r in signal.blocks32(df).collect())
    assert got == [(1, 0, [1.0] * 32), (1, 1, [1.0] + [0.0] * 31), (4, 0, [2.0] * 32)]


def test_every_channel_has_a_column(spark):
    channels = {r.ch for r in samples(spark, SF).select("ch").distinct().collect()}
    assert set(catalogue.queries()["export_wide"](spark, SF).columns) == channels | {"t"}


def test_running_totals_of_one_key(spark):
    rows = [("a", f"p{k:04d}", k % 7) for k in range(500)] + [("b", "x", 3), ("b", "y", 4)]
    df = spark.createDataFrame(rows, "archive string, path string, compressed_size long").repartition(5)
    for ranges in (1, 7, 64):
        got = {(r.archive, r.path): r.offset for r in records.offsets(df, ranges=ranges).collect()}
        assert got == {(a, p): sum(n for b, q, n in rows if b == a and q < p) for a, p, _ in rows}
    assert records.offsets(df.limit(0)).count() == 0


def test_sidecar_fields(spark):
    recordings = spark.createDataFrame([("r", "s/eeg", ["sub-1", "task-a"])], "rec string, dir string, ents array<string>")
    side = spark.createDataFrame([("", [], 1, 2), ("s", ["sub-1"], None, 3), ("s/eeg", ["task-b"], 9, 9)], "dir string, ents array<string>, a int, b int")
    r = records.sidecar_fields(recordings, side, ["a", "b"]).first()
    assert (r.a, r.b) == (1, 3)


def test_nothing_imports_the_language_operators():
    for path in glob.glob("bioquery/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "bioquery.llm" not in pathlib.Path(path).read_text()


def test_sidecars_are_matched_by_kind(spark):
    """Many alike sidecars and recordings cost rows in proportion to them, not to their pairs."""
    n = 3000
    recordings = spark.range(n).select(F.col("id").alias("rec"), F.lit("s").alias("dir"), F.array(F.lit("task-a"), F.concat(F.lit("run-"), F.col("id") % 3)).alias("ents"))
    side = spark.range(n).select(F.when(F.col("id") == 0, "").otherwise("s").alias("dir"), F.when(F.col("id") == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("run-"), F.col("id") % 2))).alias("ents"), F.col("id").alias("a"))
    out = records.sidecar_problems(recordings, side, ["a"])
    assert {(r.rec % 3, r.problem) for r in out.collect()} == {(0, "ambiguous at /s"), (1, "ambiguous at /s"), (2, None)}
    assert {r.a for r in out.where("rec % 3 = 2").collect()} == {0} and out.count() == n
    pairs = out._jdf.queryExecution().executedPlan()
    out._jdf.queryExecution().toRdd().count()
    rows, todo = [], [pairs]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        if "Join" in name:
            rows.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert rows and max(rows) <= 4 * n


@pytest.mark.parametrize("kind", [0, 1])
def test_sidecars_equal_brute_force(spark, kind):
    import random

    rng = random.Random(kind)
    some = lambda: rng.sample(["sub-1", "sub-2", "task-a", "run-1", None], rng.randrange(4))
    place = lambda: rng.choice(["", "s", "s/e", "s/e/x", "t", "se"])
    recs = [(rng.randrange(40), place(), some()) for _ in range(60)]
    sides = [(place(), some(), k if k % 3 else None) for k in range(12)]
    over = lambda a, b: a in ("", b) or b.startswith(a + "/")
    want = {}
    for rec in {r[0] for r in recs}:
        mine = {(d, frozenset(e)) for r, d, e in recs if r == rec}
        fits = [(s, a) for d, e in mine for s, of, a in sides if over(s, d) and set(of) <= e]
        twice = sorted({s for s, _ in fits if sum(s == o for o, _ in fits) > 1})
        sets = [(len(s), a) for s, a in fits if a is not None]
        want[rec] = f"ambiguous at /{twice[0]}" if twice else max(sets)[1] if sets else "missing a"
    rows = records.sidecar_problems(spark.createDataFrame(recs, "rec long, dir string, ents array<string>"), spark.createDataFrame(sides, "dir string, ents array<string>, a long"), ["a"]).collect()
    assert {r.rec: r.problem or r.a for r in rows} == want and len(rows) == len(want)


def test_places_by_ranges(spark):
    rows = [(None if k % 11 == 0 else "ab"[k % 2], None if k % 13 == 0 else (k * 7919) % 40, k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, a int, b long").repartition(5)
    for ranges in (1, 7, 64):
        got = {r.b: r.t for r in records.places(df, ["k"], ["a", "b"], "t", ranges).collect()}
        first = lambda r: (r[1] is not None, r[1] or 0, r[2])
        assert got == {r[2]: sum(first(q) < first(r) for q in rows if q[0] == r[0]) for r in rows}
    assert records.places(df.limit(0), ["k"], ["a"], "t").count() == 0


def test_samples_are_numbered_by_many_tasks(spark):
    """No window of the numbering has a whole channel."""
    plan = samples(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(event_type" in plan and "__range" in plan.split("row_number() windowspecdefinition(", 1)[1].split(" ASC", 1)[0]


def test_digest_gets_packed_samples(spark):
    """What one task puts in order are runs, not samples; any cut of them gives one digest."""
    import hashlib

    df = samples(spark, SF)
    runs = signal.packed(df, ("ch",), size=64).collect()
    n = df.count()
    assert len(runs) <= n // 64 + 5 and sum(len(r.x) for r in runs) == 8 * n
    rows = sorted((r.ch, r.t, r.x) for r in df.collect())
    want = hashlib.sha256(b"".join(x.to_bytes(8, "little", signed=True) for _, _, x in rows)).hexdigest()
    assert b"".join(r.x for r in sorted(runs, key=lambda r: (r.ch, r.t))) == b"".join(x.to_bytes(8, "little", signed=True) for _, _, x in rows)
    assert [r.digest for r in signal.digest(df).collect()] == [want]


def test_recursive_predictor_by_blocks(spark):
    """Blocks between resets, each with the samples before it, give the residual of the whole channel."""
    import numpy as np

    from bioquery.operators import kernels

    x = np.random.default_rng(3).integers(-900, 900, 500)
    df = spark.createDataFrame([(c, t, int(v) * k) for c, k in (("a", 1), ("b", -2)) for t, v in enumerate(x)], "ch string, t long, x long").repartition(5)
    got = {(r.ch, r.t): r.y for r in kernels.rls_by_blocks(df, reset=64).collect()}
    assert got == {(c, t): int(y) for c, k in (("a", 1), ("b", -2)) for t, y in enumerate(kernels.rls_residual(x * k, reset=64))}
