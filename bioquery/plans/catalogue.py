"""All registered queries over the driver's tables, each beside its SQL."""

from pyspark.sql import functions as F

from bioquery.functions import scalar
from bioquery.operators import kernels, records, signal
from bioquery.sources import signal as source

S = source.SAMPLES_SQL
B = source.CHANGED_SQL
_SPARK, _SQL = {}, {}


def query(sql=None):
    def add(f):
        _SPARK[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    from bioquery.plans import containers  # noqa: F401  adds its own

    return dict(_SPARK)


def oracle_sql():
    from bioquery.plans import containers  # noqa: F401

    return dict(_SQL)


def _s(spark, sf):
    return source.samples(spark, sf)


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(f"WITH {S} SELECT ch, min(x) AS min_x, max(x) AS max_x, round(avg(x), 6) AS mean_x, round(stddev_pop(x), 6) AS std_x, count(*) AS n FROM s GROUP BY ch")
def channel_stats(spark, sf):
    return signal.stats(_s(spark, sf)).withColumns({"mean_x": F.round("mean_x", 6), "std_x": F.round("std_x", 6)})


@query(f"""WITH {S}, m AS (SELECT ch, list_sort(list(x))[count(*) // 2 + 1] AS median_x FROM s GROUP BY ch)
  SELECT s.ch, median_x, list_sort(list(abs(x - median_x)))[count(*) // 2 + 1] AS mad FROM s JOIN m USING (ch) GROUP BY s.ch, median_x""")
def noise_floor_mad(spark, sf):
    return signal.noise_floor(_s(spark, sf))


@query(f"WITH {S} SELECT count(DISTINCT ch) AS n_channels, count(*) AS n_samples, max(t) + 1 AS longest, (max(t) + 1) / 250.0 AS duration_s, count(*) * 2 AS raw_i16, count(*) * 8 AS raw_i64 FROM s")
def recording_summary(spark, sf):
    n = F.count("*")
    return _s(spark, sf).agg(F.countDistinct("ch").alias("n_channels"), n.alias("n_samples"), (F.max("t") + 1).alias("longest"), ((F.max("t") + 1) / F.lit(250.0)).alias("duration_s"), (n * 2).alias("raw_i16"), (n * 8).alias("raw_i64"))


@query(f"WITH {S}, w AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'view')) v(pos, ch)) SELECT pos, ch, t, x FROM s JOIN w USING (ch)")
def select_channels(spark, sf):
    return signal.select_channels(_s(spark, sf), ["view", "click", "view"])


@query(f"WITH {S} SELECT ch, t, x FROM s WHERE t >= 20 AND t < 150")
def time_range_slice(spark, sf):
    return signal.time_range(_s(spark, sf), 20, 150)


@query(f"WITH {S} SELECT ch, t, x FROM s WHERE t // 100 = 1")
def read_window(spark, sf):
    return signal.read_window(_s(spark, sf), 1, 100)


@query(f"""WITH {S}, w AS (SELECT * FROM (VALUES (0, 'click'), (1, 'absent')) v(pos, ch)), g AS (SELECT unnest(range(0, (SELECT max(t) + 1 FROM s))) AS t)
  SELECT pos, ch, t, coalesce(x, 0) AS x FROM g CROSS JOIN w LEFT JOIN s USING (ch, t)""")
def mask_gather(spark, sf):
    return signal.gather(_s(spark, sf), ["click", "absent"])


@query(f"WITH {S} SELECT ch, t, round(x * (400.0 / 65535) + (-200.0 + 32768 * (400.0 / 65535)), 6) AS value, 0.0 AS flat FROM s")
def calibrate_affine(spark, sf):
    one = lambda low, high: scalar.calibrate("x", F.lit(-200.0), F.lit(200.0), F.lit(low), F.lit(high))
    return _s(spark, sf).select("ch", "t", F.round(one(-32768, 32767), 6).alias("value"), one(5, 5).alias("flat"))


@query(f"WITH {S} SELECT ch, t, x >> 3 AS stripped, (x >> 3) * 8 AS restored FROM s")
def noise_bits_strip(spark, sf):
    return _s(spark, sf).select("ch", "t", scalar.strip_bits("x", 3).alias("stripped"), scalar.restore_bits(scalar.strip_bits("x", 3), 3).alias("restored"))


@query(f"WITH {S} SELECT ch, t, least(greatest(x * 10, -32768), 32767) AS y, x * 10 NOT BETWEEN -32768 AND 32767 AS clamped FROM s")
def clamp_int16(spark, sf):
    y = F.col("x") * 10
    return _s(spark, sf).select("ch", "t", scalar.clamp16(y).alias("y"), (scalar.clamp16(y) != y).alias("clamped"))


@query(f"WITH {S} SELECT ch, t // 100 AS win, count(*) AS n, sum(x)::BIGINT AS sum_x, min(x) AS min_x, max(x) AS max_x FROM s GROUP BY ALL")
def tumbling_window_stats(spark, sf):
    return signal.windows(_s(spark, sf), 100)


@query("""SELECT o_orderkey, CASE WHEN r > 16384 THEN 2500 ELSE least(greatest(r, 2500), 65535) END::BIGINT AS size
  FROM (SELECT o_orderkey, ceil(o_totalprice * 250.0 / 500.0) AS r FROM orders)""")
def auto_window_size(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", scalar.auto_window("o_totalprice", F.lit(500.0)).alias("size"))


@query(f"WITH {S}, l AS (SELECT ch, max(t) + 1 AS n FROM s GROUP BY ch) SELECT ch, least(t // greatest(n // 7, 1), 6) AS chunk, count(*) AS n, min(t) AS first_t FROM s JOIN l USING (ch) GROUP BY ALL")
def split_chunks(spark, sf):
    return signal.split(_s(spark, sf), 7).groupBy("ch", "chunk").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query("SELECT 6 AS n_rows, 6 AS n_chunks, 0 AS first, 6 AS last, false AS complete")
def chunk_coverage(spark, sf):
    chunks = signal.split(_s(spark, sf), 7).select("chunk").distinct().where("chunk <> 3")
    return signal.coverage(chunks, 7)


@query(f"""WITH {S}, {B}, l AS (SELECT ch, max(t) + 1 AS n FROM s GROUP BY ch)
  SELECT ch, t, x FROM s UNION ALL SELECT ch, t + n, x FROM b JOIN l USING (ch)""")
def concat_recordings(spark, sf):
    a = _s(spark, sf)
    return signal.concat([a, source.changed(a)])


_DIFF = f"{S}, {B}, d AS (SELECT t // 100 AS win, coalesce(s.ch, b.ch) AS ch, t, s.x AS xa, b.x AS xb FROM s FULL JOIN b USING (ch, t) WHERE s.x IS DISTINCT FROM b.x)"


@query(f"WITH {_DIFF} SELECT ch, t, win, xa IS NULL OR xb IS NULL AS missing, coalesce(xa, 0) AS xa, coalesce(xb, 0) AS xb FROM d")
def signal_diff(spark, sf):
    a = _s(spark, sf)
    out = signal.diff(a, source.changed(a), 100).withColumn("missing", F.col("xa").isNull() | F.col("xb").isNull())
    return out.fillna(0, ["xa", "xb"])


@query(f"""WITH {_DIFF}, f AS (SELECT * FROM d ORDER BY win, ch, t LIMIT 1)
  SELECT (SELECT count(*) FROM d) AS n_diff, (SELECT count(DISTINCT win) FROM d) AS windows_differ,
  (SELECT max(t) // 100 + 1 FROM s) - (SELECT count(DISTINCT win) FROM d) AS windows_match, win AS first_win, ch AS first_ch, t AS first_t FROM f""")
def signal_diff_summary(spark, sf):
    a = _s(spark, sf)
    return signal.diff_summary(a, source.changed(a), 100)


_W = "w AS (SELECT ch, t // 500 AS win, t, x FROM s)"


def _w(spark, sf, size=500):
    return _s(spark, sf).withColumn("win", F.expr(f"t div {size}"))


@query(f"WITH {S}, {_W} SELECT ch, win, t, x, x - floor(coalesce(sum(x) OVER (PARTITION BY ch, win ORDER BY t ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING), 0) / 32)::BIGINT AS y FROM w")
def bias_cancel(spark, sf):
    return signal.bias_cancel(_w(spark, sf)).select("ch", "win", "t", "x", "y")


@query(f"WITH {S}, {_W} SELECT ch, win, t, x - floor(coalesce(sum(x) OVER (PARTITION BY ch, win ORDER BY t ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING), 0) / 32)::BIGINT AS y, x AS z FROM w")
def bias_restore(spark, sf):
    """The cancelled values y and what is restored from them alone."""
    cancelled = signal.bias_cancel(_w(spark, sf)).select("ch", "win", "t", "y")
    return kernels.per_group(cancelled, kernels.bias_restore, value="y", out="z long")


_COEFFICIENTS = (240_000_000, -110_000_000)


_RESIDUAL = f"""WITH {S}, {_W}, p AS (SELECT *, lag(x, 1) OVER o AS x1, lag(x, 2) OVER o AS x2 FROM w WINDOW o AS (PARTITION BY ch, win ORDER BY t))
  SELECT ch, win, t, CASE WHEN x2 IS NULL THEN x ELSE x - ((x1 * {_COEFFICIENTS[0]} + x2 * {_COEFFICIENTS[1]}) >> 27) END AS y FROM p"""


@query(_RESIDUAL)
def lpc_residual_order2(spark, sf):
    return signal.lpc_residual(_w(spark, sf), _COEFFICIENTS).select("ch", "win", "t", "y")


@query(_RESIDUAL.replace(" AS y FROM p", " AS y, x AS z FROM p"))
def lpc_synthesis(spark, sf):
    """The residual y and what is synthesised from it alone."""
    residual = signal.lpc_residual(_w(spark, sf), _COEFFICIENTS).select("ch", "win", "t", "y")
    return kernels.per_group(residual, lambda y: kernels.lpc_synthesis(y, _COEFFICIENTS), value="y", out="z long")


@query(f"WITH {S} SELECT ch, t, d FROM (SELECT ch, t, x - lag(x) OVER (PARTITION BY ch ORDER BY t) AS d FROM s) WHERE d IS NOT NULL")
def first_difference(spark, sf):
    return signal.first_difference(_s(spark, sf)).select("ch", "t", "d").where("d is not null")


_H = "SELECT ch, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits, count(*) AS n_values FROM c GROUP BY ch"


@query(f"WITH {S}, c AS (SELECT ch, x // 100 AS v, count(*) AS n FROM s GROUP BY ALL) {_H}")
def entropy_h0(spark, sf):
    return signal.entropy(_s(spark, sf).withColumn("v", F.expr("x div 100")), "v").withColumn("bits", F.round("bits", 6))


@query(f"WITH {S}, d AS (SELECT ch, (x - lag(x) OVER (PARTITION BY ch ORDER BY t)) // 100 AS v FROM s), c AS (SELECT ch, v, count(*) AS n FROM d WHERE v IS NOT NULL GROUP BY ALL) {_H}")
def entropy_h0_delta(spark, sf):
    return signal.entropy(signal.first_difference(_s(spark, sf)).withColumn("v", F.expr("d div 100")), "v").withColumn("bits", F.round("bits", 6))


_Z = "z AS (SELECT ch, t, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS zz FROM s)"


@query(f"WITH {S}, {_Z} SELECT ch, t, zz, x FROM z JOIN s USING (ch, t)")
def zigzag(spark, sf):
    z = _s(spark, sf).select("ch", "t", scalar.zigzag("x").alias("zz"))
    return z.withColumn("x", scalar.unzigzag("zz"))


_K = "CASE " + " ".join(f"WHEN m < {2 ** (k + 1)} THEN {k}" for k in range(31)) + " ELSE 31 END"


@query(f"""WITH {S}, {_Z}, g AS (SELECT ch, t // 500 AS win, {_K.replace("m <", "coalesce(avg(zz) FILTER (zz <> 0), 0) <")} AS k FROM z GROUP BY ALL)
  SELECT ch, win, k, sum((zz >> k) + 1 + k)::BIGINT AS bits, count(*) AS n FROM z JOIN g ON g.ch = z.ch AND g.win = z.t // 500 GROUP BY ALL""".replace("SELECT ch, win, k, sum", "SELECT g.ch, g.win, k, sum"))
def golomb_bits(spark, sf):
    return signal.golomb(_s(spark, sf), 500)


@query(f"""WITH {S}, {_Z}, g AS (SELECT ch, t // 500 AS win, {_K.replace("m <", "coalesce(avg(zz) FILTER (zz <> 0), 0) <")} AS k FROM z GROUP BY ALL)
  SELECT g.ch, g.win, 3 + ceil(sum((zz >> k) + 1 + k) / 8.0)::BIGINT AS n_bytes, true AS same FROM z JOIN g ON g.ch = z.ch AND g.win = z.t // 500 GROUP BY ALL""")
def golomb_bytes(spark, sf):
    """Real code bytes of every window, and whether decoding them gives the window back."""

    def run(pdf):
        import pandas as pd

        x = pdf.sort_values("t")["x"].to_numpy()
        data = kernels.golomb_encode(x)
        return pd.DataFrame({"ch": pdf["ch"].iloc[:1], "win": pdf["win"].iloc[:1], "n_bytes": len(data), "same": bool((kernels.golomb_decode(data) == x).all())})

    return _w(spark, sf).groupBy("ch", "win").applyInPandas(run, "ch string, win long, n_bytes long, same boolean")


@query(f"""WITH {S}, q AS (SELECT ch, t, CASE WHEN abs(x) < 900 THEN 0 ELSE x END AS x FROM s),
  i AS (SELECT ch, t, t - row_number() OVER (PARTITION BY ch ORDER BY t) AS island FROM q WHERE x = 0)
  SELECT ch, min(t) AS start_t, count(*) AS len FROM i GROUP BY ch, island""")
def zero_run_lengths(spark, sf):
    return signal.zero_runs(_s(spark, sf).withColumn("x", F.when(F.abs("x") < 900, 0).otherwise(F.col("x"))))


@query(f"WITH {S} SELECT ch, t, sign(x)::BIGINT * ((abs(x) * 2 + 50) // 100) AS q FROM s")
def quantize_nearest(spark, sf):
    return _s(spark, sf).select("ch", "t", scalar.quantize("x", 50).alias("q"))


@query(f"""WITH {S}, y AS (SELECT ch, t, x, 50 * sign(x)::BIGINT * ((abs(x) * 2 + 50) // 100) AS y FROM s), m AS (SELECT ch, avg(x) AS mean FROM s GROUP BY ch)
  SELECT ch, round(100 * sqrt(sum((x - y) * (x - y)) / sum((x - mean) * (x - mean))), 6) AS prd, round(corr(x, y), 6) AS r FROM y JOIN m USING (ch) GROUP BY ch""")
def prd_after_quantize(spark, sf):
    a = _s(spark, sf)
    b = a.select("ch", "t", (scalar.quantize("x", 50) * 50).alias("x"))
    return signal.prd(a, b).withColumns({"prd": F.round("prd", 6), "r": F.round("r", 6)})


def _lift_sql(source_name, a, d):
    return f"""{d} AS (SELECT o.ch, o.t // 2 AS i, o.x - CASE WHEN r.x IS NULL THEN l.x ELSE (l.x + r.x) >> 1 END AS y FROM {source_name} o
      JOIN {source_name} l ON l.ch = o.ch AND l.t = o.t - 1 LEFT JOIN {source_name} r ON r.ch = o.ch AND r.t = o.t + 1 WHERE o.t % 2 = 1),
    {a} AS (SELECT e.ch, e.t // 2 AS t, e.x + CASE WHEN p.y IS NULL AND h.y IS NULL THEN 0 WHEN p.y IS NULL THEN (h.y + 1) >> 1 WHEN h.y IS NULL THEN (p.y + 1) >> 1 ELSE (p.y + h.y + 2) >> 2 END AS x
      FROM {source_name} e LEFT JOIN {d} h ON h.ch = e.ch AND h.i = e.t // 2 LEFT JOIN {d} p ON p.ch = e.ch AND p.i = e.t // 2 - 1 WHERE e.t % 2 = 0)"""


@query(f"WITH {S}, {_lift_sql('s', 'a1', 'd1')} SELECT ch, 'a' AS band, t AS i, x AS y FROM a1 UNION ALL SELECT ch, 'd', i, y FROM d1")
def lifting_level1(spark, sf):
    return signal.lift(_s(spark, sf))


_LEVELS = ", ".join(_lift_sql(a, b, c) for a, b, c in (("s", "a1", "d1"), ("a1", "a2", "d2"), ("a2", "a3", "d3")))
_BANDS = "SELECT ch, 'd1' AS band, i, y FROM d1 UNION ALL SELECT ch, 'd2', i, y FROM d2 UNION ALL SELECT ch, 'd3', i, y FROM d3 UNION ALL SELECT ch, 'a3', t, x FROM a3"


@query(f"WITH {S}, {_LEVELS} {_BANDS}")
def lifting_level3(spark, sf):
    return signal.lift_levels(_s(spark, sf))


@query(f"WITH {S}, {_LEVELS}, b AS ({_BANDS}) SELECT ch, band, count(*) AS n, sum(y * y)::BIGINT AS energy FROM b GROUP BY ALL")
def lifting_energy_by_band(spark, sf):
    return signal.lift_levels(_s(spark, sf)).groupBy("ch", "band").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("energy"))


@query(f"""WITH {S}, {_lift_sql('s', 'a1', 'd1')} SELECT s.ch, s.t, s.x, CASE WHEN s.t % 2 = 0 THEN a1.x ELSE d1.y END AS band_value
  FROM s LEFT JOIN a1 ON a1.ch = s.ch AND a1.t = s.t // 2 LEFT JOIN d1 ON d1.ch = s.ch AND d1.i = s.t // 2""")
def lifting_inverse(spark, sf):
    """What the two bands alone give back, beside the values of the bands."""
    bands = signal.lift(_s(spark, sf))
    place = (F.col("i") * 2 + F.when(F.col("band") == "d", 1).otherwise(0)).alias("t")
    return signal.unlift(bands).join(bands.select("ch", place, F.col("y").alias("band_value")), ["ch", "t"])


def _band_bytes_sql():
    """Bytes of the Rice code of every band of every window, whose bands have no prediction: d1, d2, d3 and a3 with a bias taken off."""
    windows = "s AS (SELECT ch || ':' || t // 512 AS ch, t % 512 AS t, x FROM signal)"
    rice = f"""y AS (SELECT ch, band, y - floor(coalesce(sum(y) OVER (PARTITION BY ch, band ORDER BY i ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING), 0) / 32)::BIGINT AS y FROM b),
      z AS (SELECT ch, band, CASE WHEN y >= 0 THEN 2 * y ELSE -2 * y - 1 END AS zz FROM y),
      k AS (SELECT ch, band, {_K.replace("m <", "coalesce(avg(zz) FILTER (zz <> 0), 0) <")} AS k FROM z GROUP BY ALL),
      r AS (SELECT z.ch, z.band, 3 + ceil(sum((zz >> k) + 1 + k) / 8.0)::BIGINT AS n_bytes FROM z JOIN k USING (ch, band) GROUP BY ALL)"""
    return f"{windows}, {_LEVELS}, b AS ({_BANDS}), {rice}"


@query(f"""WITH {S.replace("s AS (", "signal AS (", 1)}, {_band_bytes_sql()}, c AS (SELECT ch, sum(n_bytes)::BIGINT AS band_bytes FROM r GROUP BY ch)
  SELECT s.ch AS win, count(*) AS n, sum(x * (t + 1))::BIGINT AS checksum, CASE WHEN count(*) >= 32 THEN any_value(band_bytes) ELSE -1 END AS band_bytes FROM s JOIN c USING (ch) GROUP BY s.ch""")
def window_codec_roundtrip(spark, sf):
    """The whole stage chain on every window of 512: a checksum of what is decoded, and the code bytes of the chain without prediction.

    SQL has these bytes by its own lifting, bias and Rice sums; for windows under 32 samples, which take fewer levels, both say -1.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        x = pdf.sort_values("t")["x"].to_numpy()
        z = kernels.decode_window(kernels.encode_window(x))
        plain = sum(len(data) for _, data in kernels.encode_window(x, predict=False)) if len(x) >= 32 else -1
        return pd.DataFrame({"win": [f"{pdf['ch'].iloc[0]}:{pdf['win'].iloc[0]}"], "n": [len(z)], "checksum": [int((z * np.arange(1, len(z) + 1)).sum())], "band_bytes": [plain]})

    return _w(spark, sf, 512).groupBy("ch", "win").applyInPandas(run, "win string, n long, checksum long, band_bytes long")


@query(f"""WITH {S}, {_W}, l AS (SELECT ch, win, avg(abs(x)) * 1.5 AS level FROM w WHERE t % 8 = 0 GROUP BY ALL)
  SELECT ch, win, count(*) FILTER (abs(x) < coalesce(level, 0)) AS zeroed, sum(CASE WHEN abs(x) < coalesce(level, 0) THEN 0 ELSE x END)::BIGINT AS total FROM w LEFT JOIN l USING (ch, win) GROUP BY ALL""")
def detail_threshold(spark, sf):
    out = signal.detail_threshold(_w(spark, sf))
    return out.groupBy("ch", "win").agg(F.count_if((F.col("y") == 0) & (F.col("x") != 0) | (F.abs("x") < F.coalesce("level", F.lit(0.0)))).alias("zeroed"), F.sum("y").alias("total"))


@query(f"WITH {S} SELECT * FROM (SELECT ch, t, (x - lag(x, 59) OVER (PARTITION BY ch ORDER BY t)) * 6 AS slope FROM s) WHERE slope IS NOT NULL")
def impedance_slope(spark, sf):
    return signal.trend(_s(spark, sf)).select("ch", "t", "slope").where("slope is not null")


@query(f"""WITH {S}, {_W}, q AS (SELECT ch, win, t, x, sign(x)::BIGINT * ((abs(x) + 7) // 15) AS q FROM w),
  i AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY ch, win ORDER BY t), 0) AS step FROM q)
  SELECT ch, win, count(*) AS n, max(abs(x - 15 * q)) AS worst, sum(abs(step))::BIGINT AS steps, sum(15 * q)::BIGINT AS total FROM i GROUP BY ch, win""")
def bounded_error(spark, sf):
    """Closed-loop coding with an error bound of 7: largest error, size of the indices and sum of what is rebuilt.

    The loop starts at 0 and moves by whole steps of 15, so that what it rebuilds is the nearest multiple of 15.
    """
    coded = kernels.per_group(_w(spark, sf), lambda x: list(map(list, zip(*kernels.bounded_dpcm(x, 7), strict=True))), out="y array<long>")
    index, rebuilt = F.col("y")[0], F.col("y")[1]
    return coded.groupBy("ch", "win").agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - rebuilt)).alias("worst"), F.sum(F.abs(index)).alias("steps"), F.sum(rebuilt).alias("total"))


@query()
def rls_roundtrip(spark, sf):
    """The residual y of the recursive predictor and what is restored from it alone; checked in the tests."""
    residual = kernels.rls_by_blocks(_s(spark, sf))
    return kernels.per_group(residual, lambda y: kernels.rls_residual(y, restore=True), keys=("ch",), value="y", out="z long")


@query()
def change_points(spark, sf):
    burst = _s(spark, sf).withColumn("x", F.when(F.expr("t div 600 % 2 = 1"), F.col("x") * 30).otherwise(F.col("x")))
    return kernels.per_group(burst, kernels.change_points, keys=("ch",)).where("y = 1").select("ch", "t")


@query()
def normalise_zero_phase(spark, sf):
    """Resampled from 500 to 250 Hz and high-passed; compared with a direct filter in the tests."""

    def run(pdf):
        import pandas as pd

        y = kernels.zero_phase(kernels.resample(pdf.sort_values("t")["x"].to_numpy(), 1, 2))
        return pd.DataFrame({"ch": pdf["ch"].iloc[0], "t": range(len(y)), "y": y})

    return _s(spark, sf).groupBy("ch").applyInPandas(run, "ch string, t long, y double")


@query(f"WITH {S}, m AS (SELECT max(abs(x))::DOUBLE AS peak FROM s) SELECT ch, t, trunc(x / peak * 0.72 * 2147483647)::BIGINT AS q FROM s, m")
def q31_normalise(spark, sf):
    df = _s(spark, sf)
    peak = df.agg(F.max(F.abs("x")).cast("double").alias("peak"))
    return df.join(peak).select("ch", "t", (F.col("x") / F.when(F.col("peak") > 0, F.col("peak")) * 0.72 * 2147483647).cast("long").alias("q"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
  SELECT vec_id, i // 32 AS block, k, round(sum(CASE WHEN bit_count(i % 32 & k) % 2 = 0 THEN x::DOUBLE ELSE -x::DOUBLE END), 4) AS y FROM v, (SELECT unnest(range(32)) AS k) GROUP BY vec_id, i // 32, k""")
def wht_level(spark, sf):
    """Every block of 32 components, the last one padded with zeros."""
    blocks = signal.blocks32(_t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")))
    return signal.wht32(blocks, keys=("vec_id", "block")).withColumn("y", F.round("y", 4))


@query(f"""WITH {S} SELECT a.ch, a.t, a.x - ((r.x * 30000) >> 16) AS y FROM s a JOIN s r ON r.t = a.t AND r.ch = 'click' WHERE a.ch <> 'click'
  UNION ALL SELECT a.ch, a.t, a.x FROM s a WHERE a.ch = 'click' OR NOT EXISTS (SELECT 1 FROM s r WHERE r.t = a.t AND r.ch = 'click')""")
def cross_channel_residual(spark, sf):
    df = _s(spark, sf)
    gains = df.select("ch").distinct().where("ch <> 'click'").select("ch", F.lit("click").alias("ref"), F.lit(30000).cast("long").alias("gain"))
    return signal.residual_across(df, gains).select("ch", "t", "y")


@query(f"""WITH {S}, l AS (SELECT max(t) + 1 AS ticks FROM s), e AS (SELECT o_orderkey AS kind, (o_orderkey * 7919 % ticks)::DOUBLE / 250 AS a FROM orders, l),
  b AS (SELECT *, unnest(range(floor(a)::BIGINT, floor(a + 0.4::DOUBLE)::BIGINT + 1)) AS band FROM e), p AS (SELECT t::DOUBLE / 250 AS s, count(*) AS n, sum(x) AS x FROM s GROUP BY t)
  SELECT kind, sum(n)::BIGINT AS n, sum(x)::BIGINT AS total FROM b JOIN p ON floor(s)::BIGINT = band WHERE s >= a AND s < a + 0.4::DOUBLE GROUP BY kind""")
def events_on_clock(spark, sf):
    """Every order is an event, spread over the recording's length; channels are summed by tick before the join."""
    df = _s(spark, sf)
    ticks = df.agg((F.max("t") + 1).alias("ticks"))
    start = (F.col("o_orderkey") * 7919 % F.col("ticks")).cast("double") / 250
    events = _t(spark, sf, "orders").crossJoin(F.broadcast(ticks)).select(F.col("o_orderkey").alias("kind"), start.alias("start_s"), (start + 0.4).alias("end_s"))
    by_tick = df.groupBy("t").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    return signal.on_clock(events, by_tick, 250.0).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("x").alias("total"))


@query("""WITH g AS (SELECT l_orderkey AS rec, l_quantity::BIGINT AS spr, sum(l_quantity::BIGINT)::BIGINT AS weight FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
  SELECT rec, spr FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY weight DESC, spr DESC) AS rn FROM g) WHERE rn = 1""")
def dominant_rate_group(spark, sf):
    label = F.when(F.col("l_returnflag") == "R", "EDF Annotations").otherwise("C3")
    return signal.dominant_rate(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_quantity").cast("long").alias("spr"), label.alias("label")))


_RULES = (("/a", "eeg"), ("shop", "ecg"), ("example", "emg"), ("http", "other"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(url), '{p}') THEN '{v}'" for p, v in _RULES) + " ELSE 'untyped' END AS matched FROM pages")
def first_match_rule(spark, sf):
    return records.first_rule(_t(spark, sf, "pages"), "url", _RULES, "untyped").select("page_id", "matched")


_LABELS = (("BUILD", "ecg"), ("auto", "emg"), ("house", "resp"))


@query("""WITH r AS (SELECT c_nationkey AS rec, c_custkey % 40 AS run, min(CASE WHEN contains(lower(c_mktsegment), 'build') THEN 0 WHEN contains(lower(c_mktsegment), 'auto') THEN 1 WHEN contains(lower(c_mktsegment), 'house') THEN 2 END) AS i FROM customer GROUP BY ALL)
  SELECT rec, run, coalesce(['ecg', 'emg', 'resp'][i + 1], 'eeg') AS matched FROM r""")
def label_modality(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("rec"), (F.col("c_custkey") % 40).alias("run"), "c_mktsegment")
    return records.first_rule_of_group(rows, ["rec", "run"], "c_mktsegment", _LABELS, "eeg")


@query("SELECT p_partkey, p_name FROM part WHERE (regexp_full_match(p_name, '.*ring') OR regexp_full_match(p_name, 're. .*')) AND NOT regexp_full_match(p_name, '.*ll.*')")
def include_exclude_globs(spark, sf):
    return records.globs(_t(spark, sf, "part"), "p_name", ["*ring", "re? *"], ["*ll*"]).select("p_partkey", "p_name")


_FILES = "f AS (SELECT 'rec' || (p_partkey % 50) || CASE WHEN p_partkey % 3 = 0 THEN '_run' || (p_partkey % 5) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '.json' ELSE '_ch.tsv' END AS file FROM part), st AS (SELECT 'rec' || (s_suppkey % 50) AS stem FROM supplier UNION SELECT 'rec' || (s_suppkey % 50) || '_run1' FROM supplier)"


@query(f"""WITH {_FILES}, m AS (SELECT DISTINCT file, stem FROM f JOIN st ON starts_with(file, stem || '.') OR starts_with(file, stem || '_'))
  SELECT file, stem FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY length(stem) DESC) AS rn FROM m) WHERE rn = 1""")
def longest_stem_sidecar(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.lit("rec"), (k % 50).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("_run"), (k % 5).cast("string"))).otherwise(""), F.when(k % 2 == 0, ".json").otherwise("_ch.tsv"))
    base = F.concat(F.lit("rec"), (F.col("s_suppkey") % 50).cast("string"))
    stems = _t(spark, sf, "supplier").select(F.explode(F.array(base, F.concat(base, F.lit("_run1")))).alias("stem")).distinct()
    return records.sidecar_owner(_t(spark, sf, "part").select(name.alias("file")), stems)


_EXT = ("edf", "BDF", "gz", "txt", "png", "tar")
_PATHS = "p AS (SELECT doc_id, 'd/' || doc_id || '.' || ['" + "', '".join(_EXT) + "'][doc_id % 6 + 1] AS path, n_chars FROM documents)"
_METHOD = "CASE WHEN lower(split_part(path, '.', -1)) IN ('edf', 'bdf') THEN 'lml' WHEN lower(split_part(path, '.', -1)) IN ('gz', 'png') THEN 'store' ELSE 'zstd' END"


def _entries(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    size = F.length("text").cast("long") + 1
    return _t(spark, sf, "documents").select("doc_id", F.col("source").alias("archive"), path.alias("path"), size.alias("original_size"), F.expr("(length(text) + 1) div 2 + 1").cast("long").alias("compressed_size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).withColumn("method", scalar.method_of("path"))


_ENTRIES = "e AS (SELECT doc_id, source AS archive, 'd/' || doc_id || '.' || ['" + "', '".join(_EXT) + f"'][doc_id % 6 + 1] AS path, length(text) + 1 AS original_size, (length(text) + 1) // 2 + 1 AS compressed_size, sha256(text) AS sha256, {_METHOD} AS method FROM documents)"


@query(f"WITH {_ENTRIES} SELECT doc_id, method FROM e")
def method_by_extension(spark, sf):
    return _entries(spark, sf).select("doc_id", "method")


@query(f"WITH {_ENTRIES} SELECT method, count(*) AS n_files, sum(original_size)::BIGINT AS original, sum(compressed_size)::BIGINT AS compressed, round(sum(original_size) / sum(compressed_size), 6) AS cr FROM e GROUP BY method")
def archive_summary(spark, sf):
    return records.archive_summary(_entries(spark, sf)).withColumn("cr", F.round("cr", 6))


@query(f"WITH {_ENTRIES} SELECT doc_id, coalesce(sum(compressed_size) OVER (PARTITION BY archive ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM e")
def archive_offsets(spark, sf):
    return records.offsets(_entries(spark, sf)).select("doc_id", "offset")


@query(f"WITH {_ENTRIES} SELECT archive, bool_and(doc_id % 37 <> 5) AS passed, count(*) FILTER (doc_id % 37 = 5) AS failed, sum(original_size)::BIGINT AS original, count(*) AS n_files FROM e GROUP BY archive")
def archive_verify(spark, sf):
    seen = _entries(spark, sf).withColumn("stored", F.when(F.col("doc_id") % 37 == 5, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("sha256")))
    return records.verify_archive(seen.withColumn("ok", F.col("stored") == F.col("sha256")))


@query(f"WITH {_ENTRIES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'unchanged' ELSE 'conflict' END AS outcome FROM e")
def archive_append(spark, sf):
    new = _entries(spark, sf).select("doc_id", "path", "sha256")
    old = new.where("doc_id % 3 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 3 == 2, F.lit("other")).otherwise(F.col("sha256")))
    return records.append(old, new.drop("doc_id"))


@query("""SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 13 = 0 AND doc_id % 19 <> 0 THEN 'SIZE MISMATCH'
  WHEN doc_id % 23 = 0 THEN 'DECODE FAIL' WHEN doc_id % 17 = 0 OR doc_id % 13 = 0 THEN 'SHA256 MISMATCH' ELSE 'OK' END AS status FROM documents""")
def manifest_verify(spark, sf):
    """Seeded failures of each kind; where the expected size is 0 it is not compared."""
    k = F.col("doc_id")
    files = _t(spark, sf, "documents").select(k, F.concat(F.lit("d"), k.cast("string")).alias("path"), (F.length("text") + 1).cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    manifest = files.select("path", F.when(k % 19 == 0, 0).when(k % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when((k % 17 == 0) | (k % 13 == 0), "bad").otherwise(F.col("sha256")).alias("sha256"))
    seen = files.where("doc_id % 11 <> 0").withColumn("sha256", F.when(k % 23 != 0, F.col("sha256")))
    return records.verify_manifest(manifest, seen)


def _log(spark, sf):
    return _t(spark, sf, "conversations").select(F.col("conv_id").alias("log"), F.col("turn").alias("line"), F.col("text").alias("msg"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return records.duplicates(_t(spark, sf, "orders"), "o_custkey")


def _graph(spark, sf):
    """Orders are nodes whose parent is a customer's node; seeded violations of each kind."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    customers = _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit(0).alias("class_tag"), F.col("c_name").alias("payload"), F.array().cast("array<string>").alias("parents"), F.lit(None).cast("double").alias("unc"), F.lit("a").alias("stored"))
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    parent = F.when(k % 101 == 7, F.lit("nobody")).otherwise(name("c", c))
    nodes = _t(spark, sf, "orders").select(name("o", F.when(k % 97 == 5, k - 1).otherwise(k)).alias("id"), F.when(k % 89 == 4, 9).otherwise(k % 7).cast("int").alias("class_tag"), F.col("o_orderstatus").alias("payload"), F.array(parent).alias("parents"), F.when(k % 83 == 3, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("unc"), F.when(k % 79 == 2, "b").otherwise("a").alias("stored"))
    edges = _t(spark, sf, "orders").where("o_orderkey % 2 = 0").select(name("c", c).alias("src"), F.when(k % 103 == 6, F.lit("gone")).otherwise(name("o", k)).alias("dst"), F.lit("provenance-dependency").alias("class"))
    return customers.unionByName(nodes).withColumn("address", F.lit("a")), edges


_GRAPH = """n AS (SELECT 'c' || c_custkey AS id, 0 AS class_tag, NULL AS parent, NULL::DOUBLE AS unc, 'a' AS stored FROM customer
  UNION ALL SELECT 'o' || CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey - 1 ELSE o_orderkey END, CASE WHEN o_orderkey % 89 = 4 THEN 9 ELSE o_orderkey % 7 END,
    CASE WHEN o_orderkey % 101 = 7 THEN 'nobody' ELSE 'c' || o_custkey END, CASE WHEN o_orderkey % 83 = 3 THEN 'nan'::DOUBLE ELSE o_totalprice END, CASE WHEN o_orderkey % 79 = 2 THEN 'b' ELSE 'a' END FROM orders),
  g AS (SELECT 'c' || o_custkey AS src, CASE WHEN o_orderkey % 103 = 6 THEN 'gone' ELSE 'o' || o_orderkey END AS dst FROM orders WHERE o_orderkey % 2 = 0)"""


@query(f"WITH {_GRAPH} SELECT id, parent FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)")
def dangling_parents(spark, sf):
    return records.dangling_parents(_graph(spark, sf)[0])


@query(f"""WITH {_GRAPH} SELECT 'duplicate_id' AS kind, id, (count(*) - 1)::VARCHAR AS detail FROM n GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'id_mismatch', id, '' FROM n WHERE stored = 'b' UNION ALL SELECT 'unknown_class', id, class_tag::VARCHAR FROM n WHERE class_tag > 6
  UNION ALL SELECT 'non_finite_uncertainty', id, '' FROM n WHERE isnan(unc) OR isinf(unc)
  UNION ALL SELECT 'dangling_parent', id, parent FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'dangling_edge', x, count(*)::VARCHAR FROM (SELECT src AS x FROM g UNION ALL SELECT dst FROM g) WHERE x NOT IN (SELECT id FROM n) GROUP BY x""")
def evidence_graph_verify(spark, sf):
    return records.verify_graph(*_graph(spark, sf))


@query(f"WITH {_GRAPH} SELECT DISTINCT parent AS src, id AS dst FROM n WHERE parent IS NOT NULL AND (parent, id) NOT IN (SELECT (src, dst) FROM g)".replace("(parent, id) NOT IN (SELECT (src, dst) FROM g)", "NOT EXISTS (SELECT 1 FROM g WHERE g.src = parent AND g.dst = id)"))
def provenance_edges_missing(spark, sf):
    return records.missing_provenance_edges(*_graph(spark, sf))


@query(f"""WITH {_GRAPH} SELECT id, class_tag, ['measured', 'derived', 'estimated', 'generated', 'hypothesis', 'action', 'outcome'][class_tag + 1] AS class,
  CASE WHEN class_tag > 6 THEN 'unknown' WHEN class_tag IN (0, 1, 6) THEN 'yes' ELSE 'no' END AS credited FROM n""")
def evidence_gate(spark, sf):
    return _graph(spark, sf)[0].select("id", "class_tag", scalar.class_name("class_tag").alias("class"), F.when(scalar.is_evidence("class_tag"), "yes").when(~scalar.is_evidence("class_tag"), "no").otherwise("unknown").alias("credited"))


@query("""SELECT o_orderkey, sha256((o_orderkey % 7)::VARCHAR || '|' || length(o_orderstatus) || ':' || o_orderstatus || '|' || array_to_string(list_transform(list_sort(['c' || o_custkey, 'b']), lambda x: length(x) || ':' || x), '')) AS id FROM orders""")
def node_address(spark, sf):
    parents = F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("b"))
    return _t(spark, sf, "orders").select("o_orderkey", records.node_id(F.col("o_orderkey") % 7, F.col("o_orderstatus"), parents).alias("id"))


@query("""WITH i AS (SELECT DISTINCT sha256(o_orderkey::VARCHAR) AS id FROM orders), b AS (SELECT substr(id, 1, 3) AS b, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM i GROUP BY 1)
  SELECT sha256(string_agg(h, ',' ORDER BY b)) AS address FROM b""")
def graph_address(spark, sf):
    return records.graph_address(_t(spark, sf, "orders").select(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("id")))


@query("SELECT l_suppkey AS stream, arg_max(l_discount, l_orderkey * 10 + l_linenumber) AS \"offset\", round(max(l_discount) - min(l_discount), 6) AS uncertainty, arg_max(l_shipdate, l_orderkey * 10 + l_linenumber) AS valid_from FROM lineitem GROUP BY l_suppkey")
def clock_reconcile(spark, sf):
    seen = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_discount").alias("offset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_shipdate").alias("collected"))
    return records.reconcile_clocks(seen).withColumn("uncertainty", F.round("uncertainty", 6))


@query("""SELECT p_partkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS human
  FROM (SELECT p_partkey, (p_size * p_size * p_size * p_size)::BIGINT * (p_partkey % 50) AS b FROM part)""")
def human_bytes(spark, sf):
    p = F.col("p_size").cast("long")
    return _t(spark, sf, "part").select("p_partkey", scalar.human_bytes(p * p * p * p * (F.col("p_partkey") % 50)).alias("human"))


@query("SELECT p_partkey, p_size * [1, 1024, 1048576][p_partkey % 3 + 1]::BIGINT AS bytes, NULL::BIGINT AS bad FROM part")
def byte_size_parse(spark, sf):
    unit = F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("m")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", scalar.byte_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"), scalar.byte_size(F.lit("x1")).alias("bad"))


@query("SELECT page_id, url, regexp_matches(url, '(^|/)\\.\\.(/|$)') OR starts_with(url, '/') OR contains(url, '\\') OR regexp_matches(url, '^[A-Za-z]:') AS bad FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../' || url WHEN 1 THEN '/' || url WHEN 2 THEN 'c:' || url ELSE 'a/..b/' || page_id END AS url FROM pages)")
def unsafe_paths(spark, sf):
    url = F.col("url")
    shaped = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("../"), url)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/"), url)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("c:"), url)).otherwise(F.concat(F.lit("a/..b/"), F.col("page_id").cast("string")))
    return _t(spark, sf, "pages").select("page_id", shaped.alias("url")).withColumn("bad", scalar.unsafe_path("url"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Fp1' WHEN 1 THEN 'T3' WHEN 2 THEN 'C3' WHEN 3 THEN 'Fz' WHEN 4 THEN 'Fp1' ELSE NULL END AS electrode FROM events""")
def label_normalise(spark, sf):
    names = F.array(*map(F.lit, ("  EEG fp1 ", "EEG T7-REF", "C3..", "Fz.", "FP1-F7", "EMG1")))
    return _t(spark, sf, "events").select("event_id", scalar.electrode(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))).alias("electrode"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS other FROM events")
def json_fields(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("other"))


@query("""SELECT event_id, event_type AS name, 'x' AS site, CASE WHEN event_id % 2 = 0 THEN '1' END AS run FROM events""")
def metadata_edit(spark, sf):
    meta = F.create_map(F.lit("name"), F.lit("old"), F.lit("drop"), F.lit("1"), F.lit("run"), F.lit("0"))
    name = records.edit_metadata(meta, {"site": "y", "run": "1"}, {"site": "x"}, ["drop", "name"])
    return _t(spark, sf, "events").withColumn("m", name).select("event_id", F.coalesce(F.col("m")["name"], F.col("event_type")).alias("name"), F.col("m")["site"].alias("site"), F.when(F.col("event_id") % 2 == 0, F.col("m")["run"]).alias("run"))


_LE = " || ".join(f"substr(h, {k}, 2)" for k in range(15, 0, -2))


@query(f"""WITH {S}, h AS (SELECT ch, t, lpad(to_hex(x), 16, '0') AS h FROM s)
  SELECT sha256(unhex(string_agg({_LE}, '' ORDER BY ch, t))) AS digest FROM h""")
def signal_digest(spark, sf):
    """One digest of a recording's samples as little-endian 64-bit integers, in channel-major order."""
    return signal.digest(_s(spark, sf))


_CHANNELS = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {S} SELECT t, " + ", ".join(f"coalesce(max(x) FILTER (ch = '{c}'), 0) AS {c}" for c in _CHANNELS) + " FROM s GROUP BY t")
def export_wide(spark, sf):
    return _s(spark, sf).groupBy("t").pivot("ch", list(_CHANNELS)).agg(F.first("x")).fillna(0)
