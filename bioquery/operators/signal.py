"""Relational operators on samples (ch, t, x); keys may have more columns such as a recording id."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bioquery.functions import scalar


def stats(df: DataFrame, keys=("ch",)) -> DataFrame:
    """Minimum, maximum, mean, population deviation and count of each channel; sums before the shuffle."""
    return df.groupBy(*keys).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("std_x"), F.count("*").alias("n"))


def upper_median(df: DataFrame, value, keys) -> DataFrame:
    """The element at n div 2 of the sorted values, by counts of distinct values: no list of a channel is held."""
    counts = df.groupBy(*keys, F.expr(value).alias("v")).agg(F.count("*").alias("n"))
    order = W.partitionBy(*keys).orderBy("v")
    ranked = counts.withColumn("below", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    return ranked.where(F.col("below") > F.expr("total div 2")).groupBy(*keys).agg(F.min("v").alias("median"))


def noise_floor(df: DataFrame, keys=("ch",), thin_above=None) -> DataFrame:
    """Median absolute deviation with upper medians, over all samples.

    With thin_above, channels of more samples are thinned evenly to about so many.
    """
    keys = list(keys)
    if thin_above:
        step = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(float(thin_above)))).cast("long").alias("step"))
        df = df.join(step, keys).where("t % step = 0")
    middle = upper_median(df, "x", keys).withColumnRenamed("median", "median_x")
    spread = upper_median(df.join(middle, keys), "abs(x - median_x)", keys).withColumnRenamed("median", "mad")
    return middle.join(spread, keys)


def select_channels(df: DataFrame, channels) -> DataFrame:
    """The listed channels in the order of the list, repeats included; a name that doesn't exist is an error."""
    spark = df.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(channels)), "pos int, ch string"))
    have = df.select("ch").distinct().withColumn("known", F.lit(True))
    checked = wanted.join(have, "ch", "left").withColumn("pos", F.when(F.col("known"), F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("no channel "), F.col("ch"))).cast("int"))).drop("known")
    return df.join(F.broadcast(checked), "ch").select("pos", "ch", "t", "x")


def time_range(df: DataFrame, start: int, end: int, keys=("ch",)) -> DataFrame:
    """Samples of [start, end); an empty range or one past the end of a channel is an error."""
    if end <= start:
        raise ValueError("end must be after start")
    length = df.groupBy(*keys).agg((F.max("t") + 1).alias("len"))
    checked = length.withColumn("len", F.when(F.col("len") >= end, F.col("len")).otherwise(F.raise_error(F.lit("range ends after the signal")).cast("long")))
    return df.where((F.col("t") >= start) & (F.col("t") < end)).join(checked, list(keys)).where("len is not null").drop("len")


def windows(df: DataFrame, size: int, keys=("ch",)) -> DataFrame:
    """Statistics of fixed windows; the last one may be short."""
    return df.groupBy(*keys, F.expr(f"t div {size}").alias("win")).agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))


def read_window(df: DataFrame, win: int, size: int) -> DataFrame:
    return df.where((F.col("t") >= win * size) & (F.col("t") < (win + 1) * size))


def gather(df: DataFrame, target) -> DataFrame:
    """Rows of target channels; channels that are missing get zeros at every sample time."""
    wanted = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(target)), "pos int, ch string"))
    length = df.groupBy().agg((F.max("t") + 1).alias("len"))
    # one row per sample time, from a range that Spark deals out
    grid = length.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("t")).join(wanted)
    return grid.join(df, ["ch", "t"], "left").select("pos", "ch", "t", F.coalesce("x", F.lit(0).cast("long")).alias("x"))


def split(df: DataFrame, n: int, keys=("ch",)) -> DataFrame:
    """Chunk of every sample: n of equal size, the last takes the rest."""
    length = df.groupBy(*keys).agg((F.max("t") + 1).alias("len"))
    return df.join(length, list(keys)).withColumn("chunk", F.least(F.expr(f"t div greatest(len div {n}, 1)"), F.lit(n - 1).cast("long"))).drop("len")


def coverage(chunks: DataFrame, n: int) -> DataFrame:
    """Whether chunk numbers 0 .. n-1 are all there, once each."""
    agg = chunks.agg(F.count("*").alias("n_rows"), F.countDistinct("chunk").alias("n_chunks"), F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    return agg.withColumn("complete", (F.col("n_chunks") == n) & (F.col("n_rows") == n) & (F.col("first") == 0) & (F.col("last") == n - 1))


def concat(parts, keys=("ch",)) -> DataFrame:
    """Recordings one after the other along t; all must have the same channels."""
    out, length = None, F.lit(0).cast("long")
    tagged = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    sizes = tagged.groupBy(*keys, "part").agg((F.max("t") + 1).alias("len"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("len").over(W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), length))
    out = tagged.join(before.drop("len"), [*keys, "part"])
    return out.select(*keys, (F.col("t") + F.col("offset")).alias("t"), "x")


def diff(a: DataFrame, b: DataFrame, size=2500) -> DataFrame:
    """Samples that differ or that one side lacks, with their window."""
    both = a.withColumnRenamed("x", "xa").join(b.withColumnRenamed("x", "xb"), ["ch", "t"], "full_outer")
    return both.where(~F.col("xa").eqNullSafe(F.col("xb"))).withColumn("win", F.expr(f"t div {size}"))


def diff_summary(a: DataFrame, b: DataFrame, size=2500) -> DataFrame:
    """Count of differences, the first by (window, channel, sample), and matching and differing windows."""
    differing = diff(a, b, size)
    of = differing.agg(F.count("*").alias("n_diff"), F.countDistinct("win").alias("windows_differ"), F.min(F.struct("win", "ch", "t")).alias("first"))
    total = a.select("t").unionByName(b.select("t")).agg((F.expr(f"max(t) div {size}") + 1).alias("windows"))
    return of.join(total).select("n_diff", "windows_differ", (F.col("windows") - F.col("windows_differ")).alias("windows_match"), F.col("first.win").alias("first_win"), F.col("first.ch").alias("first_ch"), F.col("first.t").alias("first_t"))


def _along(keys):
    return W.partitionBy(*keys).orderBy("t")


def bias_cancel(df: DataFrame, width=32, keys=("ch", "win")) -> DataFrame:
    """x less the floor of the mean of width values before it; those before the window count as 0."""
    total = F.coalesce(F.sum("x").over(_along(keys).rowsBetween(-width, -1)), F.lit(0).cast("long"))
    return df.withColumn("y", F.col("x") - scalar.floor_div(total, width))


def lpc_residual(df: DataFrame, coefficients, shift=27, keys=("ch", "win")) -> DataFrame:
    """x less the prediction from the values before it, by fixed-point coefficients; the first ones stay."""
    order = len(coefficients)
    total = F.lit(0).cast("long")
    for k, c in enumerate(coefficients, 1):
        total = total + F.coalesce(F.lag("x", k).over(_along(keys)), F.lit(0).cast("long")) * F.lit(int(c)).cast("long")
    start = F.row_number().over(_along(keys)) <= order
    return df.withColumn("y", F.when(start, F.col("x")).otherwise(F.col("x") - F.shiftright(total, shift)))


BLOCK = 1 << 16  # samples of a channel that one task has at a time


def blocked(df: DataFrame, before=0, after=0, order="t", size=BLOCK) -> DataFrame:
    """Rows with the __block of their place; those near a border go to the neighbour too, there with __own false.

    A window over (keys, __block) then sees before rows before and after rows
    after each of its own, so a channel of any length is dealt to many tasks.
    """
    at, place = F.expr(f"{order} div {size}"), F.expr(f"{order} % {size}")
    none = F.array().cast("array<bigint>")
    blocks = F.array(at)
    if before:
        blocks = F.concat(blocks, F.when(place >= size - before, F.array(at + 1)).otherwise(none))
    if after:
        blocks = F.concat(blocks, F.when((place < after) & (at > 0), F.array(at - 1)).otherwise(none))
    return df.withColumn("__block", F.explode(blocks)).withColumn("__own", F.col("__block") == at)


def _own(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__own", "__block")


def first_difference(df: DataFrame, keys=("ch",), size=BLOCK) -> DataFrame:
    """Difference d from the sample before; the first of a channel has none."""
    return _own(blocked(df, before=1, size=size).withColumn("d", F.col("x") - F.lag("x").over(_along([*keys, "__block"]))))


def entropy(df: DataFrame, value="x", keys=("ch",)) -> DataFrame:
    """Zeroth-order entropy in bits of a sample."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("bits"), F.count("*").alias("n_values"))


def golomb(df: DataFrame, size=500, keys=("ch",)) -> DataFrame:
    """Rice parameter and coded bits of every window: parameter from the mean of the codes that aren't 0."""
    coded = df.select(*keys, F.expr(f"t div {size}").alias("win"), scalar.zigzag("x").alias("zz"))
    of = coded.groupBy(*keys, "win").agg(scalar.golomb_k(F.coalesce(F.avg(F.when(F.col("zz") != 0, F.col("zz"))), F.lit(0.0))).cast("int").alias("k"))
    joined = coded.join(of, [*keys, "win"])
    return joined.groupBy(*keys, "win", "k").agg(F.sum(F.expr("shiftright(zz, k) + 1 + k")).alias("bits"), F.count("*").alias("n"))


def zero_runs(df: DataFrame, value="x", keys=("ch",), size=BLOCK) -> DataFrame:
    """(keys, start_t, len) of the runs of zeros at consecutive times.

    Runs are found in blocks; only those that touch a border of their block are
    put in order along a channel and joined.
    """
    keys = list(keys)
    zeros = blocked(df.where(F.col(value) == 0), size=size)
    zeros = zeros.withColumn("island", F.col("t") - F.row_number().over(_along([*keys, "__block"])))
    runs = zeros.groupBy(*keys, "__block", "island").agg(F.min("t").alias("start_t"), F.count("*").alias("len"))
    touches = (F.col("start_t") % size == 0) | ((F.col("start_t") + F.col("len")) % size == 0)
    order = W.partitionBy(*keys).orderBy("start_t")
    border = runs.where(touches).withColumn("new", (F.col("start_t") != F.lag(F.col("start_t") + F.col("len"), 1, -1).over(order)).cast("int"))
    border = border.withColumn("run", F.sum("new").over(order)).groupBy(*keys, "run").agg(F.min("start_t").alias("start_t"), F.sum("len").alias("len"))
    return runs.where(~touches).select(*keys, "start_t", "len").unionByName(border.select(*keys, "start_t", "len"))


def _predicted(left, right):
    """What lifting takes from an odd sample: the mean of its neighbours, or the left one at the end."""
    return F.when(right.isNull(), left).otherwise(F.shiftright(left + right, 1))


def _update(before, here):
    """What lifting adds to an even sample, from the details before and after it."""
    return (
        F.when(here.isNull() & before.isNull(), F.lit(0))
        .when(before.isNull(), F.shiftright(here + 1, 1))
        .when(here.isNull(), F.shiftright(before + 1, 1))
        .otherwise(F.shiftright(before + here + 2, 2))
    )


def lift(df: DataFrame, keys=("ch",), size=BLOCK) -> DataFrame:
    """One level of the integer 5/3 lifting transform: (keys, band, i, y); band a has the even places, d the odd ones.

    One window over blocks with two samples of their neighbours gives both bands.
    """
    order = _along([*keys, "__block"])
    x = {k: F.lag("x", -k).over(order) for k in (-2, -1, 1, 2)}
    near = _own(blocked(df, before=2, after=2, size=size).select("*", *[c.alias(f"x{k + 2}") for k, c in x.items()]))
    here = F.col("x")
    after, before = F.col("x3") - _predicted(here, F.col("x4")), F.col("x1") - _predicted(F.col("x0"), here)
    even = F.col("t") % 2 == 0
    y = F.when(even, here + _update(before, after)).otherwise(here - _predicted(F.col("x1"), F.col("x3")))
    return near.select(*keys, F.when(even, "a").otherwise("d").alias("band"), F.expr("t div 2").alias("i"), y.alias("y"))


def lift_levels(df: DataFrame, levels=3, keys=("ch",), size=BLOCK) -> DataFrame:
    """Bands d1 .. dL and aL of repeated lifting of the even band, in one pass over blocks of a channel.

    A block takes enough samples of its neighbours along that all levels are exact in its own places.
    """
    keys, halo = list(keys), 4 << levels
    if size % halo:
        raise ValueError(f"the block size must be a multiple of {halo}")
    kinds = dict(df.dtypes)

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        from bioquery.operators import kernels

        pdf = pdf.sort_values("t")
        own, start = int(key[-1]) * size, int(pdf["t"].iloc[0])
        a, out = pdf["x"].to_numpy(), []
        for level in range(1, levels + 1):
            a, d = kernels.lift(a)
            out.append((f"d{level}", d, level))
        out.append((f"a{levels}", a, levels))
        parts = []
        for band, y, level in out:
            i = np.arange(len(y)) + (start >> level)
            mine = (i >= own >> level) & (i < own + size >> level)
            parts.append(pd.DataFrame({"band": band, "i": i[mine], "y": y[mine]}))
        rows = pd.concat(parts)
        for name, value in zip(keys, key, strict=False):
            rows.insert(0, name, value)
        return rows[[*keys, "band", "i", "y"]]

    near = blocked(df.select(*keys, "t", "x"), before=halo, after=halo, size=size).drop("__own")
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", band string, i long, y long"
    return near.groupBy(*keys, "__block").applyInPandas(run, schema)


def unlift(bands: DataFrame, keys=("ch",), size=BLOCK) -> DataFrame:
    """Samples (keys, t, x) of one level of bands a and d."""
    keys = list(keys)
    band = lambda b: F.max(F.when(F.col("band") == b, F.col("y"))).alias(b)
    both = blocked(bands.groupBy(*keys, "i").agg(band("a"), band("d")), before=1, after=1, order="i", size=size)
    order = W.partitionBy(*keys, "__block").orderBy("i")
    at = {k: (F.lag("a", -k).over(order), F.lag("d", -k).over(order)) for k in (-1, 1)}
    both = _own(both.select("*", at[-1][1].alias("before"), at[1][0].alias("next_a"), at[1][1].alias("next_d")))
    even = F.col("a") - _update(F.col("before"), F.col("d"))
    following = F.col("next_a") - _update(F.col("d"), F.col("next_d"))
    odd = F.when(F.col("d").isNotNull(), F.struct((F.col("i") * 2 + 1).alias("t"), (F.col("d") + _predicted(even, following)).alias("x")))
    rows = F.array_compact(F.array(F.struct((F.col("i") * 2).alias("t"), even.alias("x")), odd))
    return both.select(*keys, F.inline(rows))


def prd(a: DataFrame, b: DataFrame, keys=("ch",)) -> DataFrame:
    """Root-mean-square difference in per cent of the deviation of a from its mean, and correlation."""
    both = a.join(b.withColumnRenamed("x", "y"), [*keys, "t"])
    n, sx = F.count("*"), F.sum(F.col("x").cast("double"))
    energy = F.sum(F.col("x").cast("double") ** 2) - sx * sx / n
    return both.groupBy(*keys).agg(F.when(energy > 0, 100 * F.sqrt(F.sum((F.col("x") - F.col("y")).cast("double") ** 2) / energy)).otherwise(0.0).alias("prd"), F.corr("x", "y").alias("r"))


def detail_threshold(df: DataFrame, factor=1.5, keys=("ch", "win")) -> DataFrame:
    """Zeroes values below factor times the mean absolute value of every 8th one."""
    level = df.where("t % 8 = 0").groupBy(*keys).agg((F.avg(F.abs("x")) * factor).alias("level"))
    return df.join(level, list(keys), "left").withColumn("y", F.when(F.abs("x") < F.coalesce("level", F.lit(0.0)), 0).otherwise(F.col("x")))


def trend(df: DataFrame, span=59, per=6, keys=("ch",), size=BLOCK) -> DataFrame:
    """Slope over span steps, scaled; null before the ring is full."""
    return _own(blocked(df, before=span, size=size).withColumn("slope", (F.col("x") - F.lag("x", span).over(_along([*keys, "__block"]))) * per))


PACK = 1 << 10  # samples in a packed row, so that an Arrow batch of such rows stays small


def packed(df: DataFrame, keys=("ch",), values=("x",), width=8, size=BLOCK) -> DataFrame:
    """Rows (keys, t, values) of runs of samples in the order of t: t is that of a run's first sample, values are little-endian integers of width bytes.

    Blocks of a channel are sorted and packed by many tasks; what must then go
    through a channel in order has a thousandth of the rows.
    """
    keys, values = list(keys), list(values)
    kinds = dict(df.dtypes)
    rows = df.select(*keys, "t", F.expr(f"t div {size}").alias("__block"), *[F.col(v).cast("long").alias(f"__{v}") for v in values])
    dealt = rows.repartition(*keys, "__block").sortWithinPartitions(*keys, "t")
    n_keys, names = len(keys), [*keys, "t", *values]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in (*range(n_keys), n_keys + 1):
                code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            cuts = [k for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True) for k in range(i, j, PACK)]
            arrays = [batch.column(c).take(pa.array(cuts)) for c in range(n_keys + 1)]
            for c in range(n_keys + 2, batch.num_columns):
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(f"<i{width}")
                arrays.append(pa.array([x[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return dealt.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "t"]), *(f"{v} binary" for v in values)]))


def digest(df: DataFrame, keys=(), width=8) -> DataFrame:
    """(keys, digest): SHA-256 over the samples of a recording as little-endian integers of width bytes, channel by channel.

    Such a digest runs through a recording in order, so a recording is one
    task's: it gets packed runs that many tasks have sorted, width bytes a
    sample, and streams them.
    """
    keys, kinds = list(keys), dict(df.dtypes)
    runs = packed(df, [*keys, "ch"], ("x",), width)
    dealt = (runs.repartition(*keys) if keys else runs.repartition(1)).sortWithinPartitions(*keys, "ch", "t")

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, sha, done = None, None, []
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            for name, data in zip(names, batch.column(len(keys) + 2), strict=True):
                if sha is None or name != now:
                    if sha is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = name, hashlib.sha256()
                sha.update(data.as_buffer())
        if sha is not None:
            done.append((*now, sha.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "digest"], row, strict=True)) for row in done])

    return dealt.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "digest string"]))


def on_clock(events: DataFrame, df: DataFrame, rate: float) -> DataFrame:
    """Samples in [start_s, end_s) of events, by whole-second bands so that the range join has an equality."""
    banded = events.withColumn("band", F.explode(F.sequence(F.floor("start_s"), F.floor("end_s"))))
    timed = df.withColumn("s", F.col("t") / F.lit(float(rate))).withColumn("band", F.floor("s"))
    return timed.join(banded, "band").where("s >= start_s and s < end_s").drop("band")


def residual_across(df: DataFrame, gains: DataFrame) -> DataFrame:
    """x less the rounded-down sum of gains (16 fractional bits) times reference channels at the same time."""
    # a few gains a channel go to the samples, which stay dealt as they are
    reference = df.select(F.col("ch").alias("ref"), "t", F.col("x").alias("xr")).join(F.broadcast(gains), "ref").groupBy("ch", "t").agg(F.sum(F.col("gain") * F.col("xr")).alias("total"))
    return df.join(reference, ["ch", "t"], "left").withColumn("y", F.col("x") - F.shiftright(F.coalesce("total", F.lit(0).cast("long")), 16))


def blocks32(df: DataFrame, vector="v") -> DataFrame:
    """A row with a block number for every 32 numbers of an array of doubles; the last block is padded with zeros."""
    v = F.col(vector)
    starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(32)))
    cut = F.transform(starts, lambda at: F.slice(F.concat(v, F.array_repeat(F.lit(0.0), 31)), at, F.lit(32)))
    return df.select(*[c for c in df.columns if c != vector], F.posexplode(cut).alias("block", vector))


def wht32(df: DataFrame, vector="v", keys=("id",)) -> DataFrame:
    """Walsh-Hadamard transform of arrays of 32 numbers, as sums with signs from the parity of common bits."""
    sign = lambda k: lambda x, i: F.when(F.bit_count(i.bitwiseAND(F.lit(k))) % 2 == 0, x).otherwise(-x)
    out = F.array(*[F.aggregate(F.transform(vector, sign(k)), F.lit(0.0), lambda s, x: s + x) for k in range(32)])
    return df.select(*keys, F.posexplode(out).alias("k", "y"))


def dominant_rate(channels: DataFrame) -> DataFrame:
    """(rec, spr): the samples per record that most samples have; of ties the larger; annotation channels don't count."""
    groups = channels.where("not lower(label) like '%annotation%'").groupBy("rec", "spr").agg(F.sum("spr").alias("weight"))
    return groups.groupBy("rec").agg(F.max(F.struct("weight", "spr")).alias("top")).select("rec", F.col("top.spr").alias("spr"))


def divert(channels: DataFrame) -> DataFrame:
    """(rec, ch, path) of channels (rec, ch, label, spr): 'signal' at the recording's dominant rate, else 'secondary'; 'annotation' for those."""
    note = F.lower("label").contains("annotation")
    rates = dominant_rate(channels).withColumnRenamed("spr", "main")
    path = F.when(note, "annotation").when(F.col("spr") == F.col("main"), "signal").otherwise("secondary")
    return channels.join(rates, "rec", "left").select("rec", "ch", path.alias("path"))


def cross_sums(df: DataFrame) -> DataFrame:
    """(ch, ref, n, xr, rr, xx): sums of products of each channel with the earlier ones at the same time."""
    refs = df.select(F.col("ch").alias("ref"), "t", F.col("x").alias("r"))
    both = df.join(refs, "t").where("ref < ch")
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    return both.groupBy("ch", "ref").agg(F.count("*").alias("n"), total("x", "r").alias("xr"), total("r", "r").alias("rr"), total("x", "x").alias("xx"))


def reference_choice(df: DataFrame, most=3) -> DataFrame:
    """(ch, ref, gain, place): the earlier channels that take most energy off each, by least squares; gains have 16 fractional bits."""
    sums = cross_sums(df).where("rr > 0")
    gain = scalar.floor_div(F.floor(F.col("xr").cast("double") / F.col("rr") * 131072).cast("long") + 1, 2)
    taken = F.col("xr").cast("double") * F.col("xr") / F.col("rr")
    order = W.partitionBy("ch").orderBy(F.desc("taken"), "ref")
    ranked = sums.select("ch", "ref", gain.alias("gain"), taken.alias("taken")).withColumn("place", F.row_number().over(order))
    return ranked.where((F.col("place") <= most) & (F.col("gain") != 0)).select("ch", "ref", "gain", "place")


def keep_smaller(df: DataFrame, gains: DataFrame) -> DataFrame:
    """(ch, t, y, used): the residual across channels for channels whose sum of magnitudes it lowers, else the samples."""
    both = residual_across(df, gains)
    better = both.groupBy("ch").agg((F.sum(F.abs("y")) < F.sum(F.abs("x"))).alias("used"))
    return both.join(F.broadcast(better), "ch").select("ch", "t", F.when(F.col("used"), F.col("y")).otherwise(F.col("x")).alias("y"), "used")  # one row a channel


def channel_table(df: DataFrame, unit="uV", rate=250.0, keys=("ch",)) -> DataFrame:
    """Rows of a BIDS channels table: name, type, units, sampling_frequency, and how many samples 16 bits would clamp."""
    y = scalar.clamp16("x")
    of = df.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.count_if(y != F.col("x")).alias("clamped"), F.min(y).alias("low"), F.max(y).alias("high"))
    return of.select(*[F.col(k).alias("name" if k == "ch" else k) for k in keys], F.lit("EEG").alias("type"), F.lit(unit).alias("units"), F.lit(float(rate)).alias("sampling_frequency"), "n_samples", "clamped", "low", "high")
