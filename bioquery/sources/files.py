"""Readers of raw, described, BrainVision, CNT, EEGLAB, ASCII and BIDS files."""

import configparser
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"i16": ("i2", 2), "i32": ("i4", 4), "i24": (None, 3)}


def integers(data: bytes, dtype="i16", channels=1, multiplexed=True, big=False):
    """[channels][samples] of interleaved or channel-major integers; a partial last frame is an error."""
    if dtype not in TYPES or channels < 1:
        raise ValueError(f"can't read {dtype} with {channels} channels")
    kind, width = TYPES[dtype]
    if len(data) % (width * channels):
        raise ValueError("not a whole number of frames")
    if kind:
        x = np.frombuffer(data, dtype=(">" if big else "<") + kind).astype(np.int64)
    else:
        b = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int64)
        b = b[:, ::-1] if big else b
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x -= (x >> 23) << 24
    return x.reshape(-1, channels).T if multiplexed else x.reshape(channels, -1)


def float_bits(data: bytes, channels=1):
    """float32 samples as the integers of their bits; values that aren't finite are an error."""
    x = np.frombuffer(data, dtype="<f4")
    if not np.isfinite(x).all():
        raise ValueError("samples that aren't finite")
    return x.view(np.uint32).astype(np.int64).reshape(-1, channels).T


def brainvision_header(text: str) -> dict:
    """Channels, rate, layout and labels of a .vhdr text; only integer formats."""
    body = text.split("\n", 1)[1] if text.lower().startswith("brain vision") else text
    cfg = configparser.ConfigParser(strict=False, interpolation=None, comment_prefixes=(";",), delimiters=("=",))
    cfg.read_string(body.split("[Comment]")[0])
    common = cfg["Common Infos"]
    kind = cfg.get("Binary Infos", "BinaryFormat", fallback="INT_16")
    if kind not in ("INT_16", "INT_32"):
        raise ValueError(f"{kind} isn't an integer format")
    labels = [v.split(",")[0] for _, v in sorted(cfg.items("Channel Infos"), key=lambda kv: int(kv[0][2:]))] if cfg.has_section("Channel Infos") else []
    return {"channels": int(common["NumberOfChannels"]), "rate": 1e6 / float(common["SamplingInterval"]), "multiplexed": common.get("DataOrientation", "MULTIPLEXED") == "MULTIPLEXED", "dtype": "i16" if kind == "INT_16" else "i32", "labels": labels, "data": common["DataFile"]}


def cnt_samples(data: bytes):
    """(samples, labels, rate) of a CNT file: 900-byte header, 75 bytes a channel, interleaved int16."""
    n, rate = int.from_bytes(data[370:372], "little"), int.from_bytes(data[376:378], "little")
    labels = [data[900 + 75 * i : 910 + 75 * i].split(b"\0")[0].decode("latin-1") for i in range(n)]
    body = data[900 + 75 * n :]
    end = int.from_bytes(data[886:890], "little") - (900 + 75 * n)
    body = body[:end] if 0 < end <= len(body) else body
    return integers(body[: len(body) // (2 * n) * 2 * n], channels=n), labels, rate


SAMPLES = "path string, ch int, t long, x long"


def _batches(name, signals, chunk=1 << 18):
    """Record batches (path, ch, t, x) of [channels][samples], chunk samples each."""
    import pyarrow as pa

    for ch, x in enumerate(signals):
        for at in range(0, len(x), chunk):
            part = np.ascontiguousarray(x[at : at + chunk])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.full(len(part), ch, dtype=np.int32)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["path", "ch", "t", "x"])


def _binary(spark, path, glob):
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def brainvision_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, data, channels, rate, dtype, multiplexed, labels) of .vhdr files; data is the path of the file that has the samples."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                h = brainvision_header(bytes(content).decode("utf-8", "replace"))
                file = h["data"].replace("$b", name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                rows.append((name, name.rsplit("/", 1)[0] + "/" + file, h["channels"], h["rate"], h["dtype"], h["multiplexed"], h["labels"]))
            yield pd.DataFrame(rows, columns=["path", "data", "channels", "rate", "dtype", "multiplexed", "labels"])

    return _binary(spark, path, "*.[vV][hH][dD][rR]").mapInPandas(run, "path string, data string, channels int, rate double, dtype string, multiplexed boolean, labels array<string>")


def read_brainvision(spark: SparkSession, path: str) -> DataFrame:
    """(path, ch, t, x) of recordings by their headers; path is the header's. A header without its data file is an error."""
    heads = brainvision_headers(spark, path)
    data = _binary(spark, path, "*.[eE][eE][gG]").withColumnRenamed("path", "data")
    both = heads.join(data, "data", "left").withColumn("content", F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no data file "), "data")).cast("binary")).otherwise(F.col("content")))

    def run(batches):
        for batch in batches:
            for name, channels, dtype, wide, content in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                yield from _batches(name, integers(content.as_py(), dtype, channels, wide))

    return both.select("path", "channels", "dtype", "multiplexed", "content").mapInArrow(run, SAMPLES)


def read_cnt(spark: SparkSession, path: str) -> DataFrame:
    """(path, ch, t, x) of CNT files."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(name, cnt_samples(content.as_py())[0])

    return _binary(spark, path, "*.[cC][nN][tT]").mapInArrow(run, SAMPLES)


def read_eeglab(spark: SparkSession, path: str) -> DataFrame:
    """(path, ch, t, x) of .fdt files, x being the bits of float32 samples; <name>.json beside a file has its channels."""
    base = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    side = _binary(spark, path, "*.json").select(base("path").alias("base"), F.get_json_object(F.col("content").cast("string"), "$.channels").cast("int").alias("channels"))
    both = _binary(spark, path, "*.fdt").withColumn("base", base("path")).join(side, "base", "left")
    both = both.withColumn("channels", F.when(F.col("channels") > 0, F.col("channels")).otherwise(F.raise_error(F.concat(F.lit("no channels for "), "path")).cast("int")))

    def run(batches):
        for batch in batches:
            for name, channels, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                yield from _batches(name, float_bits(content.as_py(), channels))

    return both.select("path", "channels", "content").mapInArrow(run, SAMPLES)


def write_raw(df: DataFrame, path: str, keys=("rec",)) -> DataFrame:
    """(keys, n_bytes, sha256) of files path/<keys>.i32 with channel-major little-endian int32 samples (keys, ch, t, x).

    A recording is one task's; values that don't fit 32 bits are an error. path
    is a folder that all executors share.
    """
    keys, kinds = list(keys), dict(df.dtypes)

    def run(key, pdf):
        import hashlib
        import os

        import pandas as pd

        x = pdf.sort_values(["ch", "t"])["x"].to_numpy()
        if len(x) and max(-int(x.min()) - 1, int(x.max())) >> 31:
            raise ValueError("samples that don't fit 32 bits")
        data = x.astype("<i4").tobytes()
        name = os.path.join(path, "_".join(map(str, key)) + ".i32")
        with open(f"{name}.{os.getpid()}.tmp", "wb") as f:
            f.write(data)
        os.replace(f.name, name)  # whole or not at all, also when a task is run again
        return pd.DataFrame([(*key, len(data), hashlib.sha256(data).hexdigest())])

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_bytes long, sha256 string")


def read_described(spark: SparkSession, path: str, descriptor: str | dict, glob="*.raw") -> DataFrame:
    """(path, ch, t, x) of raw files by a descriptor: dtype, channels, multiplexed, big."""
    d = json.loads(descriptor) if isinstance(descriptor, str) else descriptor
    unknown = set(d) - {"name", "dtype", "channels", "multiplexed", "big", "rate"}
    if unknown or d.get("dtype") not in TYPES:
        raise ValueError(f"bad descriptor: {unknown or d.get('dtype')}")
    options = {k: d[k] for k in ("dtype", "channels", "multiplexed", "big") if k in d}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for ch, x in enumerate(integers(data.as_py(), **options)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.full(len(x), ch, dtype=np.int32)), pa.array(np.arange(len(x))), pa.array(np.ascontiguousarray(x))], names=["path", "ch", "t", "x"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, ch int, t long, x long")


def ascii_template(lines: DataFrame) -> DataFrame:
    """One row: whether all lines are 16-bit integers, their width if fixed, and whether they end in CR."""
    bare = F.regexp_replace("value", "\r$", "")
    number = F.trim(bare)
    return lines.agg(
        F.bool_and(number.rlike("^[+-]?[0-9]{1,5}$") & F.coalesce(F.try_to_number(F.regexp_replace(number, "^[+]", ""), F.lit("S99999")).between(-32768, 32767), F.lit(False))).alias("integers"),
        F.when(F.min(F.length(bare)) == F.max(F.length(bare)), F.max(F.length(bare))).alias("width"), F.bool_and(F.col("value").endswith("\r")).alias("crlf"), F.count("*").alias("n"),
    )


def guess_rate(stem):
    """Sampling rate by the name of an ASCII recording."""
    return F.when(stem.rlike("^[A-Z][0-9]{3}$"), 173.61).otherwise(256.0)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated tables with n/a for null, with their path and its entities (sub-01 ... as a map)."""
    df = spark.read.option("sep", "\t").option("header", "true").option("nullValue", "n/a").schema(schema).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    pairs = F.filter(F.split(F.regexp_replace(name, r"\..*$", ""), "_"), lambda x: x.contains("-"))
    return df.withColumn("path", F.input_file_name()).withColumn("entities", F.map_from_arrays(F.transform(pairs, lambda x: F.split_part(x, F.lit("-"), F.lit(1))), F.transform(pairs, lambda x: F.split_part(x, F.lit("-"), F.lit(2)))))


def write_wide(df: DataFrame, channels, path: str, form="csv") -> None:
    """One row a sample time and one column a channel: tab-separated text or Parquet."""
    wide = df.groupBy("t").pivot("ch", list(channels)).agg(F.first("x"))
    if form == "csv":
        wide.orderBy("t").drop("t").write.option("sep", "\t").option("header", "true").csv(path)
    else:
        wide.orderBy("t").write.parquet(path)
