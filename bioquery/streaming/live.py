"""Streaming forms: a watched folder, and rolling state of channels."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, glob="*.edf", per_batch=256) -> DataFrame:
    """New files of a folder as a stream of (path, content); per_batch bounds a batch, so nothing is dropped."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch)
    return files.load(folder).select("path", "length", "content")


def encode_new(spark: SparkSession, folder: str, out: str, checkpoint: str, encode: Callable[[bytes], bytes]):
    """Encodes each new file once to out; folder and out must differ."""
    if folder.rstrip("/") == out.rstrip("/"):
        raise ValueError("input and output are the same folder")

    def run(batches):
        for pdf in batches:
            pdf["encoded"] = [encode(bytes(c)) for c in pdf["content"]]
            pdf["n_bytes"] = pdf["encoded"].map(len)
            yield pdf[["path", "n_bytes", "encoded"]]

    done = watch(spark, folder).mapInPandas(run, "path string, n_bytes long, encoded binary")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(stream: DataFrame, time="ts", width="10 minutes", late="1 hour", keys=("event_type",)) -> DataFrame:
    """Counts and sums by event-time window; later rows than late are dropped by the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def rolling_trend(stream: DataFrame, span=59, per=6) -> DataFrame:
    """(ch, t, x, slope) of rows that arrive in order within a channel; state is the last span values of each."""

    def update(key, frames, state):
        import pandas as pd

        ring = list(state.get[0]) if state.exists else []
        for pdf in frames:
            pdf = pdf.sort_values("t")
            slopes = []
            for x in pdf["x"]:
                slopes.append((x - ring[0]) * per if len(ring) == span else None)
                ring = [*ring, int(x)][-span:]
            yield pd.DataFrame({"ch": pdf["ch"], "t": pdf["t"], "x": pdf["x"], "slope": pd.array(slopes, dtype="Int64")})
        state.update((ring,))

    return stream.groupBy("ch").applyInPandasWithState(update, "ch string, t long, x long, slope long", "ring array<long>", "append", "NoTimeout")
