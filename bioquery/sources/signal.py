"""Signals from the driver's tables (stand-ins; no physiological claim)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bioquery.operators import records

#: The same in SQL, as a first common table expression s(ch, t, x).
SAMPLES_SQL = """s AS (SELECT event_type AS ch, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t,
  CAST(round(value * 100) AS BIGINT) - 5000 AS x FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, t, x): the events of a type in time order are a channel of integer samples around zero.

    Only this adapter numbers samples, by ranges of time, so that a channel is
    many tasks'; stored recordings carry t.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    placed = records.places(events, ["event_type"], ["ts", "event_id"], "t")
    return placed.select(F.col("event_type").alias("ch"), "t", (F.round(F.col("value") * 100).cast("long") - 5000).alias("x"))


def changed(signal: DataFrame) -> DataFrame:
    """A second recording: every 997th sample differs by one, and the last few of each channel are missing."""
    return signal.where("t % 1999 <> 1998").withColumn("x", F.when(F.col("t") % 997 == 5, F.col("x") + 1).otherwise(F.col("x")))


CHANGED_SQL = "b AS (SELECT ch, t, CASE WHEN t % 997 = 5 THEN x + 1 ELSE x END AS x FROM s WHERE t % 1999 <> 1998)"
