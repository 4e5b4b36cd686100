from bioquery.operators import signal
from bioquery.sources import signal as source
from bioquery.streaming import live

SF = "/root/testdata/sf0.001"


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_new_files_are_encoded_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: live.encode_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b[::-1]).awaitTermination()
    (tmp_path / "in" / "a.edf").write_bytes(b"abc")
    run()
    (tmp_path / "in" / "b.edf").write_bytes(b"xy")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    run()
    assert sorted(bytes(r.encoded) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [b"cba", b"yx"]


def test_rolling_trend_equals_batch(spark, tmp_path):
    df = source.samples(spark, SF)
    for k in range(3):
        df.where(f"t div 70 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    drain(live.rolling_trend(stream).writeStream.format("memory").queryName("trend").outputMode("append").start())
    got = {(r.ch, r.t): r.slope for r in spark.table("trend").collect()}
    want = {(r.ch, r.t): r.slope for r in signal.trend(df.where("t < 210")).collect()}
    assert got == want


def test_window_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    drain(live.window_counts(stream, width="1 day").writeStream.format("memory").queryName("counts").outputMode("complete").start())
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == events.count()
