import hashlib
import hmac

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bioquery.functions import scalar
from bioquery.operators import archives


def test_pack_and_extract(spark):
    rows = [("a/x.txt", b"word " * 500), ("a/y.gz", b"word " * 500), ("b/tiny.txt", b"q"), ("b/empty", b""), ("gone.txt", None)]
    entries = archives.pack(spark.createDataFrame(rows, "path string, content binary"))
    method = {r.path: r.method for r in entries.collect()}
    assert method == {"a/x.txt": "zstd", "a/y.gz": "store", "b/tiny.txt": "store", "b/empty": "store", "gone.txt": "error"}
    out = {r.path: (r.content, r.ok) for r in archives.extract(entries).collect()}
    assert out == {**{p: (c, True) for p, c in rows if c is not None}, "gone.txt": (None, False)}
    changed = entries.withColumn("stored", F.when(F.col("method") == "zstd", F.substring("stored", 1, 9)).when(F.col("path") == "a/y.gz", F.lit(b"x")).otherwise(F.col("stored")))
    assert {r.path: r.ok for r in archives.extract(changed).collect()} == {"a/x.txt": False, "a/y.gz": False, "b/tiny.txt": True, "b/empty": True, "gone.txt": False}
    assert archives.pack(spark.createDataFrame([], "path string, content binary")).count() == 0
    for path in ("../x", "/x", "c:x", None):
        with pytest.raises(PySparkException, match="unsafe path"):
            archives.pack(spark.createDataFrame([(path, b"")], "path string, content binary")).collect()


def test_volumes_are_refused(spark):
    files = lambda n: spark.createDataFrame([("f", n)], "path string, n_bytes long")
    assert [tuple(r) for r in archives.volumes(files(250), 100).collect()] == [("f", 1, 0, 100), ("f", 2, 100, 200), ("f", 3, 200, 250)]
    assert archives.volumes(files(99_900), 100).count() == 999
    with pytest.raises(PySparkException, match="999"):
        archives.volumes(files(99_901), 100).collect()
    with pytest.raises(PySparkException, match="empty"):
        archives.volumes(files(0), 100).collect()


def test_packets():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 31, 32, 500, 2500):
        for x in (r.integers(-3000, 3000, n), np.zeros(n, dtype=np.int64), (np.sin(np.arange(n) / 9) * 900).astype(int)):
            data = archives.encode_packet(x)
            assert (archives.decode_packet(data) == x).all()
    for at in (0, 5, 9, 30, len(data) - 1):
        with pytest.raises(ValueError):
            archives.decode_packet(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        archives.decode_packet(data[:-1])


def test_keyed_digests(spark):
    for key in (b"short", b"k" * 64, b"long" * 40):
        got = spark.createDataFrame([(b"message",), (b"",)], "m binary").select(archives.hmac_sha256(key, F.col("m"))).collect()
        assert [r[0] for r in got] == [hmac.new(key, m, hashlib.sha256).hexdigest() for m in (b"message", b"")]


def test_exact_numbers(spark):
    from fractions import Fraction

    df = spark.createDataFrame([("12.50",), ("-0.125",), ("7",), ("1e5",), (".5",), ("3.",), (None,)], "s string").select("s", scalar.decimal_ratio("s").alias("r"))
    got = {r.s: None if r.r is None else (int(r.r.num), int(r.r.den)) for r in df.collect()}
    assert got == {"12.50": (25, 2), "-0.125": (-1, 8), "7": (7, 1), "1e5": None, ".5": None, "3.": (3, 1), None: None}
    values = [0.1, -2.75, 3.0, 0.0, 1e-9, float("nan")]
    rows = spark.createDataFrame([(float(np.float32(v)),) for v in values], "x double").select("x", scalar.float_ratio("x").alias("r")).collect()
    for r in rows:
        assert (r.r is None) == (r.x != r.x) and (r.r is None or Fraction(r.r.num, r.r.den) == Fraction(r.x))
    ties = spark.createDataFrame([(n,) for n in range(-12, 13)], "n long").select("n", scalar.round_ratio("n", F.lit(4)).alias("q")).collect()
    assert all(r.q == round(Fraction(r.n, 4)) for r in ties)


def test_decimal_ratios_take_no_loops(spark):
    """Equal to exact fractions at the edges, without a fold over decimals a row."""
    from fractions import Fraction

    texts = [f"{sign}{2**i * 5**j * k:019d}"[-18:] for sign in ("", "-") for i in range(0, 20, 3) for j in range(0, 12, 2) for k in (1, 3, 49)]
    texts = [sign + (t[:-p] + "." + t[-p:] if p else t) for t in {t.lstrip("-") for t in texts} for p in (0, 2, 17) for sign in ("", "-", "+")]
    texts += ["0.00000000000000001", "999999999999999999", "-0.00", "5."]
    bad = ["0.000000000000000000", "1.2.3", "--1", "", "9223372036854775808", "-9223372036854775808", "1" * 50, "0." + "0" * 40]
    df = spark.createDataFrame([(t,) for t in texts + bad], "s string").select("s", scalar.decimal_ratio("s").alias("r"))
    for r in df.collect():
        assert r.r is None if r.s in bad else Fraction(r.s.rstrip(".")).as_integer_ratio() == (int(r.r.num), int(r.r.den)), r.s
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
