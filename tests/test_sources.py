import numpy as np
import pytest

from bioquery.sources import edf, files


def make(bdf=False, records=4, spr=(8, 4, 6)):
    r = np.random.default_rng(1)
    top = 1 << (23 if bdf else 15)
    head = {"bdf": bdf, "patient": "X Y", "recording": "R", "start": "01.02.20 03.04.05", "records": records, "seconds": 1.0, "label": ["C3", "EDF Annotations", "C4"], "transducer": [""] * 3, "unit": ["uV"] * 3, "phys_min": ["-200"] * 3, "phys_max": ["200"] * 3, "dig_min": [str(-top)] * 3, "dig_max": [str(top - 1)] * 3, "prefilter": [""] * 3, "spr": list(spr), "reserved": [""] * 3}
    return head, [r.integers(-top, top, s * records) for s in spr]


@pytest.mark.parametrize("bdf", [False, True])
def test_edf_round_trip(spark, tmp_path, bdf):
    head, signals = make(bdf)
    data = edf.render(head, signals, b"tail")
    parsed = edf.parse_header(data)
    got, trailing = edf.parse_samples(data, parsed)
    assert all((a == b).all() for a, b in zip(got, signals, strict=True))
    assert trailing == b"tail"
    assert edf.render(parsed, got, trailing) == data
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.edf").write_bytes(data)
    rows = edf.samples(spark, str(tmp_path)).collect()
    assert [r.x for r in sorted(rows, key=lambda r: (r.ch, r.t))] == [*signals[0].tolist(), *signals[2].tolist()]
    assert edf.channels(spark, str(tmp_path)).where("rate = 8").count() == 1
    top = edf.calibrated(spark, str(tmp_path)).agg({"value": "max"}).first()[0]
    assert -200 <= top <= 200
    clean = edf.strip_identity(data)
    assert len(clean) == len(data)
    assert clean[8:168] == b" " * 160


def test_annotations():
    assert edf.annotations(b"+0\x14\x14\0+1.5\x152\x14Eye\x14Blink\x14\0\0") == [(1.5, 2.0, "Eye"), (1.5, 2.0, "Blink")]


def test_integers():
    x = np.array([[1, -2, 3], [-4, 5, -6]])
    for kind, width in (("i16", 2), ("i32", 4), ("i24", 3)):
        for big in (False, True):
            for wide, order in ((True, x.T), (False, x)):
                raw = b"".join(int(v).to_bytes(width, "big" if big else "little", signed=True) for v in order.ravel())
                assert (files.integers(raw, kind, 2, wide, big) == x).all()
    with pytest.raises(ValueError, match="frames"):
        files.integers(b"123", "i16", 2)
    with pytest.raises(ValueError, match="finite"):
        files.float_bits(np.array([np.nan], dtype="<f4").tobytes())


def test_described_and_text(spark, tmp_path):
    x = np.arange(-10, 10, dtype="<i2")
    (tmp_path / "a.raw").write_bytes(x.tobytes())
    rows = files.read_described(spark, str(tmp_path), {"dtype": "i16", "channels": 2}).collect()
    assert sorted((r.ch, r.t, r.x) for r in rows) == sorted((i % 2, i // 2, int(v)) for i, v in enumerate(x))
    with pytest.raises(ValueError, match="descriptor"):
        files.read_described(spark, str(tmp_path), {"dtype": "f32", "channels": 2})
    (tmp_path / "Z001.txt").write_text("  12\n -40\n 300\n")
    t = files.ascii_template(spark.read.text(str(tmp_path / "Z001.txt"))).first()
    assert (t.integers, t.width, t.crlf, t.n) == (True, 4, False, 3)
    (tmp_path / "sub-01_task-rest_events.tsv").write_text("onset\tduration\ttrial_type\n1.5\tn/a\tgo\n")
    e = files.read_tsv(spark, str(tmp_path / "*_events.tsv"), "onset double, duration double, trial_type string").first()
    assert (e.onset, e.duration, e.entities) == (1.5, None, {"sub": "01", "task": "rest"})


def test_brainvision_and_cnt():
    text = "Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile=a.eeg\nDataOrientation=MULTIPLEXED\nNumberOfChannels=2\nSamplingInterval=4000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fp1,,0.1\nCh2=Fp2,,0.1\n"
    h = files.brainvision_header(text)
    assert (h["channels"], h["rate"], h["labels"], h["dtype"]) == (2, 250.0, ["Fp1", "Fp2"], "i16")
    with pytest.raises(ValueError, match="integer"):
        files.brainvision_header(text.replace("INT_16", "IEEE_FLOAT_32"))
    data = bytearray(900)
    data[370:372], data[376:378] = (2).to_bytes(2, "little"), (250).to_bytes(2, "little")
    body = np.arange(6, dtype="<i2")
    x, labels, rate = files.cnt_samples(bytes(data) + b"C3".ljust(75, b"\0") + b"C4".ljust(75, b"\0") + body.tobytes())
    assert (x == [[0, 2, 4], [1, 3, 5]]).all()
    assert (labels, rate) == (["C3", "C4"], 250)


def test_write_wide(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("a", 1, 3), ("b", 1, 4)], "ch string, t long, x long")
    files.write_wide(df, ["a", "b"], str(tmp_path / "o"))
    lines = [line for f in sorted((tmp_path / "o").glob("*.csv")) for line in f.read_text().split()]
    assert [x for x in lines if x.isdigit()] == ["1", "2", "3", "4"]
    files.write_wide(df, ["a", "b"], str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["t", "a", "b"]


VHDR = """Brain Vision Data Exchange Header File Version 1.0
[Common Infos]
DataFile=$b.eeg
DataFormat=BINARY
DataOrientation=MULTIPLEXED
NumberOfChannels=2
SamplingInterval=4000
[Binary Infos]
BinaryFormat=INT_16
[Channel Infos]
Ch1=C3,,0.1
Ch2=C4,,0.1
"""


def test_tables_of_other_formats(spark, tmp_path):
    from pyspark.errors import PySparkException

    r = np.random.default_rng(2)
    x = r.integers(-3000, 3000, (2, 50))
    where = lambda df: {(q.path.rsplit("/", 1)[-1], q.ch, q.t): q.x for q in df.collect()}
    want = lambda name, x: {(name, c, t): int(v) for c, row in enumerate(x) for t, v in enumerate(row)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "rec.vhdr").write_text(VHDR)
    (tmp_path / "s" / "rec.eeg").write_bytes(x.T.astype("<i2").tobytes())
    assert where(files.read_brainvision(spark, str(tmp_path))) == want("rec.vhdr", x)
    assert files.brainvision_headers(spark, str(tmp_path)).first().labels == ["C3", "C4"]
    (tmp_path / "s" / "lost.vhdr").write_text(VHDR)
    with pytest.raises(PySparkException, match="no data file"):
        files.read_brainvision(spark, str(tmp_path)).collect()
    head = bytearray(900)
    head[370:372], head[376:378] = (2).to_bytes(2, "little"), (250).to_bytes(2, "little")
    (tmp_path / "a.cnt").write_bytes(bytes(head) + b"C3".ljust(75, b"\0") + b"C4".ljust(75, b"\0") + x.T.astype("<i2").tobytes())
    assert where(files.read_cnt(spark, str(tmp_path))) == want("a.cnt", x)
    f = r.normal(size=(3, 20)).astype("<f4")
    (tmp_path / "b.fdt").write_bytes(f.T.tobytes())
    (tmp_path / "b.json").write_text('{"channels": 3}')
    assert where(files.read_eeglab(spark, str(tmp_path))) == want("b.fdt", f.view(np.uint32).astype(np.int64))
    (tmp_path / "c.fdt").write_bytes(f.T.tobytes())
    with pytest.raises(PySparkException, match="no channels"):
        files.read_eeglab(spark, str(tmp_path)).collect()


def test_raw_export(spark, tmp_path):
    import hashlib

    from pyspark.errors import PySparkException

    rows = [(k, ch, t, (k + 1) * 1000 * t - 5) for k in range(2) for ch in ("b", "a") for t in range(30)]
    df = spark.createDataFrame(rows, "rec long, ch string, t long, x long").repartition(3)
    for r in files.write_raw(df, str(tmp_path)).collect():
        data = (tmp_path / f"{r.rec}.i32").read_bytes()
        assert data == b"".join(x.to_bytes(4, "little", signed=True) for k, ch, t, x in sorted(rows) if k == r.rec)
        assert (r.n_bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    with pytest.raises(PySparkException, match="32 bits"):
        files.write_raw(spark.createDataFrame([(1, "a", 0, 1 << 31)], "rec long, ch string, t long, x long"), str(tmp_path)).collect()
