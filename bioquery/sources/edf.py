"""EDF and BDF files as DataFrames: one task a file, parsed from bytes."""

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ((16, "label"), (80, "transducer"), (8, "unit"), (8, "phys_min"), (8, "phys_max"), (8, "dig_min"), (8, "dig_max"), (80, "prefilter"), (8, "spr"), (32, "reserved"))  # widths of the signal header: fixed values
CHANNELS = "path string, ch int, label string, unit string, phys_min double, phys_max double, dig_min long, dig_max long, spr long, rate double, n_records long"


def parse_header(data: bytes) -> dict:
    if len(data) < 256:
        raise ValueError("no EDF header")
    bdf = data[:1] == b"\xff"
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    n = int(text(252, 4))
    head = {"bdf": bdf, "patient": text(8, 80), "recording": text(88, 80), "start": text(168, 8) + " " + text(176, 8), "bytes": int(text(184, 8)), "records": int(text(236, 8)), "seconds": float(text(244, 8)), "signals": n}
    at = 256
    for width, name in FIELDS:
        head[name] = [text(at + i * width, width) for i in range(n)]
        at += width * n
    head["spr"] = [int(x) for x in head["spr"]]
    return head


def parse_samples(data: bytes, head: dict):
    """Integer samples by signal, and the bytes after the last whole record."""
    width = 3 if head["bdf"] else 2
    spr = head["spr"]
    size = sum(spr) * width
    body = data[head["bytes"] :]
    n = len(body) // size if size else 0
    if head["records"] >= 0:
        n = min(n, head["records"])
    raw = np.frombuffer(body[: n * size], dtype=np.uint8).reshape(n, size)
    out, at = [], 0
    for s in spr:
        block = raw[:, at : at + s * width].reshape(-1, width).astype(np.int64)
        value = sum(block[:, b] << 8 * b for b in range(width))
        out.append(value - ((value >> (8 * width - 1)) << 8 * width))
        at += s * width
    return out, body[n * size :]


def is_annotation(label: str) -> bool:
    return "annotation" in label.lower()


def annotations(data: bytes):
    """(onset, duration, text) of time-stamped annotation lists."""
    out = []
    for entry in data.split(b"\0"):
        stamp, *texts = entry.decode("utf-8", "replace").split("\x14")
        onset, _, duration = stamp.partition("\x15")
        try:
            out += [(float(onset), float(duration) if duration else None, t) for t in texts if t]
        except ValueError:
            continue
    return out


def render(head: dict, signals, trailing=b"") -> bytes:
    """The file of a header and samples: what parse_header and parse_samples read."""
    n, width = len(signals), 3 if head["bdf"] else 2
    pad = lambda x, w: str(x).encode("latin-1")[:w].ljust(w)
    day, _, clock = head["start"].partition(" ")
    out = [b"\xffBIOSEMI" if head["bdf"] else pad("0", 8), pad(head["patient"], 80), pad(head["recording"], 80), pad(day, 8), pad(clock, 8), pad(256 * (n + 1), 8), pad("", 44), pad(head["records"], 8), pad(f"{head['seconds']:g}", 8), pad(n, 4)]
    out += [pad(v, w) for w, name in FIELDS for v in head.get(name, [""] * n)]
    for r in range(head["records"]):
        for x, s in zip(signals, head["spr"], strict=True):
            part = np.asarray(x[r * s : (r + 1) * s], dtype=np.int64)
            out.append(struct.pack(f"<{len(part)}i", *part) if width == 4 else part.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return b"".join(out) + trailing


def _files(spark, path):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[eEbB][dD][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")


def channels(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                h = parse_header(bytes(data))
                rows += [(name, i, h["label"][i], h["unit"][i], float(h["phys_min"][i]), float(h["phys_max"][i]), int(h["dig_min"][i]), int(h["dig_max"][i]), h["spr"][i], h["spr"][i] / h["seconds"] if h["seconds"] else 0.0, h["records"]) for i in range(h["signals"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHANNELS.split(", ")])

    return _files(spark, path).mapInPandas(run, CHANNELS)


def samples(spark: SparkSession, path: str, chunk=1 << 18) -> DataFrame:
    """(path, ch, t, x) of all signals that aren't annotations, in batches of chunk samples."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                head = parse_header(data)
                signals, _ = parse_samples(data, head)
                for ch, x in enumerate(signals):
                    if is_annotation(head["label"][ch]):
                        continue
                    for at in range(0, len(x), chunk):
                        part = x[at : at + chunk]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.full(len(part), ch, dtype=np.int32)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["path", "ch", "t", "x"])

    return _files(spark, path).mapInArrow(run, "path string, ch int, t long, x long")


def calibrated(spark: SparkSession, path: str) -> DataFrame:
    from bioquery.functions.scalar import calibrate

    of = channels(spark, path).select("path", "ch", "phys_min", "phys_max", "dig_min", "dig_max")
    return samples(spark, path).join(of, ["path", "ch"]).withColumn("value", calibrate("x", "phys_min", "phys_max", "dig_min", "dig_max"))


def strip_identity(data: bytes, dates: bool = True) -> bytes:
    """A header without patient and recording texts; dates become a fixed one unless kept."""
    out = data[:8] + b" " * 160 + data[168:]
    return out[:168] + b"01.01.8500.00.00" + out[184:] if dates else out


def strip_identity_column(header):
    """The same for a string column of headers."""
    return F.overlay(F.overlay(header, F.lit(" " * 160), 9), F.lit("01.01.8500.00.00"), 169)
