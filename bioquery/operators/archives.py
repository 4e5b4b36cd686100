"""Archives of files as tables of entries, packets of the window codec, and volumes.

An entry is (path, method, original_size, stored, stored_size, sha256); offsets
follow from sizes in the order of paths.  Each file is one row, packed and
checked by itself, so an archive has no part that must be one task's.
"""

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bioquery.functions import scalar
from bioquery.operators import kernels

#: First bytes of known files, longest first: fixed values.
MAGIC = (("LML1", "packet"), ("LMA1", "archive"), ("BCS2", "container"), ("LQTP1", "tensor"))
#: Packet header: magic, channels, samples, levels, flags, length of the predictions, length of the payload, checksum.
HEADER = "<4sHIBBHII"
MOST_VOLUMES = 999
AT_ONCE = 64  # files that a task packs before it hands them on


def pack(files: DataFrame, level=3) -> DataFrame:
    """Entries of files (path, content): the extension's method, stored as it is where that isn't strictly smaller.

    A content that is null could not be read: its entry has method 'error'.
    Absolute paths, drive letters and '..' are refused.
    """
    checked = files.select(F.when(scalar.unsafe_path("path"), F.raise_error(F.concat(F.lit("unsafe path "), F.coalesce("path", F.lit("(null)")))).cast("string")).otherwise(F.col("path")).alias("path"), "content", scalar.method_of("path").alias("method"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)

        def entry(path, content, method):
            if content is None:
                return path, "error", 0, b"", 0, None
            packed = content if method == "store" else packer.compress(content)
            how, stored = ("zstd", packed) if len(packed) < len(content) else ("store", content)
            return path, how, len(content), stored, len(stored), hashlib.sha256(content).hexdigest()

        types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = [entry(*row) for row in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "method", "original_size", "stored", "stored_size", "sha256"])

    return checked.mapInArrow(run, "path string, method string, original_size long, stored binary, stored_size long, sha256 string")


def extract(entries: DataFrame) -> DataFrame:
    """(path, content, ok): unpacked entries; ok if size and digest are as recorded, content null if it can't be unpacked."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        def file(path, method, size, stored, sha):
            content = stored if method == "store" else None
            if method == "zstd":
                try:
                    content = zstandard.ZstdDecompressor().decompress(stored, max_output_size=max(1, size))
                except zstandard.ZstdError:
                    content = None
            return path, content, content is not None and len(content) == size and hashlib.sha256(content).hexdigest() == sha

        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = [file(*row) for row in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.bool_()), strict=True)], names=["path", "content", "ok"])

    return entries.select("path", "method", "original_size", "stored", "sha256").mapInArrow(run, "path string, content binary, ok boolean")


def find_entries(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, path): the entry of each name, by its whole path, else the first path that ends with it after a slash; null if none does."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    paths = entries.select("path", base("path").alias("base"))
    near = wanted.select("name", base("name").alias("base")).distinct().join(paths, "base", "left")
    whole = F.col("path") == F.col("name")
    fits = F.when(whole | F.endswith("path", F.concat(F.lit("/"), "name")), F.struct(~whole, F.col("path").alias("path")))
    return near.groupBy("name").agg(F.min(fits).alias("best")).select("name", F.col("best.path").alias("path"))


def prefixes(entries: DataFrame, wanted: DataFrame, n_bytes: int) -> DataFrame:
    """(name, prefix): the first bytes of entries that are stored as they are; null for others and for missing ones."""
    head = F.when(F.col("method") == "store", F.substring("stored", 1, n_bytes))
    return wanted.select("name").join(entries.select(F.col("path").alias("name"), head.alias("prefix")), "name", "left")


def listing(entries: DataFrame) -> DataFrame:
    """(dir, n_files, original, stored): every directory with all that is below it; '' is the whole archive."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return entries.select(F.explode(above).alias("dir"), "original_size", "stored_size").groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("original_size").alias("original"), F.sum("stored_size").alias("stored"))


def verify(entries: DataFrame, archives: DataFrame, keys=("archive",)) -> DataFrame:
    """(keys, path, status) of entries (keys, path, offset, stored_size, sha256, seen_sha256) in archives (keys, payload_size).

    The first failure of bounds, unpacking (seen_sha256 null) and digest.
    """
    both = entries.join(archives, list(keys), "left")
    outside = F.col("payload_size").isNull() | (F.col("offset") < 0) | (F.col("offset") + F.col("stored_size") > F.col("payload_size"))
    status = F.when(outside, "OUT OF BOUNDS").when(F.col("seen_sha256").isNull(), "UNREADABLE").when(F.col("seen_sha256") != F.col("sha256"), "SHA256 MISMATCH").otherwise("OK")
    return both.select(*keys, "path", status.alias("status"))


def dispatch(files: DataFrame) -> DataFrame:
    """(path, kind): by the first bytes of content; 'unknown' for others, 'empty' for none."""
    head = F.substring("content", 1, 5)
    kind = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty")
    for magic, name in sorted(MAGIC, key=lambda m: -len(m[0])):
        kind = kind.when(F.substring(head, 1, len(magic)) == F.lit(magic.encode()), name)
    return files.select("path", kind.otherwise("unknown").alias("kind"))


def compare_slices(original: DataFrame, recovered: DataFrame, slices=("signal", "header", "other", "trailing"), key="path") -> DataFrame:
    """(key, match, first_diff): whether the digests of all slices agree, and the first that doesn't; 'missing' if there is no recovered file."""
    back = recovered.select(key, F.lit(True).alias("there"), *[F.col(s).alias(f"{s}_back") for s in slices])
    diff = F.when(F.col("there").isNull(), "missing")
    for s in slices:
        diff = diff.when(~F.col(s).eqNullSafe(F.col(f"{s}_back")), s)
    return original.join(back, key, "left").select(key, diff.alias("first_diff")).withColumn("match", F.col("first_diff").isNull())


def encode_packet(x, predict=True) -> bytes:
    """One channel window as a packet: header, predictions, codes; the checksum covers the header's fields too."""
    import numpy as np

    parts = kernels.encode_window(x, predict)
    meta = b"".join(struct.pack("<B", len(c)) + np.asarray(c, dtype="<i4").tobytes() for c, _ in parts)
    payload = b"".join(struct.pack("<I", len(data)) + data for _, data in parts)
    fields = struct.pack(HEADER, b"LML1", 1, len(x), len(parts) - 1, int(predict), len(meta), len(payload), 0)
    crc = zlib.crc32(fields[4:18] + meta + payload)
    return fields[:18] + struct.pack("<I", crc) + meta + payload


def decode_packet(data: bytes):
    """The samples of a packet; a checksum without the header's fields, as older packets have it, is taken too; else ValueError."""
    import numpy as np

    if len(data) < struct.calcsize(HEADER) or data[:4] != b"LML1":
        raise ValueError("no packet")
    _, _, n, levels, _, n_meta, n_payload, crc = struct.unpack_from(HEADER, data)
    body = data[struct.calcsize(HEADER) :]
    if len(body) != n_meta + n_payload or crc not in (zlib.crc32(data[4:18] + body), zlib.crc32(body)):
        raise ValueError("checksum")
    at, parts, where = 0, [], n_meta
    for _ in range(levels + 1):
        size = body[at]
        c = np.frombuffer(body[at + 1 : at + 1 + 4 * size], dtype="<i4").tolist()
        at += 1 + 4 * size
        (length,) = struct.unpack_from("<I", body, where)
        parts.append((c, body[where + 4 : where + 4 + length]))
        where += 4 + length
    out = kernels.decode_window(parts)
    if len(out) != n:
        raise ValueError("length")
    return out


def volumes(files: DataFrame, size: int) -> DataFrame:
    """(path, volume, start, end): byte ranges of files (path, n_bytes); an empty file, or more than 999 volumes, is an error."""
    n = F.ceil(F.col("n_bytes") / F.lit(size)).cast("long")
    n = F.when(F.col("n_bytes") <= 0, F.raise_error(F.concat("path", F.lit(" is empty"))).cast("long")).when(n > MOST_VOLUMES, F.raise_error(F.concat("path", F.lit(" would take more than 999 volumes"))).cast("long")).otherwise(n)
    rows = files.select("path", "n_bytes", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("volume"))
    return rows.select("path", "volume", ((F.col("volume") - 1) * size).alias("start"), F.least(F.col("volume") * size, F.col("n_bytes")).alias("end"))


def assemble(parts: DataFrame) -> DataFrame:
    """(path, n_bytes, problem) of volumes (path, volume, n_bytes): the first number that is missing or there twice, else null."""
    order = W.partitionBy("path").orderBy("volume")
    gap = F.when(F.col("volume") != F.row_number().over(order), F.row_number().over(order))
    return parts.withColumn("gap", gap).groupBy("path").agg(F.sum("n_bytes").alias("n_bytes"), F.min("gap").cast("long").alias("problem"))


def concat_order(inputs: DataFrame, keys=("rec",)) -> DataFrame:
    """(keys, path, place, problem) of inputs (keys, path, chunk, n_chunks): by chunk if all have one, else by path.

    Markers that disagree on their number, or don't cover 0 .. n - 1 once each,
    are a problem: nothing is guessed.
    """
    keys = list(keys)
    of = inputs.groupBy(*keys).agg(F.count("*").alias("files"), F.count("chunk").alias("marked"), F.min("n_chunks").alias("low"), F.max("n_chunks").alias("high"), F.countDistinct("chunk").alias("kinds"), F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    marked = F.col("marked") == F.col("files")
    covered = (F.col("kinds") == F.col("files")) & (F.col("first") == 0) & (F.col("last") == F.col("files") - 1)
    problem = F.when(marked & (F.col("low") != F.col("high")), "chunk counts disagree").when(marked & (F.col("low") != F.col("files")), "wrong number of files").when(marked & ~covered, "gap or repeat")
    both = inputs.join(of.select(*keys, marked.alias("by_chunk"), problem.alias("problem")), keys)
    order = W.partitionBy(*keys).orderBy(F.when(F.col("by_chunk"), F.col("chunk")), "path")
    return both.select(*keys, "path", F.when(F.col("problem").isNull(), F.row_number().over(order) - 1).cast("long").alias("place"), "problem")


def registry_status(pins: DataFrame, files: DataFrame) -> DataFrame:
    """(name, version, status) of pins (name, version, sha256) against files (name, version, sha256)."""
    have = files.select("name", "version", F.col("sha256").alias("have"))
    status = F.when(F.col("have").isNull(), "MISSING").when(F.col("have") != F.col("sha256"), "SHA256 MISMATCH").otherwise("OK")
    return pins.join(have, ["name", "version"], "left").select("name", "version", status.alias("status"))


def history(log: DataFrame, n: int, keys=("name",)) -> DataFrame:
    """The last n rows of each name, newest first, with their place; only n rows a task and name are sorted together."""
    order = W.partitionBy(*keys).orderBy(F.desc("at"), F.desc("version"))
    return log.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def hmac_sha256(key: bytes, message):
    """Column: the keyed digest of a binary column, as hexadecimal digits."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
