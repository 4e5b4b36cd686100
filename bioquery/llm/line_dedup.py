"""Line dedup: a suffix array over line ids by prefix doubling, whose intervals are repeated line runs.

The corpus is the sequence of its documents' lines, in the order of ids; runs
stay inside documents.  A run counts from ``min_words`` words on (a line counts
as one word at least).  All copies of a repeated run but the first are deleted;
one that overlaps the first counts from where the first ends, so ten equal lines
leave one whole run.

1. Documents with one text are one; each later copy of enough words goes whole.
2. Prefix doubling: rank 0 of a position is its line; the pairs of ranks of two
   blocks side by side, sorted and numbered, are the ranks of blocks of twice
   the lines.  Sorting deals distinct pairs by range, so a pair that stands at
   very many places is one row.  Positions whose block is unique are settled
   and leave; doubling ends at the longest window below, ``min_words`` at most.
3. For each position the shortest window of min_words words that starts there,
   and the one that ends there.  Positions whose windows of m lines are equal
   (equal ranks of the two blocks of 2**k lines that cover the window) are one
   interval of the suffix array with a common prefix of at least m lines.  The
   first in text order is kept, those that begin after its end are later copies.
4. A maximal repeated run is the union of such windows, so deleting the later
   copies of all windows deletes the later copies of all maximal runs exactly.

Line ids are 128-bit hashes of the line without trailing white space.
Edges: a null text counts as empty and stays null; rows that repeat an id and its
text are one document, whose copies go only with it; rows without an id, or whose
id has several texts, have no place in the order and stay as they are; an empty
table stays empty.  Other columns are kept
as they are, whatever their names.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bioquery.llm import common

MIN_WORDS = 25


def _windows(weight, least):
    """(start, lines) of the shortest windows of enough weight that start or end at each position."""
    total = np.concatenate([[0], np.cumsum(weight)])
    n = len(weight)
    ends = np.searchsorted(total, total[:-1] + least)  # smallest e with total[e] - total[s] >= least
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1  # largest s with total[e] - total[s] >= least
    forward = [(s, e - s) for s, e in enumerate(ends.tolist()) if e <= n]
    backward = [(s, e + 1 - s) for e, s in enumerate(starts.tolist()) if s >= 0]
    return sorted({*forward, *backward})


_COLUMNS = ["doc", "same", "weight", "ids", "more", "starts", "sizes"]
_SCHEMA = "doc long, same binary, weight long, ids array<long>, more array<long>, starts array<int>, sizes array<int>"


def _sequences(least):
    """(doc, hash of the text, weight, lines as ids of two halves, windows) of rows (doc, text)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                same, total, ids, more, starts, sizes = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode()
                    lines = [line.rstrip() for line in data.split(b"\n")]
                    weight = [max(1, len(line.split())) for line in lines]
                    windows = _windows(np.array(weight), least)
                    same.append(hashlib.md5(data).digest())
                    total.append(sum(weight))
                    codes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), dtype=np.int64).reshape(-1, 2)
                    ids.append(codes[:, 0])
                    more.append(codes[:, 1])
                    starts.append([s for s, _ in windows])
                    sizes.append([m for _, m in windows])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, type=pa.binary()), pa.array(total, type=pa.int64()), *(pa.array(x, type=pa.list_(pa.int64())) for x in (ids, more)), *(pa.array(x, type=pa.list_(pa.int32())) for x in (starts, sizes))], names=_COLUMNS)

    return run


def _ranked(spark, store, rows, keys, level):
    """Rows (doc, pos, keys) whose keys occur twice or more, with the rank of their keys in sorted order."""
    rows = store.put(rows, f"blocks{level}")
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    order = many.repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys)
    ranks = store.put(order.withColumn("number", F.monotonically_increasing_id()), f"ranks{level}")
    return store.put(rows.join(ranks, keys).select("doc", "pos", F.col("number").alias("rank")), f"suffixes{level}")


def _of_one_text(store, sequences):
    """One row for each id that has one text."""
    again = store.put(sequences.groupBy("doc").agg(F.count("*").alias("n"), F.min("same").alias("low"), F.max("same").alias("high")).where("n > 1"), "again")
    if again.isEmpty():
        return sequences
    once = sequences.join(again.where("low = high").select("doc"), "doc", "left_semi").dropDuplicates(["doc"])
    return store.put(sequences.join(again.select("doc"), "doc", "left_anti").unionByName(once), "single")


def _lines(sequences):
    zipped = F.posexplode(F.arrays_zip("ids", "more")).alias("pos", "id")
    return sequences.select("doc", zipped).select("doc", "pos", F.col("id.ids").alias("line"), F.col("id.more").alias("more"))


def _beside(left, right, lines):
    """Ranks of blocks side by side: rank of the block at a position, next of the one that begins lines after it."""
    after = right.select("doc", (F.col("pos") - lines).alias("pos"), F.col("rank").alias("next"))
    return left.join(after.where("pos >= 0"), ["doc", "pos"]).select("doc", "pos", "rank", "next")


def _doubled(spark, store, levels):
    """Ranks of blocks of twice the lines of the last level."""
    pairs = _beside(levels[-1], levels[-1], 2 ** (len(levels) - 1))
    return _ranked(spark, store, pairs, ["rank", "next"], len(levels))


def runs(docs: DataFrame, min_words=MIN_WORDS, id_column="doc_id", text_column="text"):
    """(later, copies): windows (doc, start, lines) to delete, and documents (doc) that are later copies as a whole."""
    spark = docs.sparkSession
    store = common.Store(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    sequences = _of_one_text(store, store.put(texts.mapInArrow(common.lean(_sequences(min_words)), _SCHEMA), "sequences"))
    first = store.put(sequences.groupBy("same").agg(F.min("doc").alias("first")), "first")
    known = sequences.join(first, "same").withColumn("original", F.col("doc") == F.col("first"))
    known = store.put(known, "known")
    copies = known.where(~F.col("original")).where(F.col("weight") >= min_words).select("doc")
    originals = known.where("original")

    levels = [_ranked(spark, store, _lines(originals), ["line", "more"], 0)]
    windows = store.put(originals.select("doc", F.explode(F.arrays_zip("starts", "sizes")).alias("w")).select("doc", F.col("w.starts").alias("start"), F.col("w.sizes").alias("m")), "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0
    while 2 ** len(levels) <= longest:
        levels.append(_doubled(spark, store, levels))

    later = None
    for k, level in enumerate(levels):
        of_size = windows.where((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1))).withColumn("pos", F.col("start"))
        of_size = of_size.join(level.withColumnRenamed("rank", "a"), ["doc", "pos"]).withColumn("pos", F.col("start") + F.col("m") - 2**k)
        of_size = store.put(of_size.join(level.withColumnRenamed("rank", "b"), ["doc", "pos"]).select("doc", "start", "m", "a", "b"), f"intervals{k}")
        head = store.put(of_size.groupBy("m", "a", "b").agg(F.min(F.struct("doc", "start")).alias("head"), F.count("*").alias("n")).where("n > 1").select("m", "a", "b", "head"), f"heads{k}")
        part = of_size.join(head, ["m", "a", "b"]).where((F.col("doc") != F.col("head.doc")) | (F.col("start") >= F.col("head.start") + F.col("m"))).select("doc", "start", "m")
        later = part if later is None else later.unionByName(part)
    return store.put(later, "later"), store.put(copies, "copies")


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType()), T.StructField("runs", T.StringType())])


def _rewrite(rows):
    """Adds to rows (others .., text, windows, copy) what is left of the text without the lines of its windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_columns
                out = []
                for text, windows, copy in zip(*(part.column(k).to_pylist() for k in (n - 3, n - 2, n - 1)), strict=True):
                    lines = (text or "").split("\n")
                    gone = np.zeros(len(lines) + 1, dtype=np.int64)
                    if copy:
                        gone[0] += 1
                    for w in windows or ():
                        gone[w["start"]] += 1
                        gone[w["start"] + w["m"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
                    spans = ",".join(f"{s}:{e}" for s, e in edge.reshape(-1, 2).tolist())
                    left = "\n".join([line for line, g in zip(lines, gone.tolist(), strict=True) if not g]) if gone.any() else text
                    out.append({"text": left, "n_lines": len(lines), "n_deleted": int(gone.sum()), "runs": spans})
                kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_deleted", pa.int64()), ("runs", pa.string())])
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(out, type=kind)], names=[*part.schema.names[:-2], "result"])

    return rows.mapInArrow(common.lean(run), T.StructType([*rows.schema.fields[:-2], T.StructField("result", RESULT)]))


def delete_later_copies(docs: DataFrame, min_words=MIN_WORDS, id_column="doc_id", text_column="text") -> DataFrame:
    """The rows and columns of docs, and last a struct of text, n_lines, n_deleted and runs (start:end of lines, comma-joined).

    That column is called ``lines``, with underscores before if docs has such a one.
    """
    store = common.Store(docs.sparkSession)
    result = common.fresh(docs.columns, "lines")
    later, copies = runs(docs.where(F.col(id_column).isNotNull()), min_words, id_column, text_column)
    cuts = later.groupBy("doc").agg(F.collect_list(F.struct("start", "m")).alias("windows"))
    cuts = cuts.join(copies.withColumn("copy", F.lit(True)).dropDuplicates(["doc"]), "doc", "full").select("doc", "windows", F.coalesce("copy", F.lit(False)).alias("copy"))
    cuts = store.put(cuts, "cuts")
    # the columns of docs by number, so that their names can't clash
    named = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    joined = named.join(cuts.hint("merge"), F.col(place[id_column]).cast("long") == F.col("doc"), "left")
    rows = joined.select(*[c for c in named.columns if c != place[text_column]], place[text_column], "windows", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = _rewrite(rows)
    return out.select(*[F.col(place[c]).alias(c) for c in docs.columns], F.col("result").alias(result))
