"""Exact deduplication by a grace hash: recursive partitions, then open addressing on whole contents.

Texts are equal when they are identical after lower-casing ``A-Z``.  A first
pass runs over every input partition: it hashes each text, spreads what does not
fit in memory over spill files by bits of the hash, recursively, until a bucket
fits, and finds equal texts in an open-addressing table that compares complete
contents.  So a group of copies leaves each partition as one text with a count
and its largest id; ids go out as they come and take no room.  The second pass deals these texts by hash and does the same
for them; a group of any size arrives as one row per input partition.  Last,
every document takes the result of its text by a join on the local group, whose
rows come from one input partition.

Edges: null counts as the empty text; rows that repeat an id and a text are
counted each; null ids count and are never kept unless no other row of the
text has an id (then keep_id is null and none is kept).  Extra columns are
not looked at.
"""

import hashlib
import itertools
import os
import pickle
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bioquery.llm import common, words

FAN_BITS = 4  # each level spreads a bucket over 2**FAN_BITS files
BUDGET = 96 << 20  # bytes of texts that a table holds at most


class ContentTable:
    """Open addressing with linear probing; entries are equal only if their whole contents are."""

    def __init__(self, slots=1 << 10):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.hashes, self.contents, self.numbers = [], [], []
        self.bytes = 0

    def slot(self, code, content):
        mask = len(self.slots) - 1
        at = code & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                return at, int(entry)
            at = (at + 1) & mask
        return at, -1

    def add(self, at, code, content, number):
        self.slots[at] = len(self.hashes)
        self.hashes.append(code)
        self.contents.append(content)
        self.numbers.append(number)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()

    def _grow(self):
        size = 4 * len(self.slots)
        self.slots = np.full(size, -1, dtype=np.int64)
        for entry, code in enumerate(self.hashes):
            at = code & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = entry


def grace(records, budget=BUDGET, held=0, level=0, folder=None, numbers=None):
    """Groups records (hash, content, value) by whole contents.

    Yields (number, None, None, value) for every record at once, so that values
    take no room here, and (number, hash, content, None) for every content when
    all its records have been given out.  held: bytes that the caller keeps for
    each value until then; they count towards the budget.

    Once the table is full, records of contents that it does not hold go to
    spill files by the next bits of their hash; those it holds are still added.
    Spill files belong to the task and go when it ends.
    """
    table, files, own = ContentTable(), None, None
    shift = level * FAN_BITS
    numbers = numbers or itertools.count()
    try:
        for code, content, value in records:
            if files is None and table.bytes > budget and shift < 60:
                own = tempfile.mkdtemp(prefix="grace-", dir=folder)
                files = [open(os.path.join(own, str(i)), "w+b") for i in range(1 << FAN_BITS)]  # noqa: SIM115
            at, entry = table.slot(code, content)
            if entry < 0 and files is not None:
                pickle.dump((code, content, value), files[code >> (60 - shift) & (1 << FAN_BITS) - 1], protocol=5)
                continue
            if entry < 0:
                number = next(numbers)
                table.add(at, code, content, number)
            else:
                number = table.numbers[entry]
            table.bytes += held
            yield number, None, None, value
        for number, code, content in zip(table.numbers, table.hashes, table.contents, strict=True):
            yield number, code, content, None
        table = None
        for i, file in enumerate(files or ()):
            file.seek(0)
            if os.fstat(file.fileno()).st_size:
                yield from grace(_reload(file), budget, held, level + 1, own, numbers)
            file.close()
            os.remove(os.path.join(own, str(i)))
    finally:
        for file in files or ():
            file.close()
        if own:
            shutil.rmtree(own, ignore_errors=True)


def _reload(file):
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _normal(text):
    return (text or "").encode().translate(words._LOWER)


def _batches(rows, names, types, most=4096, budget=8 << 20):
    """Arrow batches of tuples; the third value may be a long text."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[2] or b"")
        if len(held) >= most or size > budget:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def deduplicate(docs: DataFrame, budget=BUDGET, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    store = common.Store(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40

        def records():
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        content = _normal(text)
                        yield int.from_bytes(hashlib.sha256(content).digest()[:8], "big"), content, doc_id

        def rows():
            sums = {}  # of the contents in the table: how many records and the largest id
            for number, code, content, doc_id in grace(records(), budget):
                if content is None:
                    n, top = sums.get(number, (0, None))
                    sums[number] = n + 1, top if doc_id is None or top is not None and top > doc_id else doc_id
                    yield base + number, None, None, doc_id, None
                else:
                    n, top = sums.pop(number)
                    yield base + number, code - (1 << 63), content, top, n

        return _batches(rows(), ["grp", "code", "content", "doc_id", "n"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()])

    found = store.put(texts.mapInArrow(local, "grp long, code long, content binary, doc_id long, n long"), "local")

    def merged(batches):
        import pyarrow as pa

        def records():
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    for code, content, *value in zip(*(part.column(k).to_pylist() for k in (1, 2, 0, 3, 4)), strict=True):
                        yield code + (1 << 63), content, tuple(value)

        def rows():
            held = {}  # of the contents in the table: a value for each input partition that has it
            for number, _, content, value in grace(records(), budget, held=160):
                if content is None:
                    held.setdefault(number, []).append(value)
                    continue
                parts = held.pop(number)
                keep = max((top for _, top, _ in parts if top is not None), default=None)
                size = sum(n for _, _, n in parts)
                digest = hashlib.sha256(content).hexdigest()
                for group, _, _ in parts:
                    yield group, keep, digest, size

        return _batches(rows(), ["grp", "keep_id", "text_sha256", "group_size"], [pa.int64(), pa.int64(), pa.string(), pa.int64()])

    dealt = found.where("code is not null").repartition(common.partitions(spark), "code")
    groups = store.put(dealt.mapInArrow(merged, "grp long, keep_id long, text_sha256 string, group_size long"), "groups")
    members = found.where("code is null").select("grp", "doc_id")
    return members.join(groups, "grp").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
