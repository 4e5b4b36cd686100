"""Jaccard self-join of documents on word n-grams, exact, with components.

Texts are lower-cased (A-Z) and split into words; a document's set holds the
64-bit hashes of its distinct runs of ``width`` words (all words as one run if
there are fewer).  Two documents link when
``denominator * |intersection| >= numerator * |union|``.

1. Documents with equal sets form a class, named by 64 bits of a digest; where
   its other 64 bits show that two classes share a name, they get other names.
2. Size bands: a linked pair differs in at most ``d`` n-grams, where ``d``
   follows from their sizes.  The range of hashes is cut into ``k > d``
   sections, the same for the whole band.  Each section is one hash of the
   n-grams in it; band, section and hash form the key of a tile.  A document
   sends its first ``d + 1`` sections that hold n-grams: the one of a linked pair
   that stops at the earlier section has at most ``d`` that the other lacks, so
   the pair meets in a tile of its band.  A document with fewer such sections
   sends all ``k``, empty ones too.  A task sends each tile to the others once,
   packed; what it holds of a tile with several members is known to be shared.
3. In each tile all members are compared with its hub, the member that meets
   most others: rows grow with the members, not with their pairs.  Every member
   meets the hub that it shares most tiles with first; what this links is
   contracted, and of the other pairs those between components follow.
4. Where a tile still holds several components beside its hub, its members are
   compared within that tile; of tiles with the same members one is taken.  Tiles
   of more than SPLIT_ABOVE members are dealt anew first: each member by those
   sections, beside the one that the tile stands for, that a linked pair must
   share by the same argument.  What is still larger than ``block`` is dealt into
   parts, and pairs of parts are compared, but the largest component isn't sent to meet itself.
   So no link between components is lost, and none is searched for where it
   cannot change the result.

A comparison bounds the intersection from above by the bits of two hashed bitmap
signatures first, and intersects the sorted arrays exactly if the bound allows.
A bitmap has at least twice as many bits as its set has n-grams, so that the
bound is close at any size; the larger of two is folded.  Sets are made again
from the texts only of those whom the bound leaves a partner.

Edges: null and empty texts, and texts without words, have size 0 and link with
nothing; rows that repeat an id are one document with one of their texts' sets
(ids are expected to be unique); null ids are their own component.  Extra columns
are not looked at.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bioquery.llm import common, words

LEAST_BITS, MOST_BITS = 512, 1 << 24  # of a bitmap signature: the power of two from twice the set's size on
KEYS_AT_ONCE = 1 << 18  # keys that a task packs together, about 15 MB with the arrays of sorting
SPLIT_ABOVE = 4096  # members of a tile that are dealt anew by a second section
MOST_CLASHES = 100_000  # names that several classes share: three are expected among 1e10 classes
KEYS_A_BUCKET = 1 << 20  # keys that meet in one group, if every n-gram gave one; fewer do


class Threshold:
    """denominator * |a & b| >= numerator * |a | b|, in whole numbers."""

    def __init__(self, numerator=90, denominator=100):
        self.numerator, self.denominator = numerator, denominator

    def needed(self, a, b):
        """Smallest intersection of linked sets of sizes a and b."""
        return -(-self.numerator * (a + b) // (self.numerator + self.denominator))

    def smallest(self, size):
        """Smallest size that can link with a set of this size."""
        return -(-self.numerator * size // self.denominator)

    def bands(self, size):
        """(band, sections, differences from any partner) of the bands that a set of this size is in.

        Bands start at sizes that grow by a quarter.  A set is in the band of its
        size, and in those above while it can link with a set there.
        """
        out, band = [], self.band(size)
        while size >= self.smallest(self.edge(band)):
            high = self.edge(band + 1) - 1
            most = self.differences(high, high)
            partner = min(high, size * self.denominator // self.numerator)
            out.append((band, most + most // 4 + 2 if most else 1, self.differences(size, partner)))
            band += 1
        return out

    def differences(self, a, b):
        """How many n-grams at most are in only one of linked sets of sizes up to a and b."""
        return (a + b) * (self.denominator - self.numerator) // (self.denominator + self.numerator)

    @staticmethod
    def edge(band):
        return int(1.25**band) if band >= 12 else band + 1 if band < 8 else (9, 11, 12, 14)[band - 8]

    def band(self, size):
        at = max(0, int(np.log(max(size, 1)) / np.log(1.25)) - 3)
        while self.edge(at + 1) <= size:
            at += 1
        while at and self.edge(at) > size:
            at -= 1
        return at


def _sets(column, width):
    """(row, sorted distinct n-gram hashes) of every text."""
    for first, raw, offsets in words.chunks(column):
        hashes, row = words.word_hashes(raw, offsets)
        at = np.searchsorted(row, np.arange(len(offsets)))
        del row
        for i in range(len(offsets) - 1):
            grams = words.shingles(hashes[at[i] : at[i + 1]], width)
            if len(offsets) == 2:
                hashes = None  # one very long text: not kept beside its set
            if len(grams) > 1:
                grams.sort()
                grams = grams[np.append(True, grams[1:] != grams[:-1])]
            yield first + i, grams


def _sections(grams, threshold):
    """(most differences, key of each section, which sections hold n-grams) of each band that a set is in."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words.mix(grams))])
    for band, sections, allowed in threshold.bands(len(grams)):
        step = ((1 << 64) - 1) // sections
        cuts = np.searchsorted(grams, (np.arange(1, sections, dtype=np.uint64) * np.uint64(step)))
        cuts = np.concatenate([[0], cuts, [len(grams)]])
        tag = words.mix(np.arange(sections, dtype=np.uint64) + np.uint64(band << 40))
        yield allowed, words.mix(tag ^ (total[cuts[1:]] - total[cuts[:-1]])), np.flatnonzero(cuts[1:] > cuts[:-1])


def _signatures(grams, threshold):
    """Keys of the tiles of a set: in each band, those of one section more than may differ."""
    # two sets that both have too few filled sections agree on one of all, maybe an empty one
    return np.concatenate([key[filled[: allowed + 1]] if len(filled) > allowed else key for allowed, key, filled in _sections(grams, threshold)])


def _planes(values):
    """Bytes of the values by significance: the high ones of sorted values compress to almost nothing."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data, dtype):
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _distinct_members(tile, node):
    """Members sorted by tile, without repeats."""
    if not len(tile):
        return tile, node
    order = np.lexsort((node, tile))
    tile, node = tile[order], node[order]
    new = np.append(True, (tile[1:] != tile[:-1]) | (node[1:] != node[:-1]))
    return tile[new], node[new]


def _in_company(tile):
    """Which of sorted tiles are there more than once."""
    same = tile[1:] == tile[:-1]
    return np.append(False, same) | np.append(same, False) if len(tile) else np.zeros(0, dtype=bool)


def _packed(tile, node, buckets):
    """Members (arrays of uint64) as rows (bucket, shared, tiles, nodes, which): which gives each tile's place in nodes.

    One member of each tile goes to the bucket of its tile.  All members of tiles
    that have several here are shared whatever others hold; they go to the bucket
    of tile and node, so that a frequent tile doesn't fill one bucket.
    """
    import pyarrow as pa

    tile, node = _distinct_members(tile, node)
    first, company = np.append(True, tile[1:] != tile[:-1]), _in_company(tile)
    rows = []
    for shared, kept in ((False, first), (True, company)):
        t, d = tile[kept], node[kept]
        if not len(t):
            continue
        bucket = ((t if not shared else words.mix(t ^ words.mix(d))) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        if shared:
            order = np.argsort(bucket, kind="stable")
            t, d, bucket = t[order], d[order], bucket[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
            names, which = np.unique(d[a:b], return_inverse=True)
            rows.append((int(bucket[a]), shared, _planes(t[a:b]), _planes(names), _planes(which.astype(np.uint32))))
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shared", "tiles", "nodes", "which"])


def _shared_members(pdf):
    """Members of tiles that several sets share, from the packed rows of one bucket."""
    import pandas as pd

    sent = {False: [], True: []}
    for shared, tiles, nodes, which in zip(pdf["shared"], pdf["tiles"], pdf["nodes"], pdf["which"], strict=True):
        sent[bool(shared)].append((_from_planes(tiles, np.uint64), _from_planes(nodes, np.uint64)[_from_planes(which, np.uint32)]))
    out = sent[True]
    if sent[False]:
        tile, node = _distinct_members(*(np.concatenate(x) for x in zip(*sent[False], strict=True)))
        several = _in_company(tile)
        out.append((tile[several], node[several]))
    tile, node = _distinct_members(*(np.concatenate(x) for x in zip(*out, strict=True)))
    return pd.DataFrame({"tile": tile.view(np.int64), "node": node.view(np.int64)})


def _bitmap(grams):
    size = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(grams) - 1).bit_length()))
    bits = np.zeros(size, dtype=bool)
    bits[(grams >> np.uint64(40)).astype(np.int64) & size - 1] = True
    return np.packbits(bits).view(np.uint64)


def _alike(bitmaps):
    """Bitmaps folded to the size of the smallest, as rows: bits that fall together are one."""
    size = min(map(len, bitmaps))
    return np.stack([b if len(b) == size else np.bitwise_or.reduce(b.reshape(-1, size), axis=0) for b in bitmaps])


def _read_bitmaps(column):
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for chunk in getattr(column, "chunks", [column]) for x in chunk]


def _overlap(a, b):
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _bound(a, b, size_a, size_b):
    """Upper bound of the intersection: a bit that only one bitmap has stands for an n-gram of that set alone."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def _linked(a, b, bits_a, bits_b, threshold):
    needed = threshold.needed(len(a), len(b))
    return min(len(a), len(b)) >= needed and _bound(bits_a, bits_b, len(a), len(b)) >= needed and _overlap(a, b) >= needed


def _bounded_rows(threshold):
    """Keeps the rows (a, b, size of a, size of b, bitmap of a, bitmap of b) whose bound allows a link."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            size_a, size_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            bits_a, bits_b = (_read_bitmaps(batch.column(i)) for i in (4, 5))
            needed = threshold.needed(size_a, size_b)
            keep = np.minimum(size_a, size_b) >= needed
            width = np.array([min(len(a), len(b)) for a, b in zip(bits_a, bits_b, strict=True)])
            for w in np.unique(width[keep]):
                at = np.flatnonzero(keep & (width == w))
                for part in np.array_split(at, max(1, len(at) * int(w) >> 20)):
                    both = _alike([bits_a[k] for k in part] + [bits_b[k] for k in part])
                    keep[part] = _bound(both[: len(part)], both[len(part) :], size_a[part], size_b[part]) >= needed[part]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _pair_rows(threshold):
    """Keeps the linked of rows (a, b, grams of a, grams of b)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(i)] for i in (2, 3)]
            keep = [_overlap(x, y) >= threshold.needed(len(x), len(y)) for x, y in zip(*sets, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _cells(batches):
    """The rows of each cell (tile, i, j), from batches that are sorted by these first three columns."""
    import pyarrow as pa

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            key = tuple(keys[:, a].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _column(table, name):
    return table.column(name).to_numpy()


def _in_batches(rows, names, types, most=20_000):
    """Record batches of lists of columns."""
    import pyarrow as pa

    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held]), type=t) for k, t in enumerate(types)], names=names)

    for columns in rows:
        held.append(columns)
        size += len(columns[0])
        if size >= most:
            yield batch()
            held, size = [], 0
    if size:
        yield batch()


def _possible(threshold):
    """Members of cells (sorted by size) that the bound allows to link with a member of another component there."""

    def kept(batches):
        for key, cell in _cells(batches):
            label, size = _column(cell, "component"), _column(cell, "n")
            if (label == label[0]).all():
                continue
            bits = _alike(_read_bitmaps(cell.column("bits")))
            keep = np.zeros(len(label), dtype=bool)
            last = np.searchsorted(size, size * threshold.denominator // threshold.numerator, side="right")
            for i in range(len(label)):
                others = np.arange(i + 1, last[i])
                others = others[label[others] != label[i]]
                if len(others):
                    others = others[_bound(bits[i], bits[others], size[i], size[others]) >= threshold.needed(size[i], size[others])]
                    keep[others] = True
                    keep[i] |= len(others) > 0
            n = int(keep.sum())
            if n:
                yield [*(np.full(n, k) for k in key), _column(cell, "node")[keep], label[keep]]

    def run(batches):
        import pyarrow as pa

        yield from _in_batches(kept(batches), ["tile", "i", "j", "node", "component"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])

    return run


def _cell_links(threshold):
    """Links between components in one cell (sorted by size); each found link joins two components for good."""

    def found(batches):
        for _, cell in _cells(batches):
            grams = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for chunk in cell.column("grams").chunks for x in chunk]
            node, label, size = _column(cell, "node"), _column(cell, "component").copy(), _column(cell, "n")
            bits = _alike([_bitmap(g) for g in grams])
            links = []
            for i in range(len(node)):
                others = np.arange(i + 1, np.searchsorted(size, size[i] * threshold.denominator // threshold.numerator, side="right"))
                others = others[label[others] != label[i]]
                if len(others):
                    others = others[_bound(bits[i], bits[others], size[i], size[others]) >= threshold.needed(size[i], size[others])]
                for j in others:
                    if label[j] != label[i] and _linked(grams[i], grams[j], bits[i], bits[j], threshold):
                        links.append((node[i], node[j]))
                        label[label == label[j]] = label[i]
            if links:
                yield [np.array(x) for x in zip(*links, strict=True)]

    def run(batches):
        import pyarrow as pa

        yield from _in_batches(found(batches), ["a", "b"], [pa.int64(), pa.int64()])

    return run


def _dealt_anew(threshold):
    """(tile, node, component) of rows (tile, node, component, grams): tiles by a second section of each member's band."""

    def keys(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tile = np.array([batch.column(0)[at].as_py()], dtype=np.int64).view(np.uint64)[0]
                grams = np.frombuffer(batch.column(3)[at].as_buffer(), dtype=np.uint64)
                for allowed, key, filled in _sections(grams, threshold):
                    place = np.flatnonzero(key == tile)
                    if not len(place):
                        continue
                    filled = filled[filled != place[0]]
                    second = key[filled[: allowed + 1]] if len(filled) > allowed else np.delete(key, place[0])
                    new = words.mix(second ^ words.mix(np.full(len(second), tile)))
                    yield [new.view(np.int64), np.full(len(new), batch.column(1)[at].as_py()), np.full(len(new), batch.column(2)[at].as_py())]

    def run(batches):
        import pyarrow as pa

        yield from _in_batches(keys(batches), ["tile", "node", "component"], [pa.int64()] * 3)

    return run


def _grams_of(rows, width, clashes):
    """(node, grams) of rows (node, text) whose text has that class: the set as bytes of sorted uint64."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, seen = batch.column(0).to_pylist(), set()
            for at in range(0, batch.num_rows, 512):
                out = []
                for row, grams in _sets(batch.column(1).slice(at, 512), width):
                    node = nodes[at + row]
                    if node not in seen and _class_of(grams, clashes) == node:
                        seen.add(node)
                        out.append((node, grams.tobytes()))
                columns = zip(*out, strict=True) if out else [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, (pa.int64(), pa.binary()), strict=True)], names=["node", "grams"])

    return rows.mapInArrow(common.lean(run), "node long, grams binary")


def _digest(grams):
    """A digest of the whole set as two signed 64-bit numbers."""
    import hashlib

    data = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def _class_of(grams, clashes=frozenset()):
    """Name of the class of a set; clashes: names that several classes would share."""
    name, other = _digest(grams)
    return other if name in clashes else name


def join(docs: DataFrame, width=3, numerator=90, denominator=100, block=256, split_above=SPLIT_ABOVE, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id."""
    spark = docs.sparkSession
    store = common.Store(spark)
    threshold = Threshold(numerator, denominator)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [(len(g), *_digest(g), _bitmap(g).tobytes()) for _, g in _sets(part.column(1), width)]
                columns = [pa.array([s[k] for s in sets], type=pa.int64() if k < 3 else pa.binary()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "node", "other", "bits"])

    digests = store.put(texts.mapInArrow(common.lean(digest), "doc_id long, n long, node long, other long, bits binary"), "sizes")
    clashes, sizes = frozenset(), digests
    while True:  # runs once unless names clash
        classes = store.put(sizes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("other").alias("low"), F.max("other").alias("high"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
        found = [r["node"] for r in classes.where("low <> high").select("node").limit(MOST_CLASHES + 1).collect()]
        if not found:
            break
        if len(found) > MOST_CLASHES or clashes & set(found):
            raise ValueError("too many classes share a name")
        clashes = clashes | set(found)
        renamed = digests.join(F.broadcast(spark.createDataFrame([(c,) for c in clashes], "clash long")), F.col("node") == F.col("clash"), "left")  # at most MOST_CLASHES numbers
        sizes = renamed.select("doc_id", "n", "bits", F.when(F.col("clash").isNotNull(), F.col("other")).otherwise(F.col("node")).alias("node"), F.when(F.col("clash").isNotNull(), F.col("node")).otherwise(F.col("other")).alias("other"))

    grams_in_all = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * common.partitions(spark), grams_in_all // KEYS_A_BUCKET + 1)

    def tiles(batches):
        keys, nodes, held = [], [], 0
        for batch in batches:
            for _, grams in _sets(batch.column(0), width):
                if not len(grams):
                    continue
                keys.append(_signatures(grams, threshold))
                nodes.append(np.full(len(keys[-1]), _class_of(grams, clashes)).view(np.uint64))
                held += len(keys[-1])
                if held > KEYS_AT_ONCE:
                    yield _packed(np.concatenate(keys), np.concatenate(nodes), buckets)
                    keys, nodes, held = [], [], 0
        if held:
            yield _packed(np.concatenate(keys), np.concatenate(nodes), buckets)

    packed = texts.select("text").mapInArrow(common.lean(tiles), "bucket int, shared boolean, tiles binary, nodes binary, which binary")
    shared = store.put(packed.groupBy("bucket").applyInPandas(lambda pdf: _shared_members(pdf), "tile long, node long").distinct(), "tiles")
    hubs = store.put(_hubs(shared), "hubs")
    shared = store.put(shared.join(hubs, "tile"), "tiles")
    store.sweep()
    pairs = store.put(shared.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n")), "pairs")
    bitmaps = classes.select("node", "n", "bits")
    ends = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
    close = pairs.groupBy(*ends).agg(F.max("n").alias("met"))
    close = store.put(_both_ends(close, bitmaps, "n", "bits").mapInArrow(common.lean(_bounded_rows(threshold)), "a long, b long").join(close, ["a", "b"]), "close")

    def sets_of(nodes, name):
        """The sets of some classes, from the texts of their first documents."""
        wanted = nodes.join(classes, "node").select("first", "node")
        return store.put(_grams_of(texts.join(wanted.hint("merge"), texts["doc_id"] == wanted["first"]).select("node", "text"), width, clashes), name)

    sets = sets_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "sets")
    store.sweep()

    # each with the hub that it meets most first; then those that are still apart
    either = close.select("a", "b", "met", F.explode(F.array("a", "b")).alias("node"))
    most = either.groupBy("node").agg(F.max(F.struct("met", "a", "b")).alias("top")).select("top.a", "top.b").distinct()
    links = _compare(store, most, sets, threshold)
    labels = store.put(common.components(spark, links, store), "labels")
    of = {c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")}
    apart = close.select("a", "b").join(of["a"], "a", "left").join(of["b"], "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)")
    links = links.unionByName(_compare(store, apart.select("a", "b"), sets, threshold))
    labels = store.put(common.components(spark, links, store), "labels")
    store.sweep()
    # hubs have met all others of their tiles
    known = shared.where("node <> hub").join(labels, "node", "left").select("tile", "node", F.coalesce("component", "node").alias("component"))
    more = _within_tiles(store, known, bitmaps, sets_of, threshold, block, split_above)
    if more is not None:
        labels = store.put(common.components(spark, links.unionByName(more), store), "labels")

    labelled = classes.join(labels, "node", "left").select("node", F.col("first").alias("class_id"), F.coalesce("component", "node").alias("component"))
    labelled = store.put(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = store.put(labelled.join(least, "component").select("node", "class_id", "component_id"), "result")
    full = sizes.where("n > 0").join(of_class, "node").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    bare = sizes.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def _both_ends(rows, sides, *columns):
    """Rows (a, b) with the columns of both nodes."""
    for end in ("a", "b"):
        side = sides.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        rows = rows.join(side.hint("merge"), end)
    return rows.select("a", "b", *[f"{c}_{end}" for c in columns for end in ("a", "b")])


def _compare(store, pairs, sets, threshold):
    """The linked of pairs (a, b), by the sets."""
    return store.put(_both_ends(pairs, sets, "grams").mapInArrow(common.lean(_pair_rows(threshold)), "a long, b long"), "links")


def _hubs(shared):
    """(tile, hub): of a tile's members the one that meets most others, over all its tiles.

    The original of many near copies has the sections that most of them have, so
    it outweighs each copy, also where two copies don't link.
    """
    weight = shared.join(shared.groupBy("tile").agg(F.count("*").alias("n")), "tile").groupBy("node").agg(F.sum("n").alias("weight"))
    return shared.join(weight, "node").groupBy("tile").agg(F.max(F.struct("weight", "node")).alias("top")).select("tile", F.col("top.node").alias("hub"))


def _several(members):
    """(tile, n) of the tiles of members (tile, node, component) that hold several components; one of those with the same members."""
    print_ = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"print{k}") for k in (1, 2)]  # 128 bits tell sets of members apart
    tiles = members.groupBy("tile").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), *print_).where("low < high")
    return tiles.groupBy("n", "print1", "print2").agg(F.min("tile").alias("tile")).select("tile", "n")


def _within_tiles(store, known, bitmaps, sets_of, threshold, block, split_above):
    """Links between the components of members (tile, node, component); None if no tile holds several."""
    known = store.put(known, "known")
    split = store.put(_several(known), "split")
    if split.isEmpty():
        return None
    members = known.join(split, "tile")
    large = members.where(F.col("n") > split_above)
    if not large.isEmpty():
        sets = sets_of(large.select("node").distinct(), "large")
        anew = large.select("tile", "node", "component").join(sets.hint("merge"), "node").select("tile", "node", "component", "grams")
        anew = store.put(anew.mapInArrow(common.lean(_dealt_anew(threshold)), "tile long, node long, component long").distinct(), "anew")
        members = members.where(F.col("n") <= split_above).unionByName(anew.join(store.put(_several(anew), "split"), "tile"))
    # parts of others are 0 .. outer - 1; those of the largest component are -1, -2 ..
    count = members.groupBy("tile", "component").agg(F.count("*").alias("m"))
    largest = count.groupBy("tile").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    parts = largest.where(F.col("all") > block).select("tile", F.col("top.component").alias("top"), F.ceil(F.col("top.m") / F.lit(block)).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("top.m")) / F.lit(block)).cast("int").alias("outer"))
    small = members.where(F.col("n") <= block).select("tile", "node", "component", F.lit(0).alias("i"), F.lit(0).alias("j"))
    dealt = members.where(F.col("n") > block).join(store.put(parts, "parts"), "tile").withColumn("inside", F.col("component") == F.col("top"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    outer, inner = F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(F.lit(-1), -F.col("inner"))
    cells = dealt.select("tile", "node", "component", F.when(F.col("inside"), -1 - F.col("part")).otherwise(F.col("part")).alias("part"), F.explode(F.when(F.col("inside"), outer).otherwise(F.concat(inner, outer))).alias("other"))
    cells = small.unionByName(cells.select("tile", "node", "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))

    def by_cell(rows, sides, *columns):
        rows = rows.join(sides.select("node", *columns).hint("merge"), "node")
        return rows.repartition(common.partitions(store.spark), "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "n", "node")

    keys = ["tile", "i", "j", "node", "component", "n"]
    possible = store.put(by_cell(cells, bitmaps, "n", "bits").select(*keys, "bits").mapInArrow(common.lean(_possible(threshold)), "tile long, i int, j int, node long, component long"), "possible")
    sets = sets_of(possible.select("node").distinct(), "sets")
    store.sweep()
    rows = possible.join(bitmaps.select("node", "n"), "node")
    return store.put(by_cell(rows, sets, "grams").select(*keys, "grams").mapInArrow(common.lean(_cell_links(threshold)), "a long, b long"), "more")
