"""Near-duplicate vectors: a navigable small-world graph per shard, verified cosines, components.

1. Equal vectors form a class; the smallest id stands for it, so thousands of
   copies cost as much as one.
2. Classes are dealt to shards of bounded size by a hash.  Each shard builds a
   hierarchy of small-world graphs, from a few entry points down to all vectors.
3. Every vector queries every shard, in blocks.  A query whose beam holds nothing
   but vectors above the threshold is dense: it is widened to the whole shard,
   an exact scan that counts its links and gives out only the edges that join
   what is still apart there.  Others give out their pairs, a beam's at most, so
   the rows of a dense group grow with its members, not with their pairs.
4. Audits widen the beams: every task searches its shard for PROBES of the
   shard's own vectors, turned to just above the threshold, and every block for
   AUDIT of its queries; below ``recall`` of what brute force finds (a query's
   own vector left out) the beam doubles for all that follows.  ``link`` can
   return what the audits found.
5. Candidates are verified by cosine in double precision; links of classes are
   unioned into components.

A shard has SHARD_ROWS vectors at most, and the method asks every shard: work is
in proportion to vectors times shards, which grow with the vectors above
SHARDS x SHARD_ROWS.

Edges: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths never link, and a length with at
most FEW classes is compared exactly, all such lengths in one pass; rows that repeat an
id count as vectors of their own; rows without an id link with nothing and count
for nobody.  A cosine of exactly the threshold is a link.  Extra columns are not
looked at.
"""

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bioquery.llm import common

SHARDS, LEAST_ROWS, SHARD_ROWS, QUERY_SPLITS, BLOCK = 3, 4000, 100_000, 4, 1024
DEGREE, BUILD_BEAM, LAYER_RATIO = 12, 40, 24
PROBES, AUDIT = 64, 16  # vectors of the shard that a task looks for, and queries of each block that it audits
FEW = 256  # classes of one length that need no graph


class Layer:
    """One graph: adjacency of ids into shared vectors; -1 pads."""

    def __init__(self, vectors, degree):
        self.x = vectors
        self.near = np.full((len(vectors), degree), -1, dtype=np.int32)
        self.degree = degree
        self.size = 0

    def search(self, q, entry, beam, expand=4):
        """(ids, cosines) of the best found for each query, best first; -1 pads."""
        n = len(q)
        beam = min(beam, self.size)
        ids = np.full((n, beam), -1, dtype=np.int32)
        sims = np.full((n, beam), -np.inf, dtype=np.float32)
        done = np.ones((n, beam), dtype=bool)
        seen = np.zeros((n, self.size + 1), dtype=bool)  # the last column stands for -1
        seen[:, -1] = True
        entry = entry[:, :beam]
        every = np.arange(n)
        for k in range(entry.shape[1]):
            fresh = ~seen[every, entry[:, k]]
            seen[every, entry[:, k]] = True
            ids[fresh, k] = entry[fresh, k]
            done[fresh, k] = False
        sims[ids >= 0] = np.einsum("ij,ij->i", self.x[ids[ids >= 0]], q[np.nonzero(ids >= 0)[0]])
        active = every
        while len(active):
            value = np.where(done[active], -np.inf, sims[active])
            width = min(expand, beam)
            pick = np.argpartition(value, -width, axis=1)[:, -width:] if width < beam else np.broadcast_to(np.arange(beam), value.shape)
            open_ = np.take_along_axis(value, pick, axis=1) > -np.inf
            going = open_.any(axis=1)
            active, pick, open_ = active[going], pick[going], open_[going]
            if not len(active):
                break
            rows = active[:, None]
            done[rows, pick] = True
            new = np.where(open_[:, :, None], self.near[np.maximum(ids[rows, pick], 0)], -1).reshape(len(active), -1)
            for k in range(width):  # one list at a time, so that lists that share ids give each once
                part = new[:, k * self.degree : (k + 1) * self.degree]
                old = seen[rows, part]
                seen[rows, part] = True
                part[old] = -1
            got = np.where(new >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(new, 0)], q[active], optimize=False), -np.inf).astype(np.float32)
            all_ids, all_sims = np.concatenate([ids[active], new], axis=1), np.concatenate([sims[active], got], axis=1)
            all_done = np.concatenate([done[active], got == -np.inf], axis=1)
            best = np.argpartition(all_sims, -beam, axis=1)[:, -beam:]
            ids[active], sims[active], done[active] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _select(self, ids, sims):
        """Up to degree diverse neighbours of rows of candidates (best first): a candidate that is nearer to a chosen one waits."""
        n, width = ids.shape
        x = self.x[np.maximum(ids, 0)]
        gram = np.matmul(x, x.transpose(0, 2, 1))
        chosen = np.zeros((n, width), dtype=bool)
        count = np.zeros(n, dtype=int)
        for c in range(width):
            blocked = (chosen & (gram[:, c] > sims[:, c : c + 1])).any(axis=1)
            take = (ids[:, c] >= 0) & ~blocked & (count < self.degree)
            chosen[:, c] = take
            count += take
        rank = np.where(chosen, 0, 1) * width * 2 + np.arange(width) + np.where(ids >= 0, 0, 4 * width)
        order = np.argsort(rank, axis=1, kind="stable")[:, : self.degree]
        out = np.take_along_axis(ids, order, axis=1)
        if out.shape[1] < self.degree:
            out = np.concatenate([out, np.full((n, self.degree - out.shape[1]), -1, dtype=out.dtype)], axis=1)
        return out

    def insert(self, start, end, entry):
        """Adds the vectors start..end; entry: ids to begin each search at."""
        q = self.x[start:end]
        own = np.arange(start, end, dtype=np.int32)
        sims = q @ q.T
        np.fill_diagonal(sims, -np.inf)
        width = min(2 * self.degree, len(q) - 1)
        parts = []
        if width > 0:
            near = np.argpartition(sims, -width, axis=1)[:, -width:]
            parts.append((own[near], np.take_along_axis(sims, near, axis=1)))
        if self.size:
            parts.append(self.search(q, entry, BUILD_BEAM))
        if not parts:
            self.size = end
            return
        ids, value = (np.concatenate(p, axis=1) for p in zip(*parts, strict=True))
        order = np.argsort(-value, axis=1, kind="stable")
        ids, value = np.take_along_axis(ids, order, axis=1), np.take_along_axis(value, order, axis=1)
        self.size = end
        self.near[start:end] = self._select(ids, value)
        target, source = self.near[start:end].ravel(), np.repeat(own, self.degree)
        target, source = target[target >= 0], source[target >= 0]
        sim = np.einsum("ij,ij->i", self.x[target], self.x[source])
        order = np.lexsort((-sim, target))
        target, source = target[order], source[order]
        head = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        place = np.arange(len(target)) - np.repeat(head, np.diff(np.append(head, len(target))))
        keep = place < 2 * self.degree
        nodes = target[head]
        extra = np.full((len(nodes), int(place[keep].max()) + 1), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(nodes)), np.diff(np.append(head, len(target))))[keep], place[keep]] = source[keep]
        for at in range(0, len(nodes), 512):
            node = nodes[at : at + 512]
            both = np.concatenate([self.near[node], extra[at : at + 512]], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            value = np.where(both >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(both, 0)], self.x[node], optimize=False), -np.inf)
            order = np.argsort(-value, axis=1, kind="stable")
            self.near[node] = self._select(np.take_along_axis(both, order, axis=1), np.take_along_axis(value, order, axis=1))


class Graph:
    """Layers over the same order of vectors: a layer above holds the first part of the one below."""

    def __init__(self, vectors):
        self.x = vectors
        sizes = [len(vectors)]
        while sizes[-1] > 4 * LAYER_RATIO:
            sizes.append(sizes[-1] // LAYER_RATIO)
        self.layers = []
        for size in reversed(sizes):
            layer = Layer(vectors[:size], 2 * DEGREE if size == len(vectors) else DEGREE)
            self.layers.append(layer)
            start = 0
            while start < size:
                end = min(size, start + min(512, max(64, start)))
                layer.insert(start, end, self._entry(vectors[start:end], self.layers[:-1], start))
                start = end

    @staticmethod
    def _entry(q, layers, limit):
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for layer in layers:
            entry = layer.search(q, entry, 4, expand=1)[0]
        # entries that the layer below does not have yet give way to its first vector
        return np.where((entry >= 0) & (entry < max(1, limit)), entry, 0)

    def search(self, q, beam):
        return self.layers[-1].search(q, self._entry(q, self.layers[:-1], len(self.x)), beam)

    def links(self, q, threshold, beam):
        """(query, id) of all found with at least threshold, and the dense queries, whose beam holds nothing below it."""
        ids, sims = self.search(q, beam)
        hit = (sims >= threshold) & (ids >= 0)
        dense = hit.all(axis=1) & (hit.shape[1] < len(self.x))
        at, k = np.nonzero(hit & ~dense[:, None])
        return at, ids[at, k], np.flatnonzero(dense)

    def recall(self, q, own, threshold, beam):
        """(links that brute force finds, how many of them the search does); own: the place of each query here, -1 if it has none."""
        truth = q @ self.x.T >= threshold
        truth[np.flatnonzero(own >= 0), own[own >= 0]] = False
        at, ids, dense = self.links(q, threshold, beam)
        found = np.zeros_like(truth)
        found[at, ids] = True
        found[dense] = True  # they are scanned whole
        return int(truth.sum()), int((truth & found).sum())


def _probes(x, threshold, seed):
    """Unit vectors whose cosine with one of x each is just above the threshold, and the places of these."""
    r = np.random.default_rng(seed)
    at = r.choice(len(x), min(PROBES, len(x)), replace=False)
    near = x[at].astype(np.float64)
    aside = r.normal(size=near.shape)
    aside -= (aside * near).sum(axis=1, keepdims=True) * near
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = min(1.0, threshold + 1e-3)
    return _unit(cosine * near + np.sqrt(1 - cosine**2) * np.divide(aside, size, out=np.zeros_like(aside), where=size > 1e-9)), at


class Scan:
    """Exact links of dense queries with a shard: counts, and edges that join what is still apart."""

    def __init__(self, graph, vectors, ids, copies):
        self.graph, self.x, self.ids, self.copies = graph, vectors, ids, copies
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.label = np.arange(len(ids))
        self.other = {}  # labels of queries that aren't in the shard

    def __call__(self, q, vectors, asked, threshold):
        """(links of each query, edges (query, id)); single precision decides but within 1e-4 of the threshold."""
        counts, edges = [], []
        step = max(1, (8 << 20) // max(1, len(self.ids)))
        for start in range(0, len(q), step):
            sims = q[start : start + step] @ self.graph.x.T
            for k, row in enumerate(sims):
                name, v = asked[start + k], vectors[start + k]
                hit = row >= threshold
                close = np.flatnonzero(np.abs(row - threshold) < 1e-4)
                if len(close):
                    hit[close] = self.x[close] @ v / (self.norm[close] * np.sqrt(v @ v)) >= threshold
                at = np.flatnonzero(hit)
                at = at[self.ids[at] != name]
                counts.append(int(self.copies[at].sum()))
                labels, first = np.unique(self.label[at], return_index=True)
                mine = self.other.get(name)
                for one, place in zip(labels.tolist(), at[first].tolist(), strict=True):
                    if one != mine:
                        edges.append((name, self.ids[place]))
                if not len(labels):
                    continue
                joined = set(labels.tolist()) | ({mine} if mine is not None else set())
                low = min(joined)
                if len(joined) > 1:
                    self.label[np.isin(self.label, list(joined))] = low
                    self.other = {n: low if at_ in joined else at_ for n, at_ in self.other.items()}
                self.other[name] = low
        return counts, edges


def _unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _pack(**arrays):
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(key, pdf):
    import pandas as pd

    x = np.array(pdf["v"].tolist(), dtype=np.float64)
    order = np.argsort(pdf["h"].to_numpy(), kind="stable")
    x, ids = x[order], pdf["node"].to_numpy()[order]
    graph = Graph(_unit(x))
    blob = _pack(x=x, ids=ids, copies=pdf["copies"].to_numpy()[order], sizes=np.array([layer.size for layer in graph.layers]), **{f"near{i}": layer.near for i, layer in enumerate(graph.layers)})
    return pd.DataFrame({"shard": [key[0]], "blob": [blob]})


def _load(blob):
    data = np.load(io.BytesIO(blob))
    graph = object.__new__(Graph)
    graph.x = _unit(data["x"])
    graph.layers = []
    for i, size in enumerate(data["sizes"].tolist()):
        layer = object.__new__(Layer)
        layer.x, layer.near, layer.size = graph.x[:size], data[f"near{i}"], size
        layer.degree = layer.near.shape[1]
        graph.layers.append(layer)
    return graph, data["x"], data["ids"], data["copies"]


_FOUND = "kind int, a long, b long, at_a int, at_b int, n long, beam int"
PAIR, EDGE, COUNT, PROBED, AUDITED = range(5)  # kinds of rows that a search gives out


def link(vectors: DataFrame, threshold=0.95, beam=24, recall=0.99, id_column="vec_id", vector_column="embedding", report=False):
    """One row per vector: vec_id, n_links, component_id, kept.

    With report, also a table of what audits found: kind, links that brute force
    finds, how many of them the search found at the beam that was kept, and beam.
    """
    spark = vectors.sparkSession
    store = common.Store(spark)
    v = F.col("v")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).withColumn("same", F.when(usable, F.md5(F.concat_ws(",", F.transform(v, lambda x: x.cast("string"))))))
    rows = store.put(rows, "rows")
    classes = rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    classes = store.put(classes.withColumn("h", F.xxhash64("same")).withColumn("d", F.size("v")), "classes")
    lengths = classes.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()
    found = [store.put(_links(classes.where(F.col("d") == d), n, store, threshold, beam, recall), "links") for d, n in lengths if n > FEW]
    if few := [d for d, n in lengths if n <= FEW]:
        none = F.lit(-1)
        found.append(store.put(_exact(classes.where(F.col("d").isin(few)), threshold).select(F.lit(PAIR).alias("kind"), "a", "b", none.alias("at_a"), none.alias("at_b"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("beam")), "links"))
    if not found:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
        return (out, spark.createDataFrame([], "kind string, true_links long, found_links long, beam int")) if report else out
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    pairs = every.where(F.col("kind") == PAIR).select("a", "b", "at_a", "at_b").distinct()
    dense = every.where(F.col("kind") == COUNT).select(F.col("a").alias("node"), F.col("at_b").alias("at"), "n")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.col("at_b").alias("at")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), F.col("at_a").alias("at")))).alias("p")).select("p.*")
    # a dense query has counted its links with that shard
    alone = both.join(dense.select("node", "at"), ["node", "at"], "left_anti")
    counted = alone.join(classes.select(F.col("node").alias("other"), "copies"), "other").select("node", F.col("copies").alias("n")).unionByName(dense.select("node", "n"))
    others = counted.groupBy("node").agg(F.sum("n").alias("others"))
    labels = common.components(spark, every.where(F.col("kind") <= EDGE).select("a", "b"), store)
    of_class = classes.select("same", "node", "copies").join(others, "node", "left").join(labels, "node", "left")
    of_class = store.put(of_class.select("same", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component")), "result")
    out = rows.select("vec_id", "same").join(of_class, "same", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    if not report:
        return out
    audits = every.where(F.col("kind") >= PROBED)
    return out, audits.select(F.when(F.col("kind") == PROBED, "probes").otherwise("queries").alias("kind"), F.col("a").alias("true_links"), F.col("b").alias("found_links"), "beam")


def _exact(classes, threshold):
    """The same pairs for lengths with few vectors each, by all cosines of a length."""

    def pairs(pdf):
        import pandas as pd

        ids, x = pdf["node"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        one, two = ids[i], ids[j]
        keep = one != two
        return pd.DataFrame({"a": np.minimum(one, two)[keep], "b": np.maximum(one, two)[keep]})

    return classes.select("d", "node", "v").groupBy("d").applyInPandas(pairs, "a long, b long").distinct()


def _links(classes, n, store, threshold, beam, recall):
    """Rows of _FOUND for the n classes of one vector length."""
    shards = max(min(SHARDS, -(-n // LEAST_ROWS)), -(-n // SHARD_ROWS))
    splits = QUERY_SPLITS if n > 1000 else 1
    dealt = store.put(classes.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), "dealt")
    graphs = store.put(dealt.select("shard", "node", "copies", "h", "v").groupBy("shard").applyInPandas(_build, "shard int, blob binary"), "graphs")

    def blocks(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.array(part.column(1).to_pylist(), dtype=np.float64)
                blob = _pack(x=x, ids=part.column(0).to_numpy(zero_copy_only=False), shard=part.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([blob], type=pa.binary()), pa.array([int(part.column(0)[0].as_py())])], names=["blob", "first"])

    queries = store.put(dealt.select("node", "v", "shard").mapInArrow(blocks, "blob binary, first long"), "queries")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("first"), F.lit(splits)).cast("int").alias("part"), F.lit(1).alias("turn"), "blob")
    held = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), F.lit(0).alias("turn"), "blob")
    near = threshold - 1e-4  # single precision may fall short of it

    def widened(graph, q, own, wide):
        """(beam at which enough is found, true links, found ones)."""
        true, got = graph.recall(q, own, near, wide)
        while got < recall * true and wide < len(graph.x):
            wide *= 2
            true, got = graph.recall(q, own, near, wide)
        return wide, true, got

    def search(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in _FOUND.split(", ")]

        def batch_of(*columns):
            size = max(len(c) for c in columns if not np.isscalar(c))
            full = [np.full(size, c) if np.isscalar(c) else np.asarray(c) for c in columns]
            kinds = (np.int32, np.int64, np.int64, np.int32, np.int32, np.int64, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(full, kinds, strict=True)], names=names)

        graph = None
        for batch in batches:
            for turn, shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if turn == 0:
                    graph, x, ids, copies = _load(blob.as_py())
                    scan, place = Scan(graph, x, ids, copies), {i: k for k, i in enumerate(ids.tolist())}
                    probes, _ = _probes(graph.x, threshold, shard)
                    wide, true, got = widened(graph, probes, np.full(len(probes), -1), beam)
                    yield batch_of(PROBED, [true], [got], shard, shard, 0, wide)
                    continue
                data = np.load(io.BytesIO(blob.as_py()))
                q, asked, home = _unit(data["x"]), data["ids"], data["shard"]
                some = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)
                wide, true, got = widened(graph, q[some], np.array([place.get(i, -1) for i in asked[some].tolist()]), wide)
                yield batch_of(AUDITED, [true], [got], shard, shard, 0, wide)
                for at in range(0, len(q), 256):
                    part = slice(at, at + 256)
                    i, j, dense = graph.links(q[part], near, wide)
                    left, right = data["x"][part][i], x[j]
                    cosine = np.einsum("ij,ij->i", left, right) / (np.sqrt(np.einsum("ij,ij->i", left, left)) * np.sqrt(np.einsum("ij,ij->i", right, right)))
                    keep = (cosine >= threshold) & (asked[part][i] != ids[j])
                    one, two, from_ = asked[part][i][keep], ids[j][keep], home[part][i][keep]
                    if len(one):
                        first = one < two
                        yield batch_of(PAIR, np.minimum(one, two), np.maximum(one, two), np.where(first, from_, shard), np.where(first, shard, from_), 0, 0)
                    if len(dense):
                        names_ = asked[part][dense]
                        counts, edges = scan(q[part][dense], data["x"][part][dense], names_.tolist(), threshold)
                        yield batch_of(COUNT, names_, 0, shard, shard, counts, 0)
                        if edges:
                            yield batch_of(EDGE, [e[0] for e in edges], [e[1] for e in edges], shard, shard, 0, 0)

    placed = held.unionByName(asks).repartitionById(shards * splits, F.col("shard") * splits + F.col("part")).sortWithinPartitions("turn")
    return placed.select("turn", "shard", "blob").mapInArrow(search, _FOUND)
