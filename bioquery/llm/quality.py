"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words, hashed into WORDS buckets, and as a supplement
pairs of word shapes (capitals, digits, symbols, closing punctuation, length)
and marks of words that repeat one of the words just before.  Square roots of
relative frequencies, times inverse document frequencies, are projected on the
leading RANK singular vectors of the labelled sample (a truncated singular value
decomposition of the sparse matrix).  Every document's cosines with all labelled
vectors are computed exactly, in blocks; the ``neighbours`` nearest vote with
weights that grow with similarity, and isotonic regression turns the vote into a
probability.

The sample is at most ``sample`` labelled rows (4,000 unless set) with at most
TERMS terms each, the most frequent ones, so what goes to the driver is bounded;
what is broadcast are the singular vectors and sample x RANK floats.  Documents
that are scored are read whole, a long one in pieces.  Labels, language, source
and ids never enter a vector.  Edges: null and empty texts have the zero vector
and get the share of good labels; rows that repeat get the same score each;
without labels every score is 0; an empty table stays empty; columns with any
names are kept.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bioquery.llm import common, learning, words

WORDS, SHAPES, MARKS = 1 << 16, 704, 64  # buckets of words, of pairs of shapes and marks of repetition
DIMENSIONS = WORDS + SHAPES + MARKS
RANK = 48
TERMS = 4096  # of a labelled text
LEAD = 8  # words before one that it may repeat

_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_CLOSE = np.array([c in b".,;:" for c in range(256)])


def _terms(raw, offsets, skip=0):
    """(code, count): how often each term is in each text, code = row * DIMENSIONS + term; the first skip words only go before others."""
    starts, ends, row = words.word_bounds(raw, offsets)
    if len(starts) <= skip:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes, _ = words.word_hashes(raw, offsets)
    total = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask[raw], dtype=np.int32)]))
    size, upper, letter, digit = ends - starts, total(_UPPER), total(_LETTER), total(_DIGIT)
    close = _CLOSE[raw[ends - 1]]
    symbols = size - letter - digit - close
    shape = np.minimum(size, 15) // 4
    for part in (_UPPER[raw[starts]], (upper > 1) & (upper == letter), digit > 0, letter == 0, np.minimum(symbols, 3) > 0, symbols > 2, close):
        shape = shape * 2 + part
    same = np.zeros(len(row), dtype=np.int64)
    for back in range(LEAD, 0, -1):
        if len(row) > back:
            hit = (hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back])
            same[back:][hit] = back
    before = np.concatenate([[0], shape[:-1] + 1])
    before[np.append(True, row[1:] != row[:-1])] = 0
    pair = words.mix(before.astype(np.uint64) * np.uint64(4096) + shape.astype(np.uint64)) % np.uint64(SHAPES)
    row = row[skip:].astype(np.int64)
    code, count = np.unique(row * DIMENSIONS + (hashes[skip:] % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    few = SHAPES + MARKS
    dense = np.bincount(np.concatenate([row * few + pair[skip:].astype(np.int64), row * few + SHAPES + same[skip:] * 7]))
    some = np.flatnonzero(dense)
    code, count = np.concatenate([code, some // few * DIMENSIONS + WORDS + some % few]), np.concatenate([count, dense[some]])
    order = np.argsort(code, kind="stable")
    return code[order], count[order]


def _counted(column):
    """(texts, codes, counts) of runs of texts; a very long text is counted in pieces."""
    for _, raw, offsets in words.chunks(column):
        if len(offsets) > 2 or len(raw) <= 2 * words.CHUNK_BYTES:
            yield len(offsets) - 1, *_terms(raw, offsets)
            continue
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for start, end, lead in words.pieces(raw, LEAD):
            more, n = _terms(raw[start:end], np.array([0, end - start]), lead)
            codes, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        yield 1, codes, counts


class Sparse:
    """Rows of terms: square roots of relative frequencies."""

    def __init__(self, n, codes, counts):
        self.n, self.row, self.term = n, codes // DIMENSIONS, codes % DIMENSIONS
        self.value = np.sqrt(counts / np.maximum(np.bincount(self.row, counts, n), 1)[self.row]).astype(np.float32)
        self.empty = np.bincount(self.row, minlength=n) == 0

    def times(self, weight, matrix):
        """The rows, with a weight for each term, times a dense matrix; 200,000 terms at once."""
        out = np.zeros((self.n, matrix.shape[1]), dtype=np.float32)
        for at in range(0, len(self.row), 200_000):
            part = slice(at, at + 200_000)
            row, product = self.row[part], matrix[self.term[part]] * (self.value[part] * weight[self.term[part]])[:, None]
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[row[head]] += np.add.reduceat(product, head, axis=0)
        return out

    def transposed_times(self, weight, matrix):
        out = np.zeros((DIMENSIONS, matrix.shape[1]), dtype=np.float32)
        order = np.argsort(self.term, kind="stable")
        for at in range(0, len(order), 200_000):
            part = order[at : at + 200_000]
            term, product = self.term[part], matrix[self.row[part]] * (self.value[part] * weight[self.term[part]])[:, None]
            head = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            out[term[head]] += np.add.reduceat(product, head, axis=0)
        return out


def _singular_vectors(x, weight, rank, rounds=3):
    """The leading right singular vectors of sparse rows, by subspace iteration from a fixed start."""
    rank = min(rank, x.n, DIMENSIONS)
    q = x.transposed_times(weight, np.random.default_rng(1).normal(size=(x.n, min(x.n, rank + 12))).astype(np.float32))
    for _ in range(rounds):
        q, _ = np.linalg.qr(q)
        q = x.transposed_times(weight, x.times(weight, q.astype(np.float32)))
    q, _ = np.linalg.qr(q)
    _, _, turn = np.linalg.svd(x.times(weight, q.astype(np.float32)).astype(np.float64), full_matrices=False)
    return (q @ turn.T[:, :rank]).astype(np.float32)


class Model:
    """shapes=False leaves the supplement out, for comparison."""

    def __init__(self, x: Sparse, y, neighbours, sharpness, shapes=True):
        self.neighbours, self.sharpness = neighbours, sharpness
        self.share = float(y.mean()) if len(y) else 0.0
        self.empty = len(y) == 0
        if self.empty:
            return
        self.idf = (np.log((x.n + 1) / (np.bincount(x.term, minlength=DIMENSIONS) + 1)) + 1).astype(np.float32)
        if not shapes:
            self.idf[WORDS:] = 0
        self.basis = _singular_vectors(x, self.idf, RANK)
        self.known, self.label = self.project(x), y.astype(np.float32)
        self.calibration = learning.Isotonic(self.vote(self.known, leave_out=True), y)

    def project(self, x: Sparse):
        v = x.times(self.idf, self.basis)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, v, leave_out=False):
        """Weighted share of good labels among the nearest; cosines with all labelled vectors in blocks of rows."""
        out = np.full(len(v), self.share)
        k = min(self.neighbours, len(self.label) - leave_out)
        if k < 1:
            return out
        for at in range(0, len(v), 512):
            part = v[at : at + 512]
            cosine = part @ self.known.T
            if leave_out:
                cosine[np.arange(len(part)), at + np.arange(len(part))] = -2
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            value = np.take_along_axis(cosine, near, axis=1)
            weight = np.exp(self.sharpness * (value - 1))
            out[at : at + 512] = (weight * self.label[near]).sum(axis=1) / weight.sum(axis=1)
        out[np.abs(v).sum(axis=1) == 0] = self.share
        return out

    def score(self, column):
        if self.empty:
            return np.zeros(len(column))
        out = []
        for n, codes, counts in _counted(column):
            x = Sparse(n, codes, counts)
            p = np.clip(self.calibration(self.vote(self.project(x))), 0, 1)
            p[x.empty] = self.share
            out.append(p)
        return np.concatenate(out) if out else np.zeros(0)


def labelled_rows(docs: DataFrame, labels: DataFrame, train_rows, sample=4000):
    """(Sparse, labels) of at most sample labelled rows, in the order of a hash of their ids."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for n, codes, counts in _counted(batch.column(0)):
                terms = []
                for k in range(n):
                    low, high = np.searchsorted(codes, [k * DIMENSIONS, (k + 1) * DIMENSIONS])
                    code, count = codes[low:high] % DIMENSIONS, counts[low:high]
                    if len(code) > TERMS:
                        most = np.sort(np.lexsort((code, -count))[:TERMS])
                        code, count = code[most], count[most]
                    terms.append((code.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes()))
                columns = [pa.array(list(c), type=pa.binary()) for c in zip(*terms, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(1).slice(at, n), batch.column(2).slice(at, n)], names=["term", "n", "label", "h"])
                at += n

    rows = learning.labelled_sample(docs, labels, "quality", train_rows, sample).select("text", "label", F.xxhash64("doc_id").alias("h")).mapInArrow(common.lean(counted), "term binary, n binary, label int, h long").orderBy("h", "label", "term").collect()
    code = [np.frombuffer(r["term"], dtype=np.uint32).astype(np.int64) + k * DIMENSIONS for k, r in enumerate(rows)]
    count = [np.frombuffer(r["n"], dtype=np.uint32).astype(np.int64) for r in rows]
    none = [np.zeros(0, dtype=np.int64)]
    return Sparse(len(rows), np.concatenate(code or none), np.concatenate(count or none)), np.array([r["label"] for r in rows], dtype=np.float32)


def train(docs: DataFrame, labels: DataFrame, train_rows, sample=4000, neighbours=15, sharpness=12.0, shapes=True) -> Model:
    """Fits the vectors of at most sample labelled rows."""
    x, y = labelled_rows(docs, labels, train_rows, sample)
    return Model(x, y, neighbours, sharpness, shapes)


def score(docs: DataFrame, model: Model, cut=0.5, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (score >= cut)."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = model.score(batch.column(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(common.lean(run), f"doc_id {id_type}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, cut=0.5, text_column="text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least cut."""
    at = docs.columns.index(text_column)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at)) >= cut))

    return docs.mapInArrow(common.lean(run), docs.schema)
