"""Small exact learners that run on the driver over bounded, documented samples."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train, limit: int, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, text, label, part) of at most limit labelled training rows, the smallest by a hash of the id.

    A document labelled twice gets its largest label; null labels and ids are no
    labels.  part (0 to 4) splits the sample at random but always alike.
    """
    marks = labels.select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("label")).where("label in (0, 1) and __id is not null").where(train("__id")).groupBy("__id").agg(F.max("label").alias("label"))
    marks = marks.withColumn("__h", F.xxhash64(F.col("__id"), F.lit(7))).orderBy("__h", "__id").limit(limit)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # at most limit rows of two numbers: small by that parameter
    joined = texts.join(F.broadcast(marks), texts["doc_id"] == marks["__id"])
    return joined.select("doc_id", "text", "label", F.pmod("__h", F.lit(5)).cast("int").alias("part"))


class Isotonic:
    """Pool-adjacent-violators fit of label means that never fall as the input rises."""

    def __init__(self, x, y, smoothing=1.0):
        order = np.argsort(x, kind="stable")
        x, y = np.asarray(x, dtype=float)[order], np.asarray(y, dtype=float)[order]
        blocks = []  # [sum, weight, smallest x, largest x]
        ends = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1 if len(x) else []
        start = 0
        for end in ends:
            blocks.append([y[start:end].sum(), end - start, x[start], x[end - 1]])
            start = end
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                total, weight, _, high = blocks.pop()
                blocks[-1][0] += total
                blocks[-1][1] += weight
                blocks[-1][3] = high
        prior = y.mean() if len(y) else 0.0
        self.at, self.value = [], []
        for total, weight, low, high in blocks:
            value = (total + smoothing * prior) / (weight + smoothing)  # keeps small blocks off 0 and 1
            self.at += [low, high]
            self.value += [value, value]
        self.value = list(np.maximum.accumulate(self.value)) if self.value else []

    def __call__(self, x):
        if not self.at:
            return np.zeros(len(x))
        return np.interp(x, self.at, self.value)


class Trees:
    """Gradient-boosted regression trees on the logistic loss over binned dense features."""

    def __init__(self, rounds=60, depth=3, rate=0.15, bins=48, leaf=8, ridge=1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.ridge = rounds, depth, rate, bins, leaf, ridge

    def fit(self, x, y):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(column) else np.zeros(0) for column in x.T]
        binned = self._bin(x)
        mean = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        self.trees = []
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, value = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += value
        return self

    def _bin(self, x):
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if x.shape[1] else np.zeros((len(x), 0), dtype=int)

    def _grow(self, binned, gradient, hessian):
        """A tree as arrays over a full binary heap: feature (-1 at leaves), bin, leaf value."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)
        node = np.zeros(len(gradient), dtype=int)
        width = self.bins + 1
        for at in range(size):
            rows = np.flatnonzero(node == at)
            g, h = gradient[rows].sum(), hessian[rows].sum()
            value[at] = self.rate * g / (h + self.ridge)
            if at >= size // 2 or len(rows) < 2 * self.leaf:
                continue
            best = (1e-6, -1, 0)
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, gradient[rows], width))[:-1]
                hl = np.cumsum(np.bincount(b, hessian[rows], width))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=width))[:-1]
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(nl < self.leaf) | (len(rows) - nl < self.leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                feature[at], cut[at] = best[1], best[2]
                node[rows] = 2 * at + 1 + (binned[rows, best[1]] > best[2])
        return (feature, cut, value), value[node]

    def raw(self, x):
        x = np.asarray(x, dtype=float)
        binned = self._bin(x)
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (binned[every, np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return out


def accuracy_and_auc(score, label, cut):
    """(accuracy at a cut, area under the curve, ties counted half)."""
    score, label = np.asarray(score, dtype=float), np.asarray(label, dtype=int)
    values, rank, count = np.unique(score, return_inverse=True, return_counts=True)
    middle = (np.cumsum(count) - (count - 1) / 2)[rank]
    ones, zeros = (label == 1).sum(), (label == 0).sum()
    auc = (middle[label == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * zeros)
    return float(((score >= cut) == (label == 1)).mean()), float(auc)
