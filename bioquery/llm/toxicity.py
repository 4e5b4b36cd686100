"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (whole words, and word beginnings
that only toxic training texts have), their strongest weights, closeness of
lexicon words to second-person pronouns, capitals, punctuation, and obfuscated
spellings (symbols or digits inside words, and lexicon words that appear once
look-alike characters are undone).  The lexicons are learnt from one part of the
labelled sample, the trees and the calibration from the others, so that the
trees see the lexicon as it works on new texts.

The sample is at most ``sample`` labelled rows (20,000 unless set).  Labels,
language, source and ids are never features.  Edges: null and empty texts get
the score of a text with all features 0; without labels every score is 0.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bioquery.llm import learning, words

#: Second-person pronouns of a few languages: fixed values.
SECOND_PERSON = "you your yours yourself u du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus su sus vosotros os"
PREFIXES = (4, 5, 6, 7)  # bytes of the word beginnings in the lexicon
LEXICON_PARTS = (0, 1)
FEATURES = 18

_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_CAPITAL = np.array([65 <= c <= 90 for c in range(256)])
_CORE = np.array([_LETTER[c] or 48 <= c <= 57 for c in range(256)])
_SYMBOL = np.array([33 <= c <= 126 and not _LETTER[c] and c not in b"'-.,|" for c in range(256)])
_PUNCTUATION = np.array([33 <= c <= 126 and not _CORE[c] for c in range(256)])
_UNDO = np.arange(256, dtype=np.uint8)
_UNDO[np.frombuffer(b"@$0134578", dtype=np.uint8)] = np.frombuffer(b"asoieastb", dtype=np.uint8)


def _runs(mask, offsets):
    """Starts and ends of the runs of True that don't cross texts, and their rows."""
    opens = mask.copy()
    opens[1:] &= ~mask[:-1]
    closes = mask.copy()
    closes[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    opens[inner] = mask[inner]
    closes[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _hasher(data):
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(words._BYTE_VALUE[data] * words.powers(words._BASE, len(data)), out=total[1:])
    inverse = words.powers(words._INVERSE, max(1, len(data)))
    return lambda s, e, salt: words.mix((total[e] - total[s]) * inverse[s] ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(salt))


def terms(data, offsets):
    """(hash, row, end) of the words and of their beginnings; beginnings end where the word ends."""
    starts, ends, row = _runs(_CORE[data], offsets)
    get = _hasher(data)
    out = [(get(starts, ends, 0), row, np.arange(len(row)))]
    for size in PREFIXES:
        at = np.flatnonzero(ends - starts > size)
        out.append((get(starts[at], starts[at] + size, size), row[at], at))
    return starts, ends, row, out


def pronoun_hashes():
    data = np.frombuffer(SECOND_PERSON.encode(), dtype=np.uint8)
    starts, ends, _ = _runs(_CORE[data], np.array([0, len(data)]))
    return np.sort(_hasher(data)(starts, ends, 0))


class Lexicon:
    """Sorted term hashes with log-odds weights."""

    def __init__(self, hashes, weights):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]

    def look(self, hashes):
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weights[at], 0.0)


def features(raw, offsets, lexicon: Lexicon, pronouns):
    """A row of FEATURES numbers for every text of a chunk."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(raw):
        return out
    data = words.lower(raw)
    size = np.maximum(np.diff(offsets), 1)
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    starts, ends, row, found = terms(data, offsets)
    count = np.maximum(np.bincount(row, minlength=n), 1)
    word_weight = lexicon.look(found[0][0])
    start_weight = np.zeros(len(row))
    for hashes, _, at in found[1:]:
        np.maximum.at(start_weight, at, lexicon.look(hashes))
    weight = np.maximum(word_weight, start_weight)
    for k, w in ((0, word_weight), (4, start_weight)):
        hit = w > 0
        hits = np.bincount(row, hit, n)
        out[:, k] = hits
        out[:, k + 1] = hits / count
        out[:, k + 2] = np.bincount(row, w, n) / count
        np.maximum.at(out[:, k + 3], row, w)
    at = np.flatnonzero(weight > 0)
    you = np.flatnonzero(np.isin(found[0][0], pronouns))
    if len(at) and len(you):
        after = np.minimum(np.searchsorted(you, at), len(you) - 1)
        before = np.maximum(after - 1, 0)
        gap = np.minimum(*[np.where(row[you[k]] == row[at], np.abs(you[k] - at), 99) for k in (after, before)])
        out[:, 8] = np.bincount(row[at], gap <= 5, n)
        np.maximum.at(out[:, 9], row[at], 1 / (1.0 + gap))
    letters = np.maximum(per_row(_LETTER[data]), 1)
    out[:, 10] = per_row(_CAPITAL[raw]) / letters
    out[:, 11] = per_row(_PUNCTUATION[raw]) / size
    out[:, 12] = per_row((raw == 33) | (raw == 63)) / size
    s, e, r = words.word_bounds(raw, offsets)
    if len(s):
        symbol = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
        letter = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        capital = np.concatenate([[0], np.cumsum(_CAPITAL[raw])])
        mixed = _LETTER[raw[s]] & _LETTER[raw[e - 1]] & (symbol[e] > symbol[s])
        out[:, 13] = np.bincount(r, mixed, n) / count
        out[:, 14] = np.bincount(r, (capital[e] - capital[s] == letter[e] - letter[s]) & (letter[e] - letter[s] > 1), n) / count
    undone = _UNDO[data]
    if not np.array_equal(undone, data):
        _, _, undone_row, again = terms(undone, offsets)
        out[:, 15] = np.maximum(np.bincount(undone_row, lexicon.look(again[0][0]) > 0, n) - out[:, 0], 0)
    out[:, 16] = np.bincount(row, weight > 2.5, n)
    out[:, 17] = out[:, 16] / count
    return out


def _chunk_features(column, lexicon, pronouns):
    parts = [features(raw, offsets, lexicon, pronouns) for _, raw, offsets in words.chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _term_counts(batches):
    """(term, toxic texts, other texts) of a partition of (text, label)."""
    import pyarrow as pa

    kept = [np.zeros(0, dtype=np.uint64)] * 2
    tally = [np.zeros(0, dtype=np.int64)] * 2
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for first, raw, offsets in words.chunks(batch.column(0)):
            _, _, _, found = terms(words.lower(raw), offsets)
            hashes, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            once = np.ones(len(hashes), dtype=bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            hashes, toxic = hashes[once], label[first + row[once]] == 1
            for k in (0, 1):
                part = hashes[toxic == bool(k)]
                both = np.concatenate([kept[k], part])
                n = np.concatenate([tally[k], np.ones(len(part), dtype=np.int64)])
                by = np.argsort(both, kind="stable")
                both, n = both[by], n[by]
                head = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, dtype=int)
                kept[k], tally[k] = both[head], np.add.reduceat(n, head) if len(head) else n
    for k in (0, 1):
        for at in range(0, len(kept[k]), 100_000):
            part, n = kept[k][at : at + 100_000].view(np.int64), tally[k][at : at + 100_000]
            zero = np.zeros(len(n), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n if k else zero), pa.array(zero if k else n)], names=["term", "toxic", "other"])


class Model:
    def __init__(self, lexicon, trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration
        self.pronouns = pronoun_hashes()

    def score(self, column):
        x = _chunk_features(column, self.lexicon, self.pronouns)
        return np.clip(self.calibration(self.trees.raw(x)), 0, 1) if self.trees else np.zeros(len(x))


def train(docs: DataFrame, labels: DataFrame, train_rows, sample=20_000, lexicon_size=4000, lexicon_rows=3) -> Model:
    """Learns from at most sample labelled rows; lexicon_rows: toxic texts that a lexicon term is in at least."""
    from bioquery.llm.common import Store

    spark = docs.sparkSession
    store = Store(spark)
    rows = store.put(learning.labelled_sample(docs, labels, "toxic", train_rows, sample), "sample")
    known = {r["k"]: r["n"] for r in rows.groupBy(F.struct("label", F.col("part").isin(*LEXICON_PARTS).alias("lexicon")).alias("k")).agg(F.count("*").alias("n")).collect()}
    of = lambda label, part: sum(n for k, n in known.items() if k["label"] == label and k["lexicon"] == part)
    toxic, other = of(1, True), of(0, True)
    counts = rows.where(F.col("part").isin(*LEXICON_PARTS)).select("text", "label").mapInArrow(_term_counts, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0))
    best = counts.where(F.col("toxic") >= lexicon_rows).withColumn("odds", odds).where("odds > 1").orderBy(F.desc("odds"), F.desc("toxic"), "term").limit(lexicon_size).collect()
    lexicon = Lexicon(np.array([r["term"] for r in best], dtype=np.int64).view(np.uint64), np.array([r["odds"] for r in best], dtype=float))
    if not toxic or not other or not of(1, False) or not of(0, False):
        return Model(lexicon, None, learning.Isotonic([], []))
    pronouns = pronoun_hashes()

    def dense(batches):
        import pyarrow as pa

        for batch in batches:
            x = _chunk_features(batch.column(0), lexicon, pronouns)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.list_(pa.float64())), batch.column(1), batch.column(2), batch.column(3)], names=["x", "label", "part", "doc_id"])

    fitted = rows.where(~F.col("part").isin(*LEXICON_PARTS)).select("text", "label", "part", F.xxhash64("doc_id").alias("doc_id")).mapInArrow(dense, "x array<double>, label int, part int, doc_id long").orderBy("doc_id").collect()
    store.drop(rows)
    x, y = np.array([r["x"] for r in fitted]), np.array([r["label"] for r in fitted])
    part = np.array([r["part"] for r in fitted])
    raw = np.zeros(len(y))
    for k in np.unique(part):  # each part is scored by trees that have not seen it
        rest = part != k
        raw[~rest] = learning.Trees().fit(x[rest], y[rest]).raw(x[~rest]) if rest.any() else 0.0
    return Model(lexicon, learning.Trees().fit(x, y), learning.Isotonic(raw, y))


def score(docs: DataFrame, model: Model, cut=0.3, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (score >= cut)."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double, predicted int")
