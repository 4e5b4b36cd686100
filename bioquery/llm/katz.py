"""Katz backoff scoring of documents with Good-Turing discounts, up to n-grams of ``order`` words.

Tokens are the words of a text (lower-cased A-Z) and one end; contexts that
reach before the text hold a start mark.  P(w | h) is the discounted relative
frequency of (h, w) if training texts have it; otherwise alpha(h) * P(w | h'),
where h' is h without its first word, and so on down to P(w), the discounted
relative frequency of w; what that leaves is the one share of all words that
training texts don't have.  Counts up to CUTOFF are discounted by Good-Turing,
larger ones give up EPSILON of one count, so every context has mass to back off
with; alpha(h) normalises exactly: the probabilities of all words and of the
unknown share sum to 1 after every context.

Counts are kept in tables that are partitioned by key, and never gathered whole:

1. Documents are packed into blocks of about BLOCK_BYTES of text, as indices
   into the block's own sorted vocabulary, and written once.
2. Each block asks for its distinct words, one request to each partition of the
   word table.  The partition sums the training counts of all blocks and answers
   each request with counts in the order asked.  A word that is in every text is
   one entry of each block.
3. The same for its distinct pairs, then triples and so on to ``order``,
   partitioned by their contexts; those of contexts with more than a partition's
   share of all tokens are dealt by context and word.  The answers hold counts,
   and what alpha needs of contexts that some unseen n-gram of the block backs
   off from.  Each round needs the probabilities of the one before, so a token's
   probability is built by recursion from the word up.
4. The last round scores the tokens.

A table has as many partitions as its keys need at KEYS_A_PART each, the
session's at least, so what a task holds doesn't grow with the corpus.

Contexts are told apart by 64-bit hashes, words that follow one by 56 bits.
Edges: null and empty texts are one end; null ids hash as empty text and are
returned null; rows that repeat are texts of their own, each counted and each
returned; without training texts the count tables are empty and every token has
probability 1 as unknown; an empty table stays empty.  A text is never cut, so a
very long one makes a block of its own size.  Extra columns are not looked at.
"""

import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bioquery.llm import common, words

CUTOFF, EPSILON = 5, 0.001
BLOCK_BYTES = 12 << 20
KEYS_A_PART = 2 << 20  # words or n-grams that one task answers for, about 160 MB with the arrays of sorting
BATCH_BYTES = 1 << 20  # of answers that go to Spark at once
ORDER = 2  # see the README for what a third word costs
START = np.uint64(0x5851F42D4C957F2D)


def _pack(**arrays):
    import zstandard

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _load(blob):
    import zstandard

    return np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob)))


def _tight(x):
    """The smallest unsigned type that holds x."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def _distinct(x):
    """(sorted distinct values, index of each value in them)."""
    order = np.argsort(x)
    ordered = x[order]
    head = np.append(True, ordered[1:] != ordered[:-1]) if len(x) else np.zeros(0, dtype=bool)
    distinct = ordered[head]
    del ordered
    rank = np.cumsum(head, dtype=np.int32 if len(x) < 2**31 else np.int64)
    rank -= 1
    inverse = np.empty_like(rank)
    inverse[order] = rank
    return distinct, inverse


def _top_bytes(x):
    """The upper 7 bytes of 64-bit values: they tell the followers of one word apart."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:])


def _from_top_bytes(x):
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, 1:] = x
    return out.view("<u8").ravel()


class Discounts:
    """Multipliers of counts: Good-Turing up to CUTOFF where its estimates are sound, else half a count off."""

    def __init__(self, of_count):
        n = [0, *of_count]  # n[r]: how many have count r, to CUTOFF + 1
        self.low = np.ones(CUTOFF + 1)
        tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
        for r in range(1, CUTOFF + 1):
            d = (((r + 1) * n[r + 1] / (r * n[r])) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
            self.low[r] = d if 0 < d < 1 else (r - 0.5) / r

    def mass(self, count):
        """Discounted counts."""
        count = np.asarray(count, dtype=np.int64)
        return np.where(count > CUTOFF, count - EPSILON, self.low[np.minimum(count, CUTOFF)] * count)

    def left(self, of_count, above):
        """What the discounts leave of of_count[r] entries with count r + 1 and of above larger ones."""
        return sum((1 - self.low[r]) * r * of_count[r - 1] for r in range(1, CUTOFF + 1)) + EPSILON * above


class Unigrams:
    def __init__(self, tokens, vocabulary, of_count, above):
        self.tokens, self.vocabulary = int(tokens), int(vocabulary)
        self.discounts = Discounts(of_count)
        self.unknown = self.discounts.left(of_count, above) / self.tokens if self.tokens else 1.0

    def probability(self, count):
        return np.where(count > 0, self.discounts.mass(count) / max(1, self.tokens), self.unknown)

    def base(self, count):
        return np.log10((count + 1) / (self.tokens + self.vocabulary + 1))


def _blocks(batches):
    """Packed blocks of (doc_id, held, text)."""
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 20
    held, size = [], 0

    def flush():
        ids, out, tokens, lengths = (np.concatenate([h[k] for h in held]) for k in range(4))
        vocabulary, index = _distinct(tokens)
        train = np.repeat(out == 0, lengths)
        counts = np.bincount(index[train], minlength=len(vocabulary))
        known = ids != np.iinfo(np.int64).min
        row = [number, _pack(ids=ids, known=known, held=out, lengths=_tight(lengths), index=_tight(index)), _pack(vocabulary=vocabulary, counts=_tight(counts)), len(vocabulary), len(index)]
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types, strict=True)], names=["block", "texts", "words", "n_words", "n_tokens"])

    for batch in batches:
        ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        out = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for first, raw, offsets in words.chunks(batch.column(2)):
            n = len(offsets) - 1
            hashes, row = words.word_hashes(raw, offsets)
            lengths = np.bincount(row, minlength=n) + 1
            tokens = np.full(lengths.sum(), words.END)
            tokens[np.arange(len(hashes)) + row] = hashes
            held.append((ids[first : first + n], out[first : first + n], tokens, lengths))
            size += len(raw) + 64 * n
            if size > BLOCK_BYTES:
                yield flush()
                held, size, number = [], 0, number + 1
    if held:
        yield flush()


def _slices(keys, parts):
    """Bounds of the parts' shares of sorted or binned 64-bit keys."""
    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _ask_words(parts):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _load(blob.as_py())
                keys, counts = data["vocabulary"], data["counts"]
                cut = np.searchsorted(_slices(keys, parts), np.arange(parts + 1))
                rows = [(p, block, _pack(keys=keys[a:b], counts=counts[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "ask"])

    return run


def _gathered(batches):
    """All rows of a partition."""
    parts, blocks, asks = [], [], []
    for batch in batches:
        parts += batch.column(0).to_pylist()
        blocks += batch.column(1).to_pylist()
        asks += [_load(b.as_py()) for b in batch.column(2)]
    return parts, blocks, asks


def _answers(rows):
    import pyarrow as pa

    held, size = [], 0
    for k, row in enumerate(rows, 1):
        held.append(row)
        size += len(row[2])
        if size > BATCH_BYTES or k == len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "answer"])
            held, size = [], 0


def _of_count(count):
    """(how many have count 1 .. CUTOFF + 1, how many more than CUTOFF)."""
    low = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)
    return low[1 : CUTOFF + 2], int(low[CUTOFF + 1] + low[CUTOFF + 2])


def _count_words(batches):
    parts, blocks, asks = _gathered(batches)
    if not parts:
        return
    keys, counts = np.concatenate([a["keys"] for a in asks]), np.concatenate([a["counts"].astype(np.int64) for a in asks])
    size = [len(a["keys"]) for a in asks]
    del asks
    distinct, index = _distinct(keys)
    total = np.bincount(index, counts, len(distinct)).astype(np.int64)
    of_count, above = _of_count(total)
    rows = [(-1, parts[0], _pack(stats=np.array([total.sum(), (total > 0).sum(), *of_count, above], dtype=np.int64)))]
    for part, block, answer in zip(parts, blocks, np.split(total[index], np.cumsum(size)[:-1]), strict=True):
        rows.append((block, part, _pack(counts=_tight(answer))))
    yield from _answers(rows)


class Level:
    """The distinct n-grams of a block: their place in the text, context, last word and the n-gram without the first word."""

    def __init__(self, place, hashes, count=None, probability=None, ctx=None, last=None, lower=None):
        self.place, self.hashes, self.count, self.probability = place, hashes, count, probability
        self.ctx, self.last, self.lower = ctx, last, lower


class Block:
    """A block with its n-grams up to those whose counts it knows, and the next ones."""

    def __init__(self, texts, own, unigrams, parts):
        data = _load(texts)
        self.ids, self.known, self.held = data["ids"], data["known"], data["held"]
        self.lengths, self.index = data["lengths"].astype(np.int64), data["index"].astype(np.int32)
        own = _load(own)
        self.own = {k: own[k] for k in own.files}
        self.vocabulary, self.unigrams, self.parts = own["vocabulary"], unigrams, parts
        self.starts = np.cumsum(self.lengths) - self.lengths
        count = own["counts"].astype(np.int64)
        end = np.searchsorted(self.vocabulary, words.END)
        self.texts = count[end] if len(count) else 0  # in training: how often a start is the context
        self.words = count
        self.before = None
        self.level = Level(self.index, np.append(self.vocabulary, START), np.append(count, self.texts), unigrams.probability(count))
        self.n = 1
        while f"counts{self.n + 1}" in own.files:
            self.up()
            self.level.count = np.append(own[f"counts{self.n}"].astype(np.int64), self.texts)
            self.level.probability = own[f"probability{self.n}"]
        self.up()

    def up(self):
        """Goes to the n-grams of one word more."""
        self.before, low = self.level, self.level
        self.n += 1
        size = len(self.vocabulary)
        previous = np.empty(len(self.index), dtype=np.int64)
        previous[1:] = low.place[:-1]
        previous[self.starts] = len(low.hashes) - 1  # the start mark
        previous *= size
        previous += self.index
        grams, place = _distinct(previous)
        del previous
        ctx, last = (grams // max(1, size)).astype(np.int32), (grams % max(1, size)).astype(np.int32)
        del grams
        place = place.astype(np.int32, copy=False)
        lower = np.empty(len(ctx), dtype=np.int32)
        lower[place] = low.place
        hashes = np.empty(len(ctx) + 1, dtype=np.uint64)
        hashes[:-1] = words.mix(low.hashes[ctx] ^ words.mix(self.vocabulary[last] + np.uint64(self.n)))
        hashes[-1:] = words.mix(np.array([START + np.uint64(self.n)]))
        self.level = Level(place, hashes, ctx=ctx, last=last, lower=lower)
        self.hot = low.count[ctx] > self.unigrams.tokens / self.parts
        key = low.hashes[ctx]
        key[self.hot] ^= words.mix(self.vocabulary[last[self.hot]])
        self.part = _slices(words.mix(key), self.parts).astype(np.int32)
        del key
        self.order = np.argsort(self.part, kind="stable")

    def asks(self):
        """(part, request) for each partition; n-grams in the order of contexts and last words."""
        level, low = self.level, self.before
        train = np.repeat(self.held == 0, self.lengths)
        seen = np.bincount(level.place[train], minlength=len(level.ctx))
        cut = np.searchsorted(self.part[self.order], np.arange(self.parts + 1))
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                at = self.order[a:b]
                ctx = level.ctx[at]
                head = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
                # what the last word has without the first one: for pairs its count, which is shorter
                share = {"single": _tight(self.words[level.last[at]])} if self.n == 2 else {"share": low.probability[level.lower[at]]}
                yield p, {
                    "first": low.hashes[ctx[head]], "hot": self.hot[at[head]], "run": _tight(np.diff(np.append(head, b - a))),
                    "second": _top_bytes(self.vocabulary[level.last[at]]), "seen": _tight(seen[at]), **share,
                }

    def answered(self, answers, discounts, hot, hot_facts):
        """Counts and probabilities of the n-grams, by the answers of the partitions in their order."""
        level, low = self.level, self.before
        answers = [_load(a) for a in answers]
        count = np.empty(len(level.ctx), dtype=np.int64)
        if answers:
            count[self.order] = np.concatenate([a["counts"].astype(np.int64) for a in answers])
        context = low.count[level.ctx]
        value = low.probability[level.lower]
        seen = count > 0
        value[seen] = discounts.mass(count[seen]) / context[seen]
        back = ~seen & (context > 0)
        if back.any():
            name, place = _distinct(low.hashes[level.ctx[back]])
            known = np.concatenate([hot, *(a["first"] for a in answers)])
            fact = np.concatenate([hot_facts, *(a["facts"] for a in answers)])
            by = np.argsort(known, kind="stable")
            facts = fact[by[np.searchsorted(known[by], name)]]
            of = np.zeros(len(name))
            of[place] = context[back]
            left = discounts.left(facts[:, :CUTOFF].T, facts[:, CUTOFF]) / of
            value[back] *= (left / (1 - facts[:, CUTOFF + 1]))[place]
        return count, value


def _by_block(make):
    """Runs make(block id, texts, words, answers by parts) for each block of a partition, which has one."""

    def run(batches):
        texts, asked = {}, {}
        for batch in batches:
            for block, part, text, own, answer in zip(*(batch.column(k) for k in range(5)), strict=True):
                block, part = block.as_py(), part.as_py()
                if part < 0:
                    texts[block] = (text.as_py(), own.as_py())
                else:
                    asked.setdefault(block, []).append((part, answer.as_py()))
            del batch, text, own, answer
        for block in sorted(texts):
            by_part = sorted(asked.pop(block, ()), key=lambda x: x[0])
            yield from make(block, *texts.pop(block), [answer for _, answer in by_part])

    return run


def _join_counts(answers):
    return np.concatenate([_load(a)["counts"].astype(np.int64) for a in answers]) if answers else np.zeros(0, dtype=np.int64)


def _count_grams(unigrams):
    def run(batches):
        parts, blocks, asks = _gathered(batches)
        if not parts:
            return
        take = lambda name, kind: np.concatenate([a[name].astype(kind) for a in asks])
        runs, size = take("run", np.int64), [len(a["second"]) for a in asks]
        heads = [len(a["first"]) for a in asks]
        first, hot = take("first", np.uint64), take("hot", bool)
        second = _from_top_bytes(take("second", np.uint8))
        seen = take("seen", np.int64)
        single = "single" in asks[0].files
        share = take("single", np.int64) if single else take("share", np.float64)
        del asks, take
        f = np.repeat(first, runs)
        order = np.lexsort((second, f))
        f, s = f[order], second[order]
        del second
        new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))
        del s
        rank = np.cumsum(new, dtype=np.int32 if len(order) < 2**31 else np.int64)
        rank -= 1
        gram = np.empty_like(rank)
        gram[order] = rank
        del rank
        head = np.flatnonzero(new)
        total = np.add.reduceat(seen[order], head)
        share = share[order[head]]
        del order, seen, new
        context, of_gram = _distinct(f[head])  # of_gram: the context of each distinct n-gram
        del f, head
        n = len(context)
        share = unigrams.probability(share) if single else share
        share = np.where(total > 0, share, 0.0)
        facts = np.stack([*(np.bincount(of_gram[total == r], minlength=n) for r in range(1, CUTOFF + 1)), np.bincount(of_gram[total > CUTOFF], minlength=n), np.bincount(of_gram, share, n)], axis=1)
        of_count, above = _of_count(total)
        is_hot = np.zeros(n, dtype=bool)
        is_hot[np.searchsorted(context, first[hot])] = True
        rows = [(-1, parts[0], _pack(stats=np.array([*of_count, above], dtype=np.int64)))]
        if is_hot.any():
            rows.append((-2, parts[0], _pack(hot=context[is_hot], facts=facts[is_hot])))
        unseen = total[gram] == 0
        at_gram, at_head = np.cumsum([0, *size]), np.cumsum([0, *heads])
        for i, (part, block) in enumerate(zip(parts, blocks, strict=True)):
            mine = slice(at_gram[i], at_gram[i + 1])
            own = first[at_head[i] : at_head[i + 1]]
            run = np.repeat(np.arange(heads[i]), runs[at_head[i] : at_head[i + 1]])
            wanted = np.flatnonzero(np.bincount(run[unseen[mine]], minlength=heads[i]) > 0)
            wanted = wanted[~hot[at_head[i] : at_head[i + 1]][wanted]]
            rows.append((block, part, _pack(counts=_tight(total[gram[mine]]), first=own[wanted], facts=facts[np.searchsorted(context, own[wanted])])))
        yield from _answers(rows)

    return run


def _hot_facts(answers):
    """(hashes, facts) of the contexts that lie in many partitions, summed; there are fewer of them than partitions."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column(0):
                data = _load(blob.as_py())
                columns = [pa.array(data["hot"].view(np.int64)), *[pa.array(data["facts"][:, k]) for k in range(CUTOFF + 2)]]
                yield pa.RecordBatch.from_arrays(columns, names=["context", *[f"f{k}" for k in range(CUTOFF + 2)]])

    names = [f"f{k}" for k in range(CUTOFF + 2)]
    rows = answers.where("block = -2").select("answer").mapInArrow(run, "context long, " + ", ".join(f"{f} double" for f in names))
    found = rows.groupBy("context").agg(*[F.sum(f).alias(f) for f in names]).collect()
    hot = np.array([r["context"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], np.array([[r[f] for f in names] for r in found], dtype=float).reshape(-1, CUTOFF + 2)[order]


def _stats(answers, size):
    """The sum of what the partitions say of all their keys: one row of a few numbers each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            total = sum((_load(b.as_py())["stats"] for b in batch.column(0)), np.zeros(size, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in total], names=[f"s{k}" for k in range(size)])

    names = [f"s{k}" for k in range(size)]
    rows = answers.where("block = -1").select("answer").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return [v or 0 for v in rows.agg(*[F.sum(n) for n in names]).first()]


def score(docs: DataFrame, held_out, order=ORDER, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: boolean column; those documents are scored but not learnt from.
    order: words of the longest n-grams, 2 at least.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    store = common.Store(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text_column).alias("text"))
    blocks = store.put(texts.mapInArrow(common.lean(_blocks), "block long, texts binary, words binary, n_words long, n_tokens long"), "blocks", "none", common.BLOBS)
    n_blocks, n_words, n_tokens = blocks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_blocks = max(1, n_blocks)
    least = common.partitions(spark)
    parts, gram_parts = (max(least, -(-n // KEYS_A_PART)) for n in (n_words, n_tokens))
    # one block a task: blocks are numbered by the partitions that made them, of which there are as many as tasks
    made = blocks.groupBy(F.shiftright("block", 20).alias("maker")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("maker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    makers = store.put(made.select("maker", before.cast("int").alias("first")), "makers")

    def gathered(blocks, answers, make, schema):
        empty = F.lit(None).cast("binary")
        rows = blocks.select("block", F.lit(-1).alias("part"), "texts", "words", empty.alias("answer"))
        rows = rows.unionByName(answers.where("block >= 0").select("block", "part", empty.alias("texts"), empty.alias("words"), "answer"))
        rows = rows.join(F.broadcast(makers), F.shiftright("block", 20) == F.col("maker"))  # a row for each task that made blocks
        place = F.col("first") + F.col("block").bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        rows = rows.repartitionById(n_blocks, place)  # sorted by their readers, as Spark would hold them in large pages
        return rows.select("block", "part", "texts", "words", "answer").mapInArrow(common.lean(_by_block(make)), schema)

    asked = blocks.select("block", "words").mapInArrow(common.lean(_ask_words(parts)), "part int, block long, ask binary").repartitionById(parts, F.col("part"))
    answers = store.put(asked.mapInArrow(common.lean(_count_words), "block long, part int, answer binary"), "words", "none", common.BLOBS)
    total = _stats(answers, CUTOFF + 4)
    unigrams = Unigrams(total[0], total[1], total[2:-1], total[-1])

    def kept(number, texts, own):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([texts], type=pa.binary()), pa.array([own], type=pa.binary())], names=["block", "texts", "words"])

    def know_words(number, texts, own, answers):
        yield kept(number, texts, _pack(vocabulary=_load(own)["vocabulary"], counts=_tight(_join_counts(answers))))

    # blocks with the answers are written again, so that neither the first ones nor that shuffle stay beside the next
    known = store.put(gathered(blocks, answers, know_words, "block long, texts binary, words binary"), "known", "none", common.BLOBS)
    del asked
    store.drop(blocks, answers)

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for number, texts, own in zip(*(batch.column(k) for k in range(3)), strict=True):
                for p, request in Block(texts.as_py(), own.as_py(), unigrams, gram_parts).asks():
                    yield pa.RecordBatch.from_arrays([pa.array([p], type=pa.int32()), pa.array([number.as_py()]), pa.array([_pack(**request)], type=pa.binary())], names=["part", "block", "ask"])

    for n in range(2, order + 1):
        asked = known.mapInArrow(common.lean(ask), "part int, block long, ask binary").repartitionById(gram_parts, F.col("part"))
        answers = store.put(asked.mapInArrow(common.lean(_count_grams(unigrams)), "block long, part int, answer binary"), f"grams{n}", "none", common.BLOBS)
        total = _stats(answers, CUTOFF + 2)
        hot, hot_facts = _hot_facts(answers)
        del asked
        store.sweep()
        discounts = Discounts(total[:-1])

        def know(number, texts, own, answers, discounts=discounts, hot=hot, hot_facts=hot_facts, n=n):
            block = Block(texts, own, unigrams, gram_parts)
            count, probability = block.answered(answers, discounts, hot, hot_facts)
            yield kept(number, texts, _pack(**block.own, **{f"counts{n}": _tight(count), f"probability{n}": probability}))

        if n < order:
            before_, known = known, store.put(gathered(known, answers, know, "block long, texts binary, words binary"), "known", "none", common.BLOBS)
            store.drop(before_, answers)

    def evaluate(number, texts, own, answers):
        import pyarrow as pa

        block = Block(texts, own, unigrams, gram_parts)
        _, probability = block.answered(answers, discounts, hot, hot_facts)
        value = np.log10(probability)
        sums = lambda x: np.add.reduceat(x, block.starts)
        columns = [
            pa.array(block.ids, mask=~block.known), pa.array(block.held == 1), pa.array(block.lengths), pa.array(sums((block.words > 0)[block.index].astype(np.int64))),
            pa.array(np.full(len(block.ids), unigrams.tokens)), pa.array(sums(unigrams.base(block.words)[block.index])), pa.array(sums(value[block.level.place])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return gathered(known, answers, evaluate, schema)
