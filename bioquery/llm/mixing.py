"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic) on all documents; the cells
are raked in turn to the target shares of the three margins until all hold (to
1e-12, or ROUNDS rounds where targets contradict each other).  Every cell gets a
weight (1 on average over tokens) and a probability.  The probability is rate *
weight where that is at most 1 everywhere; else cells are capped at 1 and the
others raked again in CAP_ROUNDS rounds, so that expected tokens keep the
margins to CLOSE.  A rate too high for that is lowered, to the highest of STEPS
steps that holds them, or to 1 / largest weight, which always does; a warning
tells so, and which targets the weights themselves miss.  ``margins`` returns
the shares that are targets, weighted and expected.  A document is sampled by a
hash of its id, so the sample does not depend on order, partitions or retries.

Topics are read from ``topic_column``; without one they are a rule on a text's
form (tables, licences, addresses, lengths), as a stand-in.

Targets are shares by category, summed to 1; a margin without given targets is
tempered: shares in proportion to its token counts to the power ``temper``.
Categories without a target get share 0 and none of their documents is sampled.
The cells that go to the driver are as many as the categories' combinations;
more than ``max_cells`` is refused.

Edges: null and empty texts have 0 tokens and are sampled like others of their
cell; null sources, languages and topics are a category of their own; a corpus
without tokens has weight 1 everywhere; null ids are hashed as empty text, and
rows that repeat an id share its fate in their cell; an empty table stays empty.
Extra columns are not looked at and kept, whatever their names.
"""

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bioquery.llm import common

MARGINS = ("source", "lang", "topic")
ROUNDS = 60
STEPS, CAP_ROUNDS, CLOSE = 32, 100, 1e-4


def tokens(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic(text, n_tokens):
    """A topic by form: what of these a text has first."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(body.contains(" | "), "table").when(body.contains("License"), "legal").when(body.contains("@"), "contact")
        .when(n_tokens < 100, "short").when(n_tokens < 1000, "medium").otherwise("long")
    )


def rake(counts, codes, targets, rounds=ROUNDS):
    """Weights of cells so that weighted counts have the target shares of each margin.

    counts: tokens of cells; codes: for each margin the category index of each
    cell; targets: for each margin the share of each category.
    """
    counts = np.asarray(counts, dtype=float)
    total = counts.sum()
    mass = counts.copy()
    for _ in range(rounds):
        before = mass
        for code, share in zip(codes, targets, strict=True):
            have = np.bincount(code, mass, len(share))
            mass = mass * np.divide(share * total, have, out=np.zeros(len(share)), where=have > 0)[code]
        if np.all(np.abs(mass - before) <= 1e-12 * mass):
            break
    return np.divide(mass, counts, out=np.ones(len(counts)), where=counts > 0)


def calibrate(counts, codes, weights, rate):
    """(probabilities of cells, rate): expected tokens have the margins of the weighted counts."""
    counts, weights = np.asarray(counts, dtype=float), np.asarray(weights, dtype=float)
    live = counts > 0
    rate, top = min(float(rate), 1.0), weights[live].max(initial=0.0)
    safe = min(rate, 1 / top) if top > 0 else rate
    wants = [np.bincount(code, weights * counts) for code in codes]
    for step in range(STEPS, 0, -1):
        r = rate * step / STEPS
        if r <= safe:
            break
        mass = np.minimum(r * weights, 1.0) * counts
        for _ in range(CAP_ROUNDS):
            for code, want in zip(codes, wants, strict=True):
                have = np.bincount(code, mass, len(want))
                mass = np.minimum(mass * np.divide(r * want, have, out=np.zeros(len(want)), where=have > 0)[code], counts)
        if all(np.all(np.abs(np.bincount(code, mass, len(want)) - r * want) <= CLOSE * r * want) for code, want in zip(codes, wants, strict=True)):
            return np.divide(mass, counts, out=np.minimum(1.0, r * weights), where=live), r
    return np.minimum(1.0, safe * weights), safe


def _unmet(counts, codes, shares, weights, names):
    """Categories whose weighted share is not the target."""
    mass = counts * weights
    have = [np.bincount(code, mass, len(share)) / mass.sum() for code, share in zip(codes, shares, strict=True)]
    return [name for h, share, ns in zip(have, shares, names, strict=True) for x, want, name in zip(h, share, ns, strict=True) if abs(x - want) > 1e-4 * max(want, 1e-4)]


def _keyed(docs, names, id_column, text_column, topic_column):
    """docs with the cell and the tokens of each row, under names that docs doesn't have."""
    none = F.lit("(none)")
    rows = docs.withColumns({names["source"]: F.coalesce("source", none), names["lang"]: F.coalesce("lang", none), names["tokens"]: tokens(F.col(text_column))})
    return rows.withColumn(names["topic"], F.coalesce(F.col(topic_column).cast("string"), none) if topic_column else topic(F.col(text_column), F.col(names["tokens"])))


def _fitted(rows, names, targets, rate, temper, max_cells):
    """(cells, their counts, weights and probabilities; for each margin its categories, codes and target shares)."""
    margins = [names[m] for m in MARGINS]
    cells = rows.groupBy(*margins).agg(F.sum(names["tokens"]).alias("n")).orderBy(*margins).limit(max_cells + 1).collect()
    if len(cells) > max_cells:
        raise ValueError(f"more than {max_cells} cells")
    counts = np.array([c["n"] for c in cells], dtype=float)
    codes, shares, categories = [], [], []
    for margin in MARGINS:
        known = sorted({c[names[margin]] for c in cells})
        place = {name: i for i, name in enumerate(known)}
        code = np.array([place[c[names[margin]]] for c in cells], dtype=int)
        given = (targets or {}).get(margin)
        have = np.bincount(code, counts, len(known)) if known else np.zeros(0)
        share = np.array([given.get(name, 0.0) for name in known]) if given else have**temper
        categories.append(known)
        codes.append(code)
        shares.append(share / share.sum() if share.sum() else share)
    if not counts.sum():
        return cells, counts, np.ones(len(cells)), np.full(len(cells), min(float(rate), 1.0)), categories, codes, shares
    weights = rake(counts, codes, shares)
    probabilities, used = calibrate(counts, codes, weights, rate)
    if used < min(rate, 1.0):
        warnings.warn(f"the rate is lowered from {rate} to {used:.6f} so that the margins hold", stacklevel=4)
    if unmet := _unmet(counts, codes, shares, weights, [[f"{m} {c}" for c in known] for m, known in zip(MARGINS, categories, strict=True)]):
        warnings.warn(f"targets that cannot be met: {', '.join(unmet[:20])} ({len(unmet)} in all)", stacklevel=4)
    return cells, counts, weights, probabilities, categories, codes, shares


def _raked(docs, targets, rate, temper, seed, max_cells, id_column, text_column, topic_column):
    """(rows of docs with cell, tokens, weight, probability and kept, names of these columns)."""
    spark = docs.sparkSession
    names = {name: common.fresh(docs.columns, name) for name in (*MARGINS, "tokens", "weight", "probability", "kept")}
    rows = _keyed(docs, names, id_column, text_column, topic_column)
    cells, _, weights, probabilities, *_ = _fitted(rows, names, targets, rate, temper, max_cells)
    margins = [names[m] for m in MARGINS]
    table = [(*(c[m] for m in margins), float(w), float(p)) for c, w, p in zip(cells, weights, probabilities, strict=True)]
    # at most max_cells rows of three short names and two numbers
    raked = F.broadcast(spark.createDataFrame(table, ", ".join(f"{m} string" for m in margins) + f", {names['weight']} double, {names['probability']} double"))
    text_id = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    uniform = F.conv(F.substring(F.md5(text_id.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return rows.join(raked, margins).withColumn(names["kept"], uniform < F.col(names["probability"])), names


def mix(docs: DataFrame, targets=None, rate=0.5, temper=0.7, seed=17, max_cells=200_000, id_column="doc_id", text_column="text", topic_column=None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, kept."""
    narrow = docs.select(*dict.fromkeys(c for c in (id_column, text_column, "source", "lang", topic_column) if c))
    out, names = _raked(narrow, targets, rate, temper, seed, max_cells, id_column, text_column, topic_column)
    return out.select(F.col(id_column).alias("doc_id"), *[F.col(names[c]).alias("n_tokens" if c == "tokens" else c) for c in ("source", "lang", "topic", "tokens", "weight", "probability", "kept")])


def sample(docs: DataFrame, targets=None, rate=0.5, temper=0.7, seed=17, max_cells=200_000, id_column="doc_id", text_column="text", topic_column=None) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    out, names = _raked(docs, targets, rate, temper, seed, max_cells, id_column, text_column, topic_column)
    return out.where(names["kept"]).select(*docs.columns)


def margins(docs: DataFrame, targets=None, rate=0.5, temper=0.7, max_cells=200_000, id_column="doc_id", text_column="text", topic_column=None) -> DataFrame:
    """(margin, category, n_tokens, target, weighted, expected): shares of the targets, of weighted and of expected sampled tokens."""
    names = {name: common.fresh(docs.columns, name) for name in (*MARGINS, "tokens")}
    _, counts, weights, probabilities, categories, codes, shares = _fitted(_keyed(docs, names, id_column, text_column, topic_column), names, targets, rate, temper, max_cells)
    part = lambda code, mass, n: np.bincount(code, mass, n) / (mass.sum() or 1.0)
    rows = []
    for margin, known, code, share in zip(MARGINS, categories, codes, shares, strict=True):
        columns = [np.bincount(code, counts, len(known)), share, part(code, counts * weights, len(known)), part(code, counts * probabilities, len(known))]
        rows += [(margin, name, int(n), *map(float, rest)) for name, n, *rest in zip(known, *columns, strict=True)]
    return docs.sparkSession.createDataFrame(rows, "margin string, category string, n_tokens long, target double, weighted double, expected double")


def oracle(rate=0.5, temper=0.7, seed=17):
    """The same in SQL, by recursion over the rounds; candidates for the rate are raked side by side."""
    cell = ", ".join(MARGINS)

    def raked(source, want, keys, top=None):
        """Source raked to each margin in turn, as nested selects."""
        for m in MARGINS:
            mass = f"CASE WHEN sum(mass) OVER (PARTITION BY {keys}{m}) > 0 THEN mass * {want.format(m=m)} / sum(mass) OVER (PARTITION BY {keys}{m}) ELSE 0 END"
            source = f"(SELECT * REPLACE ({f'least({mass}, n)' if top else mass} AS mass) FROM {source})"
        return source

    margins = ", ".join(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(n), {temper}) / sum(pow(sum(n), {temper})) OVER () * (SELECT sum(n) FROM cells) AS want_{m} FROM cells GROUP BY {m})" for m in MARGINS)
    close = " AND ".join(f"abs(sum(mass) OVER (PARTITION BY j, {m}) - r * want_{m}) <= {CLOSE} * r * want_{m}" for m in MARGINS)
    return f"""
        WITH RECURSIVE counted AS (
          SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,
                 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
        rows_ AS MATERIALIZED (
          SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'License') THEN 'legal'
            WHEN contains(text, '@') THEN 'contact' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM counted),
        cells AS MATERIALIZED (SELECT {cell}, sum(n_tokens)::DOUBLE AS n FROM rows_ GROUP BY ALL),
        {margins},
        raking AS (
          SELECT 0 AS k, *, n AS mass FROM cells {" ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS)}
          UNION ALL SELECT * REPLACE (k + 1 AS k) FROM {raked("raking", "want_{m}", "")} WHERE k < {ROUNDS}),
        weighted AS MATERIALIZED (SELECT {cell}, n, CASE WHEN n > 0 THEN mass / n ELSE 1 END AS weight FROM raking WHERE k = {ROUNDS}),
        rates AS (SELECT j, CASE WHEN j = 0 THEN least({rate}, 1 / (SELECT max(weight) FROM weighted WHERE n > 0)) ELSE {rate}::DOUBLE * j / {STEPS} END AS r FROM range({STEPS + 1}) c(j)),
        capping AS (
          SELECT 0 AS k, j, r, {cell}, n, weight, least(r * weight, 1) * n AS mass, {", ".join(f"sum(n * weight) OVER (PARTITION BY j, {m}) AS want_{m}" for m in MARGINS)} FROM weighted, rates
          UNION ALL SELECT * REPLACE (k + 1 AS k) FROM {raked("capping", "r * want_{m}", "j, ", top=True)} WHERE k < {CAP_ROUNDS}),
        held AS (SELECT *, {close} AS ok FROM capping WHERE k = {CAP_ROUNDS}),
        best AS (SELECT j FROM held GROUP BY j, r HAVING bool_and(ok) ORDER BY r DESC, j LIMIT 1),
        chosen AS (SELECT {cell}, weight, CASE WHEN n > 0 THEN mass / n ELSE least(1, r * weight) END AS probability FROM held WHERE j = (SELECT j FROM best)),
        drawn AS (SELECT *, ('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM rows_ JOIN chosen USING ({cell}))
        SELECT doc_id, {cell}, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, u < probability AS kept FROM drawn"""
