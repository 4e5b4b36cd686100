"""The queries opN_<name>: each applies one operator to its whole table."""

from pyspark.sql import functions as F

from bioquery.llm import common


def op1_mixing(spark, sf_dir):
    from bioquery.llm.mixing import mix

    return mix(common.table(spark, sf_dir, "documents")).withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


def op2_vector_dedup(spark, sf_dir):
    from bioquery.llm.vector_dedup import link

    return link(common.table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark, sf_dir):
    from bioquery.llm.line_dedup import delete_later_copies

    rows = delete_later_copies(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("__lines.text", F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", "__lines.n_lines", "__lines.n_deleted", F.col("__lines.runs").alias("deleted_runs"), digest.alias("text_sha256"))


def op4_personal_data(spark, sf_dir):
    from bioquery.llm.personal_data import scan

    return scan(common.table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    from bioquery.llm.ngram_join import join

    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op6_exact_dedup(spark, sf_dir):
    from bioquery.llm.exact_dedup import deduplicate

    return deduplicate(common.table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    from bioquery.llm import toxicity

    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), lambda c: common.fold(c, 4) != 2)
    return _with_fold(toxicity.score(docs, model), 4, 2)


def op8_quality(spark, sf_dir):
    from bioquery.llm import quality

    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"), lambda c: common.fold(c, 3) != 1)
    return _with_fold(quality.score(docs, model), 3, 1)


def _with_fold(scores, modulus, remainder):
    return scores.select("doc_id", (common.fold("doc_id", modulus) == remainder).alias("held_out"), "score", "predicted")


def op9_katz(spark, sf_dir):
    from bioquery.llm.katz import score

    return score(common.table(spark, sf_dir, "documents"), common.fold("doc_id", 7) == 2)


def op10_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from bioquery.llm.sentence_pieces import encode_documents

    return encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries():
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql():
    from bioquery.llm.mixing import oracle

    return {
        "op1_mixing": oracle(),
        "op2_vector_dedup": """
            WITH RECURSIVE good AS (
              SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            links AS (
              SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
            reach AS (
              SELECT a AS node, a AS other FROM links
              UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
            low AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
            many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
            SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
                   e.vec_id = coalesce(component_id, e.vec_id) AS kept
            FROM embeddings e LEFT JOIN low ON e.vec_id = low.node LEFT JOIN many ON e.vec_id = many.a""",
        "op5_ngram_join": f"""
            WITH RECURSIVE split AS (
              SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            sets AS (
              SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split),
            sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
            classes AS (SELECT list_sort(s) AS s, n, min(doc_id) AS node FROM sized WHERE n > 0 GROUP BY ALL),
            grams AS (SELECT node, n, unnest(s) AS g FROM classes),
            links AS (
              SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b ON a.g = b.g AND a.node <> b.node
              GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
            reach AS (
              SELECT a AS node, a AS other FROM links
              UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
            low AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
            SELECT d.doc_id, d.n AS n_shingles, coalesce(component, c.node, d.doc_id) AS component_id, coalesce(c.node, d.doc_id) AS class_id
            FROM sized d LEFT JOIN classes c ON c.s = list_sort(d.s) AND d.n > 0 LEFT JOIN low ON low.node = c.node""",
        "op6_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256({_LOWERED}) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY {_LOWERED})""",
    }
