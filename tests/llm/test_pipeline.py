import corpus_pipeline as cp
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_groups

from bioquery.llm import common, line_dedup

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    store = common.Store(spark)
    docs = common.table(spark, SF, "documents")
    seen = {}
    for name, stage in cp.STAGES:
        out = store.put(stage(spark, docs, SF), name)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = out
        docs = out
    texts = {name: {r.doc_id: r.text for r in df.collect()} for name, df in seen.items() if "text" in df.columns}
    after = brute_lines(list(texts["quality"].items()), line_dedup.MIN_WORDS)
    assert texts["line_dedup"] == {i: t for i, t in after.items() if t == texts["quality"][i] or t.strip()}
    groups = brute_groups(list(texts["line_dedup"].items()), 5, 80, 100)
    assert set(texts["ngram_join"]) == {i for i, _, component in groups if i == component}
    assert set(texts["mixing"]) < set(texts["ngram_join"])
    assert {r.doc_id for r in seen["sentencepiece"].collect()} == set(texts["mixing"])
    assert cp.run(spark, SF).count() == len(texts["mixing"])


def test_clean_documents_pass_the_classifier(spark):
    docs = common.table(spark, SF, "documents")
    kept = {r.doc_id for r in cp.reject_bad(spark, docs, SF).select("doc_id").collect()}
    labels = common.table(spark, SF, "labels").collect()
    good = [x.doc_id for x in labels if x.quality == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(x.doc_id in kept for x in labels if x.quality == 0) <= 0.1 * len(labels)


def test_edges_of_all_stages(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names, and an empty table."""
    from pyspark.sql import functions as F

    long = "\n".join(f"Line {k} of a very long text, which has words." for k in range(40_000))
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "short text"), (5, "short text"), (None, "without an id"), (6, "short text")]
    docs = spark.createDataFrame([(i, t, "en" if i != 3 else None, None if i == 4 else "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __text string")
    docs = docs.withColumns({"component": F.lit(1), "__kept": F.lit(False), "lines": F.lit("l"), "tile": F.lit(2)})
    line = cp.delete_repeated_lines(spark, docs, SF)
    assert line.columns == docs.columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in line.collect()) == sorted((str(i), len(t or "")) for i, t in rows if i != 2)
    one = cp.one_of_each_group(spark, docs, SF)
    assert one.columns == docs.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(["1", "3", "4", "5", "5", "None"])
    drawn = cp.sample_to_targets(spark, docs, SF)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} <= {i for i, _ in rows}
    good = cp.reject_bad(spark, docs, SF)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} <= {i for i, _ in rows}
    assert sorted(str(r.doc_id) for r in cp.encode(spark, docs, SF).collect()) == sorted(str(i) for i, _ in rows)
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0
        assert name == cp.STAGES[-1][0] or out.columns == docs.columns
