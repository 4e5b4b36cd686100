"""A training-data pipeline over documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever they are.  ``run`` applies them in
order, each on the table that the one before has written.

Edges: rows with a null or empty text pass the classifier with the share of good
labels, are never copies or linked, and are sampled like others of their cell;
rows that repeat an id and a text are one document for line dedup and the n-gram
join and stay together; rows without an id are kept by both; an empty table stays
empty; very long texts are read whole by every stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bioquery.llm import common, line_dedup, mixing, ngram_join, quality, sentence_pieces


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"), lambda c: common.fold(c, 3) != 1)
    return quality.keep_good(docs, model)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document of which nothing is left goes."""
    rows = line_dedup.delete_later_copies(docs)
    new = F.col(rows.columns[-1])
    text = {"text": new["text"], "n_chars": F.when(new["n_deleted"] > 0, F.length(new["text"]).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return rows.where((new["n_deleted"] == 0) | (F.trim(new["text"]) != "")).select(*[text.get(c, F.col(c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word n-grams at 0.8."""
    groups = ngram_join.join(docs, width=5, numerator=80)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to the margins of source, language and topic."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids, spans and decoded text."""
    import public_tokenizers

    return sentence_pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", reject_bad),
    ("line_dedup", delete_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", sample_to_targets),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    store = common.Store(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
