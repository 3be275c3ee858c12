"""Corpus pipeline: toxicity, near copies, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of ``documents``.

Defined cases are those of the operators; a stage on an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.llm.bpe import encode_documents
from stakelens.llm.mixing import sample_mixed
from stakelens.llm.near_copies import drop_near_copies
from stakelens.llm.sentence_dedup import drop_repeated_sentences
from stakelens.llm.toxicity import drop_toxic, fit_toxicity, held_out
from stakelens.session import table, work_path

#: Seeded sampling and trained models have no SQL form; the tests hold the stages against plain loops.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels that are not held out, doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return drop_toxic(docs, fit_toxicity(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a likeness of 0.8 or more."""
    return drop_near_copies(docs, least=0.8, words_in_shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated spans; n_chars follows the text."""
    out = drop_repeated_sentences(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that meet the target shares."""
    return sample_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, after a round trip that must give the text back."""
    import public_tokenizers

    texts = docs.select("doc_id", "lang", "source", "text")
    coded = encode_documents(texts, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.coalesce(F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.lit(False))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
