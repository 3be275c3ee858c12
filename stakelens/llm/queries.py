"""Registered queries of the corpus operators and, where SQL can say it, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stakelens.llm.common import table
from stakelens.llm.reference_sql import OP12_SQL, OP13_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual vocabulary, and what they decode to."""
    import public_tokenizers

    from stakelens.llm.bpe import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_compression_toxicity")
def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    from stakelens.llm.toxicity import fit_toxicity, held_out, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return score_documents(docs, fit_toxicity(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op7_vantage_simhash")
def op7_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    from stakelens.llm.simhash import hex_column, near_groups

    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_column(F.col("bits")).alias("fingerprint"), "component_id"
    )


@query("op1_imatch")
def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprint of every document and of its edited text."""
    from stakelens.llm.imatch import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Rules of the query (fixed values).
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


@query("op2_url_logistic")
def op2_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    from stakelens.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )


@query("op4_raking_mix")
def op4_raking_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and sampling decision of every document."""
    from stakelens.llm.mixing import mixed

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed(docs).drop("text")


@query("op5_sentence_spans")
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat an earlier span."""
    from stakelens.llm.sentence_dedup import drop_repeated_sentences

    return drop_repeated_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), figures=True)


#: The ten best of every query by whole-number inner product.
OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), r as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from s
)
select * from r where rank <= 10
"""


@query("op6_cover_tree", OP6_SQL)
def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    from stakelens.llm.cover_tree import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_hidden_markov")
def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log likelihood of every document under a model of those not held out."""
    from stakelens.llm.hmm import is_held_out, train_and_score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trained, scored = train_and_score(docs, ~is_held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(trained.symbols.n).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    return corpus_pipeline.run(spark, sf_dir)


@query("op8_suffix_arrays")
def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated strings of 400 bytes."""
    from stakelens.llm.suffix_dedup import drop_repeated_bytes

    return drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op11_learned_partitions")
def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of largest cosine found for every fiftieth vector."""
    from stakelens.llm.learned_partitions import nearest_by_cosine

    return nearest_by_cosine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op12_filter_diagrams", OP12_SQL)
def op12_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all orders of five filters for every source."""
    from stakelens.llm.filter_audit import audit_documents

    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and which fail after their text was changed."""
    from stakelens.llm.merkle import tampered, verified_manifest

    return verified_manifest(table(spark, sf_dir, "documents"), tampered(F.crc32(F.col("doc_id").cast("string")) % 5 == 0))
