"""One query for each operator, over its whole table."""

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (
    html_text, language_id, language_model, merkle, mtree, packing, quality, rules, sentencepiece_ids, simhash, spelling, toxicity, warc,
)
from threadloom.llm.catalog import ORACLES, QUERIES, query
from threadloom.llm.common import read
from threadloom.llm.oracle import OP2_SQL, OP3_SQL, OP6_SQL, OP11_SQL, OP13_SQL

__all__ = ["ORACLES", "QUERIES"]


def piece_model() -> bytes:
    """The model file in the folder of public tokenizers, which the environment may name."""
    folder = os.environ.get("THREADLOOM_TOKENIZERS", "/opt/tokenizers")
    return (Path(folder) / "piece_bpe_32k.model").read_bytes()


@query()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted(read(spark, sf_dir, "pages"))


@query(OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    return warc.round_trip(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether the rules keep it."""
    docs = read(spark, sf_dir, "documents")
    found = rules.judged(docs, keep=F.struct("doc_id"))
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read(spark, sf_dir, "documents")
    return language_id.predicted(docs, language_id.train(docs))


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the chain over its lines."""
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model)


@query(OP6_SQL)
def op6_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return mtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query()
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the unigram and the neural model."""
    return language_model.scored(read(spark, sf_dir, "documents"))


@query()
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return sentencepiece_ids.round_trip(read(spark, sf_dir, "documents"), piece_model())


@query(OP11_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words, its form and its root."""
    return spelling.variants(read(spark, sf_dir, "documents"))


@query()
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by source, and the check of each against its root."""
    return merkle.checked_documents(read(spark, sf_dir, "documents"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
