"""The registered queries of this folder, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import (alignment, ball_codes, balltree, html_crf, langid, mixing, packing, partenum, quality_model,
                         quality_rules, suffix_dedup, token_counts, url_reputation)
from vitrine.llm.oracles import ORACLE_SQL  # noqa: F401  (read by the entry module)
from vitrine.sources.tables import raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents", "doc_id", "text")
    return quality_model.classify(docs, raw(spark, sf_dir, "labels", "doc_id", "quality"))


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(raw(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.linked_groups(raw(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(raw(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents", "doc_id", "lang", "text")
    labels = raw(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(raw(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_reputation.judge(raw(spark, sf_dir, "pages", "page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(raw(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(raw(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(raw(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(raw(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.codes(raw(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
