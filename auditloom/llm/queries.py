"""Registered queries of the corpus operators, with their expected results in SQL where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import (
    bpe, class_lm, fingerprints, html_text, language, line_dedup, minhash, mixing, packing, quality, search, toxicity,
    variants,
)
from auditloom.llm.common import crc32_mod, table
from auditloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents"), with_text=False)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod("doc_id", 10) == 0
    model, counts = class_lm.learn(docs.filter(~held_out))
    return class_lm.score(docs, model, counts, held_out)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def identified(docs: DataFrame, labelled: DataFrame, keep: list[str]) -> DataFrame:
    labels, model = language.trigram_model(language.labelled_sample(labelled, "lang"))
    return language.identify(docs, labels, model, keep)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: lang is the language that their markup declared, source the host."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.col("lang").alias("__declared"), F.col("source").alias("__host"))
    return identified(rows, docs, ["doc_id"])


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: main text, language declared in the markup, host and suffix of the address."""
    pages = table(spark, sf_dir, "pages")
    texts = html_text.extract(pages).select("page_id", "text")
    facts = pages.select(
        "page_id", language.declared_in(F.col("html")).alias("__declared"), language.host_of(F.col("url")).alias("__host")
    )
    return identified(texts.join(facts, "page_id"), table(spark, sf_dir, "documents"), ["page_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_quality_rules": op3_quality_rules,
    "op4_fingerprints": op4_fingerprints,
    "op5_html_extraction": op5_html_extraction,
    "op6_class_lm": op6_class_lm,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_packing": op12_packing,
    "op13_ranked_search": op13_ranked_search,
    "page_languages": page_languages,
}
