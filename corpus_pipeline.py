"""A corpus pipeline of five operators, each stage written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm import bpe, language, line_dedup, minhash, mixing
from auditloom.llm.common import BLANKS, table
from auditloom.operators.persisting import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def _met(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` with what was ``found`` for their id and text (doc_id, text_hash, ...).

    Rows that repeat both are one document. Both sides grow, so both are shuffled at every size.
    """
    right = found.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_hash", "__of").hint("merge")
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("__hash"))
    met = hashed.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")))
    one = Window.partitionBy("__id", "__of").orderBy("source", "lang")
    return met.withColumn("__copy", F.row_number().over(one)).filter(F.col("__copy") == 1)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang becomes the language found."""
    labels, model = language.trigram_model(language.labelled_sample(docs, "lang"))
    rows = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("text_hash"), F.col("lang").alias("__declared"), F.col("source").alias("__host")
    )
    found = language.identify(rows, labels, model, ["doc_id", "text_hash"])
    kept = found.filter("kept").groupBy("doc_id", "text_hash").agg(F.min("language").alias("__language"))
    return _met(docs, kept).withColumn("lang", F.col("__language")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those made of nothing else go."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = cut.filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    found = minhash.near_duplicates(docs).filter("kept").select("doc_id", "text_hash").distinct()
    return _met(docs, found).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("__copies"))
    met = _met(docs, taken.filter(F.col("__copies") > 0))
    return met.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    texts = bpe.decoder(spark, path)

    def decoded(rows: pa.Table) -> pa.Table:
        return rows.append_column("decoded", texts(rows.column("ids")))

    keep = ["doc_id", "lang", "source"]
    return bpe.encode(docs, path, keep, decoded, "ids binary, n_tokens long, decoded string")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", encode),
]

#: Near-duplicate groups, the trigram model and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
