"""Removal of repeated passages by overlapping windows of three lines.

Windows run over the lines that hold a word. A window met before, in an earlier document or further
up in the same one, is a repeat; the lines of all repeats are merged and removed. Only hashes are
shuffled to find repeats; the texts move once, to meet the positions to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import BLANKS
from auditloom.operators.persisting import materialize

WINDOW = 3


def line_windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, p0, p1, h, g): first and last line and two 64-bit hashes of every window."""
    lines = F.filter(
        F.transform(
            F.split("text", "\n"),
            lambda line, at: F.struct(
                at.alias("p"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"),
                (F.btrim(line, F.lit(BLANKS)) != "").alias("worded"),
            ),
        ),
        lambda line: line["worded"],
    )
    held = keyed.select("doc_id", "text_hash", lines.alias("lines")).filter(F.size("lines") >= window)
    shifted = [F.slice("lines", i + 1, F.size("lines")).alias(f"l{i}") for i in range(window)]
    zipped = held.select("doc_id", "text_hash", *shifted).select(
        "doc_id", "text_hash", F.explode(F.arrays_zip(*[f"l{i}" for i in range(window)])).alias("w")
    )
    # The shifted lists are shorter, so the last windows hold nulls.
    whole = zipped.filter(F.col(f"w.l{window - 1}").isNotNull())
    return whole.select(
        "doc_id", "text_hash", F.col("w.l0.p").alias("p0"), F.col(f"w.l{window - 1}.p").alias("p1"),
        F.xxhash64(*[f"w.l{i}.h" for i in range(window)]).alias("h"),
        F.xxhash64(*[f"w.l{i}.g" for i in range(window)]).alias("g"),
    )


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, gone): positions of the lines to remove, for documents that lose any."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    windows = materialize(line_windows(keyed, window), "windows")
    place = F.struct("doc_id", "text_hash", "p0")
    # One row per task and window before the shuffle, however often a passage repeats.
    repeats = materialize(
        windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).drop("n"),
        "repeats",
    )
    later = windows.join(repeats, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.select("doc_id", "text_hash", F.explode(F.sequence("p0", "p1")).alias("p"))
    return covered.groupBy("doc_id", "text_hash").agg(F.collect_set("p").alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of text, plus n_lines and n_removed.

    Passages count as repeated when ``window`` consecutive lines with a word are equal; lines without a
    word are passed over, and go with the lines around them. The first occurrence, by doc_id (null
    first) and position, stays. Texts of fewer lines, empty texts and null stay as they are (null: no
    lines). Rows that repeat both id and text are one document: the same lines go in all of them. Columns
    named n_lines or n_removed are replaced; all other columns are kept, whatever their names.
    """
    # What is gone grows with the texts, so it is shuffled at every size, never broadcast.
    gone = materialize(repeated_lines(docs, window), "gone").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone")
    ).hint("merge")
    keyed = docs.drop("n_lines", "n_removed").withColumn("__text_hash", F.xxhash64("text"))
    met = keyed.join(
        gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left"
    )
    split = met.withColumn("__lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    cleaned = F.concat_ws("\n", F.transform(left, lambda at: F.get(F.col("__lines"), at)))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return split.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cleaned).alias("text") if c == "text" else F.col(f"`{c}`")
          for c in names],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
