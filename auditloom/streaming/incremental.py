"""Resumable landing: every run takes the files that arrived since the last one, exactly once.

``land_new_files`` appends. ``merge_new_files`` keeps the newest version of every key in a table that is dealt
into parts by a hash of the key; a batch rewrites only the parts that it touches.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.sources.works_json import BROKEN, land_pages, page_options, page_schema


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType, file_format: str = "parquet",
    name_filter: str | None = None, **options: str,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format).options(**options)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(folder)


def stream_work_pages(
    spark: SparkSession, folder: str, one_page_per_file: bool = True, name_filter: str = "*.json.gz"
) -> DataFrame:
    """Works of newly arrived pages as they land, one row per work, and a row for every broken page (``land_pages``)."""
    pages = stream_files(spark, folder, page_schema(), "json", name_filter, **page_options(one_page_per_file, strict=False))
    return land_pages(pages.select("results", BROKEN, F.col("_metadata.file_path").alias("source_file")))


def land_new_files(
    stream: DataFrame, target: str, checkpoint: str, key: str | None = None,
    event_time: str | None = None, keep_for: str | None = None,
) -> None:
    """Process everything new, then stop. The checkpoint is the resume state.

    With ``key``, a row whose key has landed before, in this or an earlier run, is left out. The keys seen
    are streaming state, kept with the checkpoint and split by key over the tasks. With ``event_time`` and
    ``keep_for`` (an interval) keys are forgotten once they are older than that; without, never.

    The file sink commits each batch in its own log, so a run that died half way is repeated
    without doubling rows, and files seen by an earlier run are not read again.
    """
    if key and event_time and keep_for:
        stream = stream.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark([key])
    elif key:
        stream = stream.dropDuplicates([key])
    query = (
        stream.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


#: Parts of a merged table unless its first batch says otherwise.
PARTS = 64
_MERGES = "number long, source string, batch long, parts int, folders map<int, string>"


def _merges(spark: SparkSession, target: str) -> list[Row]:
    """The merges so far, last one first; one row per batch, bounded by the batches that ran."""
    try:
        return spark.read.schema(_MERGES).parquet(f"{target}/log").orderBy(F.desc("number")).collect()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def newest_per_key(rows: DataFrame, key: str, version: str, preferred: str | None = None) -> DataFrame:
    """One row per key, that of the highest version; combined before the shuffle, so a hot key is one row per task.

    Equal versions: the higher ``preferred`` column first, then by a hash of the row. Rows without a key are all
    kept, a null version is the lowest.
    """
    facts = [c for c in rows.columns if c != preferred]
    order = F.struct(F.col(version).isNotNull(), F.col(version), *([F.col(preferred)] if preferred else []), F.xxhash64(*facts))
    keyed = rows.filter(F.col(key).isNotNull())
    best = keyed.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*facts), order).alias("_row")).select("_row.*")
    return best.unionByName(rows.filter(F.col(key).isNull()).select(*facts))


def merge_batch(batch: DataFrame, target: str, source: str, batch_id: int, key: str, version: str, parts: int = PARTS) -> bool:
    """Merge one batch into ``target``; False if the log says that it was merged before.

    The parts that the batch touches are written anew to a folder of the batch, then one row is appended to the log,
    which names the folder of every part. A batch that ends before that row leaves the table as it was and is
    simply run again; one that ends after it is recognised by its source and number.
    """
    spark = batch.sparkSession
    done = _merges(spark, target)
    if any(r["source"] == source and r["batch"] >= batch_id for r in done):
        return False
    folders = dict(done[0]["folders"]) if done else {}
    parts = done[0]["parts"] if done else parts
    dealt = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*batch.columns))  # rows without a key are spread
    part = F.pmod(dealt, F.lit(parts)).cast("int")
    arrived = batch.withColumns({"_part": part, "_new": F.lit(True)})
    touched = [r["_part"] for r in arrived.select("_part").distinct().collect()]  # ``parts`` numbers at most
    if touched:
        held = [f"{folders[p]}/_part={p}" for p in touched if p in folders]
        rows = arrived.drop("_part")
        if held:
            before = spark.read.schema(batch.schema).parquet(*held).select(*batch.columns)
            rows = rows.unionByName(before.withColumn("_new", F.lit(False)))
        folder = f"{target}/data/{batch_id:08d}-{uuid.uuid4().hex[:8]}"
        merged = newest_per_key(rows, key, version, "_new").withColumn("_part", part)
        merged.repartition(min(len(touched), parts), "_part").write.partitionBy("_part").parquet(folder)
        folders |= {p: folder for p in touched}
    number = done[0]["number"] + 1 if done else 1
    _commit(spark, target, (number, source, batch_id, parts, folders))
    return True


def _commit(spark: SparkSession, target: str, row: tuple) -> None:
    spark.createDataFrame([row], _MERGES).coalesce(1).write.mode("append").parquet(f"{target}/log")


def merge_new_files(stream: DataFrame, target: str, checkpoint: str, key: str, version: str, parts: int = PARTS) -> None:
    """Merge everything new into ``target``, then stop: the newest version of every key wins.

    A later version of a key that landed before takes its place, an older one is dropped. The keys are not
    streaming state: what is known of them is the table itself.
    """
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, target, checkpoint, number, key, version, parts) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_merged(spark: SparkSession, target: str) -> DataFrame:
    """The merged table as of its last batch; a reader that has opened it goes on while later batches merge."""
    done = _merges(spark, target)
    if not done or not done[0]["folders"]:
        raise LookupError(f"nothing was merged into {target}")
    return spark.read.parquet(*[f"{folder}/_part={p}" for p, folder in sorted(done[0]["folders"].items())])
