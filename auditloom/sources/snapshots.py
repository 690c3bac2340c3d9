"""Choice of one snapshot where a source keeps several."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how a dated snapshot file ends.
SNAPSHOT_STAMP = r"_(\d{8})\.csv$"
#: Stamp of the canonical copy: after all dates.
CANONICAL = "99999999"


def latest_snapshot(df: DataFrame, snapshot: str) -> DataFrame:
    """Rows of the newest snapshot only; snapshots are full copies and must not be united."""
    newest = df.agg(F.max(snapshot).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(snapshot) == F.col("_newest")).drop("_newest")


def with_snapshot_stamp(df: DataFrame, file_column: str = "source_file", name: str = "snapshot") -> DataFrame:
    """Stamp from the file name; a file without one is the canonical copy and sorts last."""
    stamp = F.regexp_extract(F.col(file_column), SNAPSHOT_STAMP, 1)
    return df.withColumn(name, F.when(stamp == "", F.lit(CANONICAL)).otherwise(stamp))


class MissingSnapshot(LookupError):
    pass


def newest_files(
    spark: SparkSession, path: str | list[str], snapshot: str | None = None, stamp: str = SNAPSHOT_STAMP
) -> list[str]:
    """The files of the newest dated snapshot under ``path``, or of the ``snapshot`` asked for.

    Only names are looked at, so files of other snapshots are never opened. A file without a stamp is the canonical copy
    and is newer than any dated one. Raises ``MissingSnapshot`` when there is none.
    """
    stamps: dict[str, list[str]] = {}
    for name in spark.read.format("binaryFile").load(path).inputFiles():  # the driver's own listing
        found = re.search(stamp, name)
        stamps.setdefault(found[1] if found else CANONICAL, []).append(name)
    wanted = snapshot or max(stamps, default=None)
    if wanted not in stamps:
        raise MissingSnapshot(f"{path}: snapshot {wanted}, there are {sorted(stamps)}")
    return sorted(stamps[wanted])
