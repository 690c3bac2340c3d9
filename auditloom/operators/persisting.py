"""Written intermediate results: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"
#: The JVM compiles no method of more bytes; it would interpret each row of a stage whose code is one.
COMPILED_BYTES = 8000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets a temporary one."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors reach")
    folder = tempfile.mkdtemp(prefix="auditloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """What runs inside generates code for whole stages only where the JVM compiles it, and operator by operator elsewhere."""
    before = spark.conf.get(METHOD_SETTING)
    spark.conf.set(METHOD_SETTING, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_SETTING, before)


def write_scratch(df: DataFrame, name: str) -> str:
    """Write the frame to the shared folder and return where."""
    path = scratch_path(df.sparkSession, name)
    with compiled(df.sparkSession):
        df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once to the shared folder and read it back.

    Compared with recomputing, every later use reads the same rows (needed where a partition
    number becomes data) and the planner knows the written size when it chooses a join.
    """
    path = write_scratch(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``materialize``, and the number of rows, counted while they are written."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    path = write_scratch(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]
