"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session whose tasks all run in the driver's process gets one where it is unset; a cluster must set it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="causeway-")
        context.setCheckpointDir(found)
    return found


#: Rows and bytes that tasks of this session hand to Python at a time; texts and packs are long, and few of them fill a task's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most BATCH_ROWS rows, or what first passes BATCH_BYTES, to Python at a time, which changes no result."""
    rows = int(spark.conf.get(_BATCH))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    held = spark.conf.get(_BYTES).removesuffix("b")
    if not (held.isdigit() and 0 < int(held) <= BATCH_BYTES):
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/causeway/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_told(df: DataFrame, **told: Column) -> tuple[DataFrame, dict]:
    """stored(df), and aggregates of its rows by name.

    They are read from the table: an observation of the write would leave its manager in the session, with which the
    functions of pyspark.ml models can't be sent to tasks any more.
    """
    out = stored(df)
    return out, out.agg(*[c.alias(n) for n, c in told.items()]).first().asDict()


def shuffled(df: DataFrame) -> DataFrame:
    """df, so that a join of it shuffles both sides. For tables with a row per node or edge: Spark takes the size of their files,
    in which ids take a byte or two, for the size of their rows, and would broadcast millions of them through the driver."""
    return df.hint("merge")


def still_there(df: DataFrame) -> bool:
    """Whether the folders of all files that df reads exist."""
    java = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    settings = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folders = [java.Path(f).getParent() for f in df.inputFiles()]
    return all(f.getFileSystem(settings).exists(f) for f in folders)


def shared_folder(spark: SparkSession) -> Path:
    """A new folder of the shared folder for files that the driver writes and tasks read, which needs a mounted file system."""
    scheme, _, rest = shared_dir(spark).rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"single files need a mounted shared folder, not {scheme}:")
    out = Path("/" + rest.lstrip("/")) / "causeway" / f"files-{uuid.uuid4().hex}"
    out.mkdir(parents=True)
    return out
