"""Reading and writing tables, and the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Formats that keep a frame's schema by themselves, and those that need it told.
SELF_DESCRIBING, PLAIN = ("parquet", "orc"), ("csv", "json", "xml")
#: Plain formats keep quotes and microseconds.
_TEXT = {"header": True, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "rowTag": "row"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set, a session on one machine gets a temporary folder; on a
    cluster executors would each write to their own disks, so that is an error.
    """
    context = spark.sparkContext
    place = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="quern-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder.

    Spark's cleaner deletes the files once the frame is out of use, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, place: str) -> bool:
    """Whether there is a file or folder of this name, in whatever store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, deleted at the end of the block; cut what is to outlive it with ``durable``."""
    place = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
    try:
        yield place
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the directory, as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write ``df``; a directory for each value of ``partition_by`` lets later reads skip files."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt in PLAIN:
        writer = writer.options(**_TEXT)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Write ``df`` as a table of the catalogue, bucketed and sorted by ``keys``, with one file a bucket.

    Tables with the same number of buckets are joined and grouped by their keys without an exchange.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read what ``save`` wrote; plain formats need the schema, so that none is inferred by a scan."""
    if fmt in PLAIN and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt)
    if fmt in PLAIN:
        reader = reader.options(**_TEXT)
    return (reader.schema(schema) if schema is not None else reader).load(path)
