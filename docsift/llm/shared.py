"""Tables and files in the folder that every executor of the cluster can see."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where none is set, a temporary folder is used if the driver is also the only executor
    (a local master); on a cluster RuntimeError is raised, as executors wouldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="docsift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, block_bytes: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts the lineage.

    For tables with wide rows: Parquet looks at sizes only after 100 rows, and a reader holds up to
    4,096 rows of a row group at once. With block_bytes (as compressed) or block_rows row groups end there.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if block_bytes or block_rows:
        writer = writer.option("parquet.page.size.row.check.min", 1)
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    if block_rows:
        writer = writer.option("parquet.block.row.count.limit", block_rows)
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._docsift_path = path
    return table


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` made and nothing reads any more; other tables stay."""
    if path := vars(df).get("_docsift_path"):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (or of a local path), for use in a Python worker."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if uri.startswith(("s3a://", "s3n://")):  # Hadoop's names for one store
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri)
