"""Reading the tables, and tables that are written on the way in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of ours that are still there, and their sessions.
_made: dict[str, SparkSession] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """The table as a stream of its files. The table may be a file or a folder. By default all files that are there come
    in one batch, so that no row is late, in whatever order the files hold them; with files_at_once the rows that are
    older than the watermark by then are dropped, as in any stream."""
    source = spark.readStream.schema(read(spark, sf_dir, name).schema)
    if files_at_once:
        source = source.option("maxFilesPerTrigger", files_at_once)
    return source.parquet(f"{sf_dir}/{name}.parquet*")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. Where that is unset, local sessions get
    one of their own; on a cluster that would be a folder that executors can't see, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
        found = spark.sparkContext.getCheckpointDir()
    path = f"{found.rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written in the shared folder, so that what follows neither computes it again nor loses it with an executor."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Deletes what stored() and the streams have written. To be called once the results are read."""
    while _made:
        path, spark = _made.popitem()
        delete(spark, path)


@atexit.register
def _at_exit() -> None:
    if SparkSession.getActiveSession() is not None:
        clear()
