"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, *without: str) -> list[Column]:
    """All columns of df but some, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns if c not in without]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, *kept: str) -> DataFrame:
    """df with columns named by their place, but for kept: mapInArrow takes no names with dots or backticks."""
    return df.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(df.columns)])


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system. Workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local sessions get one of
    their own; on a cluster that would be a folder that executors can't see, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written in the shared folder, so that what follows neither recomputes them nor loses them with an
    executor. drop() deletes those that are no longer needed. What a result that isn't written yet reads from stays
    until sweep(), or the end of the process."""

    #: Paths of all tables that are there, and their sessions.
    alive: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, shared_dir(spark), {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.drop(name)
        path = f"{self.root}/tidemill-{uuid.uuid4().hex}-{name}"
        Scratch.alive[path] = self.spark
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                path = self.paths.pop(name)
                Scratch.alive.pop(path, None)
                _delete(self.spark, path)


def sweep(keep: frozenset[str] | set[str] = frozenset()) -> None:
    """Deletes all tables of Scratch but those whose paths are in keep. To be called once their results are written,
    with the paths that were alive before."""
    for path in [p for p in Scratch.alive if p not in keep]:
        _delete(Scratch.alive.pop(path), path)


@atexit.register
def _at_exit() -> None:
    if SparkSession.getActiveSession() is not None:
        sweep()
