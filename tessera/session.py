"""The shared folder of a session, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_RUNS_ALONE = re.compile(r"local(\[.*)?$")
_OWN: list[str] = []
#: Sub-folder that tables are written to while a ``workspace`` is open.
_INSIDE: ContextVar[str] = ContextVar("inside", default="")


class SharedFolderError(RuntimeError):
    """The session names no folder that driver and executors share."""


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` with its scheme.

    Where it is unset, a local session, whose driver runs all tasks itself, gets a temporary folder; a cluster is refused,
    as a folder of one machine would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _RUNS_ALONE.match(spark.sparkContext.master):
            raise SharedFolderError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        return _OWN[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, inside the open workspace if there is one."""
    inside = _INSIDE.get()
    return f"{inside or f'{shared_folder(spark)}/{spark.sparkContext.applicationId}'}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from a Parquet table in the shared folder, computed once; it survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession, label: str) -> Iterator[str]:
    """Tables written inside go to one folder, whose path is given; ``discard`` it when no result reads it any more."""
    path = new_path(spark, label)
    mark = _INSIDE.set(path)
    try:
        yield path
    finally:
        _INSIDE.reset(mark)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder; results that read it end with it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Remove all that this application wrote to the shared folder."""
    discard(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
