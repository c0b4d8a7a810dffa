"""Tables of an index: vectors in Parquet, manifest and state as JSON documents in versioned folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaObject
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.vectors import MAX_DIM, MIN_DIM, VectorError, normalize, uniform_dim
from tessera.session import written
from tessera.sources.splits import MOST_TASKS, store_of

MANIFEST = "version int, dim int, model string, chunk_size int, overlap int, root string, records array<struct<doc_id: bigint, path: string, `offset`: bigint, length: bigint, text: string>>"
STATE = "version int, next_doc_id bigint, chunk_size int, overlap int, model string, root string, files map<string, struct<hash: string, doc_ids: array<bigint>>>, superseded_doc_ids array<bigint>"
VERSION = 1
#: Bytes of a row group of a vector table; commits that stay.
ROW_GROUP, KEPT = 16 << 20, 32


def write_vectors(vectors: DataFrame, path: str, row_group_bytes: int = ROW_GROUP) -> None:
    """Normalised vectors as Parquet; no vectors or unlike dimensions are an error.

    Rows are dealt and sorted by id, so files and row groups hold ranges of ids; the ranges are kept in ``_ranges`` beside
    them, one row a row group, for ``lookup``.
    """
    if uniform_dim(vectors) is None:
        raise VectorError("no vectors")
    made = written(normalize(vectors).select("doc_id", "vector", "norm"), "normalised")  # range partitioning looks twice
    made.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", row_group_bytes).parquet(path)
    spark = vectors.sparkSession

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    footer = parquet.ParquetFile(f).metadata
                rows = [(name, g, s.min, s.max, footer.row_group(g).num_rows) for g in range(footer.num_row_groups) if (s := footer.row_group(g).column(0).statistics) is not None and s.has_min_max]
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "row_group", "low", "high", "n"), r, strict=True)) for r in rows], _RANGES)

    names = spark.createDataFrame([(i.base_name,) for i in _part_files(path)], "file string")  # a name a file
    names.repartition(max(1, min(names.count(), MOST_TASKS))).mapInArrow(ranges, "file string, row_group int, low long, high long, n long").coalesce(1).write.parquet(f"{path}/_ranges")


_RANGES = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])


def _part_files(path: str) -> list[fs.FileInfo]:
    store, base = store_of(path)
    return [i for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File and i.base_name.endswith(".parquet")]


def wanted_groups(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """``(file, row_group, doc_id)``: for each of the ids ``(doc_id)`` the row groups whose range holds it. A task reads the
    ranges, 40 bytes a row group, and searches them for its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(f"{path}/_ranges")
        known = parquet.read_table(base, filesystem=store).sort_by([("low", "ascending"), ("high", "ascending")])
        low, high = np.asarray(known.column("low")), np.maximum.accumulate(np.asarray(known.column("high"))) if len(known) else np.zeros(0, np.int64)
        for batch in batches:
            own = np.asarray(batch.column(0))
            begin, end = np.searchsorted(high, own), np.searchsorted(low, own, "right")
            n = np.maximum(end - begin, 0)
            at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            some = known.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([some.column("file").combine_chunks(), some.column("row_group").combine_chunks(), pa.array(np.repeat(own, n))], ["file", "row_group", "doc_id"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().mapInArrow(run, "file string, row_group int, doc_id long")


def lookup(spark: SparkSession, path: str, ids: DataFrame, columns: Sequence[str] = ("doc_id", "vector", "norm")) -> DataFrame:
    """The rows of a vector table for the given ids: only row groups in whose range one lies are opened, each once, and only
    the columns asked for are read."""
    kinds = {"doc_id": "long", "vector": "array<float>", "norm": "float"}

    def run(group: pa.Table) -> pa.Table:
        store, base = store_of(path)
        with store.open_input_file(f"{base}/{group.column('file')[0].as_py()}") as f:
            rows = parquet.ParquetFile(f).read_row_group(group.column("row_group")[0].as_py(), columns=[*dict.fromkeys(["doc_id", *columns])])
        return rows.filter(pc.is_in(rows.column("doc_id"), group.column("doc_id").combine_chunks())).select(list(columns))

    return wanted_groups(spark, path, ids).groupBy("file", "row_group").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def contains(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The given ids that have a vector in the table."""
    return lookup(spark, path, ids, ["doc_id"]).distinct()


def read_vectors(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    vectors = spark.read.parquet(path)
    if check:
        bad = vectors.where((F.size("vector") < MIN_DIM) | (F.size("vector") > MAX_DIM) | F.exists("vector", lambda x: x.isNull())).count()
        if bad or uniform_dim(vectors) is None:
            raise VectorError(f"{bad} bad vectors, or none at all")
    return vectors


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The folder of a table's commits and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the commits there are, the latest last."""
    folder, store = _folder(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(folder)) if store.exists(folder) else []


def commit(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the current one: an empty file is created whose name has a number above all others and the version's
    name. Nothing is deleted or renamed that a reader may look for, and a file without content can't be read half-written.
    Writers that take one number at the same time are in the order of their versions' names. Commits ``KEPT`` numbers back
    are removed; their versions stay for those who still read them, until ``drop_versions``."""
    folder, store = _folder(spark, path)
    store.mkdirs(folder)
    known = _commits(spark, path)
    number = int(known[-1].partition(".")[0]) + 1 if known else 0
    store.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{number:020}.{version}"), False).close()
    for old in known:
        if int(old.partition(".")[0]) <= number - KEPT:
            store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, old), False)


def current(spark: SparkSession, path: str) -> str:
    """Folder of the current version."""
    known = _commits(spark, path)
    if not known:
        raise FileNotFoundError(f"{path} has no version")
    return f"{path}/{known[-1].partition('.')[2]}"


def drop_versions(spark: SparkSession, path: str) -> None:
    """Remove all versions but the current one, when nobody reads them any more."""
    kept = current(spark, path).rpartition("/")[2]
    _, store = _folder(spark, path)
    for s in store.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        if s.getPath().getName().startswith("v-") and s.getPath().getName() != kept:
            store.delete(s.getPath(), True)


def _versioned(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a new version, then make it the current one; readers see the old version or the new one."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{name}")
    commit(spark, path, name)


def write_manifest(spark: SparkSession, records: DataFrame, path: str, dim: int, model: str, chunk_size: int, overlap: int, root: str, embed_text: bool = False) -> None:
    """One JSON line a record, with the scalars on each, so that it is written and read in parallel."""
    text = F.col("text") if embed_text else F.lit(None).cast("string")
    rows = records.select(F.lit(VERSION).alias("version"), F.lit(dim).alias("dim"), F.lit(model).alias("model"), F.lit(chunk_size).alias("chunk_size"), F.lit(overlap).alias("overlap"), F.lit(root).alias("root"), F.array(F.struct("doc_id", "path", "offset", "length", text.alias("text"))).alias("records"))
    _versioned(spark, rows, path)


def read_manifest(spark: SparkSession, path: str, versioned: bool = True) -> DataFrame:
    """``(doc_id, path, offset, length, text)``; unknown keys are skipped; another version is an error.

    ``versioned`` false reads ``path`` as a plain JSON document.
    """
    raw = spark.read.schema(MANIFEST).json(current(spark, path) if versioned else path, multiLine=not versioned)
    checked = raw.withColumn("records", F.when(F.col("version") == VERSION, F.col("records")).otherwise(F.raise_error(F.lit("unknown manifest version"))))
    return checked.select(F.inline("records"))


def write_state(spark: SparkSession, files: DataFrame, superseded: DataFrame, path: str, next_doc_id: int, chunk_size: int, overlap: int, model: str, root: str) -> None:
    """One JSON line a file ``(path, hash, doc_ids)`` and one a superseded id."""
    scalars = [F.lit(VERSION).alias("version"), F.lit(next_doc_id).cast("long").alias("next_doc_id"), F.lit(chunk_size).alias("chunk_size"), F.lit(overlap).alias("overlap"), F.lit(model).alias("model"), F.lit(root).alias("root")]
    of_files = files.select(*scalars, F.create_map("path", F.struct("hash", "doc_ids")).alias("files"), F.array().cast("array<long>").alias("superseded_doc_ids"))
    of_ids = superseded.select(*scalars, F.create_map().cast("map<string,struct<hash:string,doc_ids:array<bigint>>>").alias("files"), F.array("doc_id").alias("superseded_doc_ids"))
    _versioned(spark, of_files.unionByName(of_ids), path)


def read_state(spark: SparkSession, path: str, versioned: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """``(path, hash, doc_ids)``, ``(doc_id)`` of the superseded, and the scalars."""
    raw = spark.read.schema(STATE).json(current(spark, path) if versioned else path, multiLine=not versioned)
    one = raw.select("version", "next_doc_id", "chunk_size", "overlap", "model", "root").first()
    scalars = one.asDict() if one else {}
    if scalars and scalars["version"] != VERSION:
        raise ValueError(f"unknown state version {scalars['version']}")
    files = raw.select(F.explode("files").alias("path", "f")).select("path", "f.hash", "f.doc_ids")
    return files, raw.select(F.explode("superseded_doc_ids").alias("doc_id")).distinct(), scalars
