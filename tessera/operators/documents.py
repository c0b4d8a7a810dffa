"""Document index: chunks, embeddings, incremental refresh and search joined back to sources.

Documents are ``(path, content binary)``; chunks ``(doc_id, path, offset, length, text binary)``; file state ``(path,
hash, doc_ids array<long>)``. Offsets and lengths are bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import snippet
from tessera.operators.ids import dense_ids
from tessera.operators.vectors import cosine_topk, cosine_topk_merged, normalize, uniform_dim
from tessera.session import written
from tessera.sources.splits import store_of

CHUNK_SIZE, OVERLAP, TOP, SNIPPET = 800, 100, 8, 200
Embedder = Callable[[list[str]], list[list[float]]]


class DocumentIndexError(ValueError):
    """An index, refresh or embedding that breaks a rule."""


def chunk_documents(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, offset, length, text)``: windows of ``chunk_size`` bytes that share ``overlap``, up to the one that
    reaches the end. Empty content has none."""
    if chunk_size <= 0 or not 0 <= overlap < chunk_size:
        raise DocumentIndexError("the chunk size is over 0 and the overlap under it")
    step = chunk_size - overlap
    size = F.octet_length("content")
    n = F.when(size <= chunk_size, 1).otherwise(F.ceil((size - chunk_size) / F.lit(step)) + 1).cast("int")
    rows = docs.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).where(size > 0)
    rows = rows.select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    text = F.substring("content", F.col("k") * step + 1, F.lit(chunk_size))
    return rows.select("path", (F.col("k") * step).cast("long").alias("offset"), F.octet_length(text).cast("long").alias("length"), text.alias("text"))


def assign_doc_ids(chunks: DataFrame, start: int = 0, order: Sequence[str] = ("path", "offset")) -> DataFrame:
    return dense_ids(chunks, list(order), "doc_id", start)


def hash_files(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.sha2("content", 256).alias("hash"))


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic embedder without a model: signed counts of hashed words, and one constant component."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            v[0] = 0.1
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % dim] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out

    return run


def embed(df: DataFrame, text: str, embedder: Embedder, into: str = "vector", batch: int = 64) -> DataFrame:
    """Adds a vector by ``embedder``, which gets lists of up to ``batch`` texts; an empty embedding fails the job."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [bytes(t).decode("utf-8", "replace") if isinstance(t, (bytes, bytearray)) else (t or "") for t in part]
            vectors = [v for k in range(0, len(texts), batch) for v in embedder(texts[k : k + batch])]
            if len(vectors) != len(texts) or not all(len(v) for v in vectors):
                raise ValueError("the embedder gave an empty embedding, or too few")
            yield pd.Series(vectors)

    return df.withColumn(into, run(F.col(text)))


@dataclass(frozen=True)
class DocumentIndex:
    manifest: DataFrame
    base: DataFrame
    delta: DataFrame | None
    files: DataFrame
    superseded: DataFrame
    root: str
    model: str
    chunk_size: int
    overlap: int
    dim: int
    next_doc_id: int


def manifest_from_chunks(chunks: DataFrame, embed_text: bool = True) -> DataFrame:
    text = F.col("text").cast("string") if embed_text else F.lit(None).cast("string")
    return chunks.select("doc_id", "path", "offset", "length", text.alias("text"))


def build_manifest(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A dry run: the manifest alone, of dimension 0."""
    return manifest_from_chunks(assign_doc_ids(chunk_documents(docs, chunk_size, overlap)))


def state_from_chunks(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(path, hash, doc_ids)`` of every file; one without chunks has no ids, so it isn't taken for new at a refresh."""
    ids = chunks.groupBy("path").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    return hashes.join(ids, "path", "left").select("path", "hash", F.coalesce("doc_ids", F.array().cast("array<long>")).alias("doc_ids"))


def build_index(docs: DataFrame, embedder: Embedder, root: str = "", model: str = "", chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DocumentIndex:
    chunks = assign_doc_ids(chunk_documents(docs, chunk_size, overlap))  # stored by then
    if chunks.isEmpty():
        raise DocumentIndexError("no chunks")
    vectors = written(normalize(embed(chunks.select("doc_id", "text"), "text", embedder).select("doc_id", "vector")), "vectors")
    files = written(state_from_chunks(chunks, hash_files(docs)), "files")
    none = chunks.select("doc_id").limit(0)
    return DocumentIndex(manifest_from_chunks(chunks), vectors, None, files, none, root, model, chunk_size, overlap, uniform_dim(vectors), chunks.count())


def plan_refresh(state: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, action)`` for files that were deleted, changed or added; both sides are ``(path, hash)``."""
    both = state.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    action = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def refresh_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def supersede(files: DataFrame, plan: DataFrame, superseded: DataFrame) -> DataFrame:
    """``(doc_id)``: ids of deleted and changed files, with those before."""
    gone = files.join(plan.where(F.col("action") != "added"), "path", "left_semi").select(F.explode("doc_ids").alias("doc_id"))
    return superseded.select("doc_id").unionByName(gone).distinct()


def check_refresh(index: DocumentIndex, root: str, model: str, chunk_size: int, overlap: int, dim: int | None = None) -> None:
    """Raise before any work if the index was made otherwise, has no manifest, or its vectors aren't of its dimension."""
    for name, was, now in (("root", index.root, root), ("model", index.model, model), ("chunk size", index.chunk_size, chunk_size), ("overlap", index.overlap, overlap), ("dimension", index.dim, index.dim if dim is None else dim)):
        if was != now:
            raise DocumentIndexError(f"the {name} was {was!r} and is {now!r}")
    if index.manifest.isEmpty() and index.files.isEmpty():
        raise DocumentIndexError("the index has no state")
    stored = uniform_dim(index.base if index.delta is None else index.base.unionByName(index.delta))
    if stored is not None and stored != index.dim:
        raise DocumentIndexError(f"the vectors have dimension {stored} and the index {index.dim}")


def apply_refresh(index: DocumentIndex, docs: DataFrame, embedder: Embedder, root: str | None = None, model: str | None = None) -> tuple[DocumentIndex, DataFrame]:
    """The index after the files changed, and the plan; an empty plan leaves it as it is.

    The guards, the embedder's dimension on a text of one space among them, come before all work.
    Changed files are chunked before added ones, each in path order, with ids from ``next_doc_id`` on. The manifest that
    comes of it holds no texts.
    """
    check_refresh(index, index.root if root is None else root, index.model if model is None else model, index.chunk_size, index.overlap, len(embedder([" "])[0]))
    hashes = hash_files(docs)
    plan = written(plan_refresh(index.files, hashes), "plan")
    if plan.isEmpty():
        return index, plan
    work = docs.join(plan.where("action != 'deleted'"), "path")
    actions = plan.select("path", (F.col("action") == "added").cast("int").alias("added"))
    chunks = chunk_documents(work, index.chunk_size, index.overlap).join(actions, "path")
    chunks = assign_doc_ids(chunks, index.next_doc_id, ("added", "path", "offset")).drop("added")  # stored by then
    n = chunks.count()
    delta = index.delta
    if n:
        fresh = written(normalize(embed(chunks.select("doc_id", "text"), "text", embedder).select("doc_id", "vector")), "delta")
        if uniform_dim(fresh) != index.dim:
            raise DocumentIndexError("the new vectors have another dimension")
        delta = fresh if delta is None else delta.unionByName(fresh)
    superseded = written(supersede(index.files, plan, index.superseded), "superseded")
    manifest = index.manifest.withColumn("text", F.lit(None).cast("string")).join(plan, "path", "left_anti").unionByName(manifest_from_chunks(chunks, embed_text=False))
    files = index.files.join(plan, "path", "left_anti").unionByName(state_from_chunks(chunks, hashes.join(plan.where("action != 'deleted'"), "path", "left_semi")))
    return replace(index, manifest=written(manifest, "manifest"), delta=delta, files=written(files, "files"), superseded=superseded, next_doc_id=index.next_doc_id + n), plan


def compact(index: DocumentIndex, docs: DataFrame, embedder: Embedder) -> DocumentIndex:
    """A full rebuild with dense new ids."""
    return build_index(docs, embedder, index.root, index.model, index.chunk_size, index.overlap)


def validate_full(manifest: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``(check, ok, detail)``: dimension, number, and ids that are exactly 0 to n - 1 on both sides."""
    ids = lambda df: df.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.countDistinct("doc_id").alias("d"))
    dense = lambda c: (F.col(f"{c}.n") == F.col(f"{c}.d")) & ((F.col(f"{c}.n") == 0) | ((F.col(f"{c}.lo") == 0) & (F.col(f"{c}.hi") == F.col(f"{c}.n") - 1)))
    dims = vectors.agg(F.count_if(F.size("vector") != dim).alias("bad"))
    one = ids(manifest).select(F.struct("*").alias("m")).join(ids(vectors).select(F.struct("*").alias("v"))).join(dims)  # single rows
    checks = F.array(
        F.struct(F.lit("dim").alias("check"), (F.col("bad") == 0).alias("ok"), F.col("bad").cast("string").alias("detail")),
        F.struct(F.lit("count").alias("check"), (F.col("m.n") == F.col("v.n")).alias("ok"), F.concat_ws(" ", "m.n", "v.n").alias("detail")),
        F.struct(F.lit("dense ids").alias("check"), (dense("m") & dense("v")).alias("ok"), F.concat_ws(" ", "m.lo", "m.hi", "m.d").alias("detail")),
    )
    return one.select(F.inline(checks))


def validate_merged(manifest: DataFrame, base: DataFrame, delta: DataFrame | None, superseded: DataFrame, dim: int) -> DataFrame:
    """``(violation, doc_id)``: superseded ids in the manifest, ids twice, ids without a vector, unlike dimensions."""
    vectors = base if delta is None else base.unionByName(delta)
    say = lambda df, what: df.select(F.lit(what).alias("violation"), "doc_id")
    return (
        say(manifest.join(superseded, "doc_id", "left_semi"), "superseded")
        .unionByName(say(manifest.groupBy("doc_id").count().where("count > 1"), "duplicate"))
        .unionByName(say(manifest.join(vectors.select("doc_id"), "doc_id", "left_anti"), "no vector"))
        .unionByName(say(vectors.where(F.size("vector") != dim), "dimension"))
    )


def index_report(index: DocumentIndex) -> DataFrame:
    """``(check, ok, detail)`` of all parts of the index."""
    count = lambda name, df: df.agg(F.count("*").cast("string").alias("detail")).select(F.lit(name).alias("check"), F.lit(True).alias("ok"), "detail")
    out = count("base vectors", index.base).unionByName(count("files", index.files)).unionByName(count("superseded", index.superseded)).unionByName(count("manifest", index.manifest))
    if index.delta is not None:
        out = out.unionByName(count("delta vectors", index.delta))
        bad = validate_merged(index.manifest, index.base, index.delta, index.superseded, index.dim).agg(F.count("*").alias("n"))
        return out.unionByName(bad.select(F.lit("merged").alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail")))
    return out.unionByName(validate_full(index.manifest, index.base, index.dim))


def read_ranges(root: str, ranges: list[tuple[str, int, int]]) -> list[bytes]:
    """The bytes of ``(path, offset, size)`` below ``root``, and no others; a file that ends before is an error."""
    store, base = store_of(root)
    out = []
    for path, offset, size in ranges:
        with store.open_input_file(f"{base}/{path}") as f:
            f.seek(offset)
            data = f.read(size)
        if len(data) < size:
            raise DocumentIndexError(f"{path} ends before {offset + size} bytes")
        out.append(data)
    return out


def read_snippets(rows: DataFrame, root: str, snippet_len: int = SNIPPET, into: str = "snippet") -> DataFrame:
    """``doc_id, score, path, offset, length`` of a few hits with the first ``snippet_len`` bytes of their chunks, read from
    the files below ``root`` in tasks: ``snippet_len`` bytes a row at most. A hit without a path has none."""
    columns = ["doc_id", "score", "path", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pylist()
            known = [k for k, r in enumerate(own) if r["path"] is not None]
            got = dict(zip(known, read_ranges(root, [(own[k]["path"], own[k]["offset"], min(own[k]["length"], snippet_len)) for k in known]), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([got.get(k) for k in range(len(own))], pa.binary())], [*columns, "bytes"])

    return rows.select(*columns).mapInArrow(run, "doc_id long, score double, path string, offset long, length long, bytes binary").withColumnRenamed("bytes", into)


def hits_with_sources(hits: DataFrame, manifest: DataFrame, snippet_len: int = SNIPPET, docs: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """``(doc_id, score, path, offset, snippet)`` of a few hits; one that the manifest lacks keeps an empty path.

    Snippets come from the manifest's texts; where it has none, from ``docs`` at the chunk's offset, or from the files
    below ``root`` by reads of no more than the snippets' bytes. A cut inside a character is replaced.
    """
    # hits are the right side of a search: k rows, so they are broadcast and the manifest isn't moved
    found = F.broadcast(hits).join(manifest, "doc_id", "left") if docs is None else manifest.join(F.broadcast(hits), "doc_id").join(docs.select("path", "content"), "path", "left")
    if docs is not None:
        size = F.least(F.col("length"), F.lit(snippet_len)).cast("int")
        text = F.coalesce(snippet("text", snippet_len), F.substring("content", F.col("offset").cast("int") + 1, size).cast("string"))
        found = F.broadcast(hits).join(found.drop("score"), "doc_id", "left")
    elif root:
        # a hit's text may be there, or be read; k rows, so they are stored and met twice
        found = written(found, "hits")
        read = read_snippets(found.where("text IS NULL"), root, snippet_len).select("doc_id", "score", "path", "offset", F.col("snippet").cast("string").alias("own"))
        found = found.where("text IS NOT NULL").select("doc_id", "score", "path", "offset", snippet("text", snippet_len).alias("own")).unionByName(read)
        text = F.col("own")
    else:
        text = snippet("text", snippet_len)
    return found.select("doc_id", "score", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce(text, F.lit("")).alias("snippet")).orderBy(F.desc("score"), "doc_id")


def search(index: DocumentIndex, query: Sequence[float], k: int = TOP, snippet_len: int = SNIPPET, docs: DataFrame | None = None) -> DataFrame:
    """Hits with snippets from the manifest's texts, else from ``docs``, else from the files below the index's root."""
    if index.delta is None and index.superseded.isEmpty():
        hits = cosine_topk(index.base, query, k)
    else:
        hits = cosine_topk_merged(index.base, index.delta, index.superseded, query, k)
    return hits_with_sources(hits, index.manifest, snippet_len, docs, index.root if docs is None else None)


def search_text(index: DocumentIndex, spark: SparkSession, text: str, embedder: Embedder, k: int = TOP) -> DataFrame:
    return search(index, embedder([text])[0], k)
