"""Token counts of whole texts, with huge ones cut into overlapping chunks that are spliced exactly.

The chunks of a huge text are encoded with offsets, in different tasks. Two neighbours are spliced at a pre-token
boundary in their overlap that both show. That is proven stable: the byte-level pattern never looks behind, so from a
true boundary on the encoding depends on the following text alone; and the left chunk shows true boundaries wherever
the next character and the longest special string lie inside it. Where no common boundary exists, the text is encoded
again with four times the chunk and overlap, until the splice holds or one chunk covers the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from tessera.llm._shared import map_batches, named, stored
from tessera.llm._vocab import byte_level_encoder


@lru_cache(maxsize=2)
def _with_offsets(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def _cut(pending: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``(row, part, start, last, chunk)`` of each text of ``(row, text)``; neighbours share ``overlap`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = range(0, max(1, len(text) - overlap), chunk - overlap)
                for k in range(0, len(starts), 16):
                    some = starts[k : k + 16]
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row] * len(some), pa.int64()), "part": pa.array(range(k, k + len(some)), pa.int64()), "start": pa.array(some, pa.int64()),
                        "last": pa.array([s == starts[-1] for s in some], pa.bool_()), "chunk": pa.array([text[s : s + chunk] for s in some], pa.string()),
                    })

    return pending.mapInArrow(run, "row long, part long, start long, last boolean, chunk string")


def _boundaries(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Per chunk its token count, and the pre-token boundaries in its overlaps with the tokens before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _with_offsets(path)
        longest = max([1, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
        for batch in batches:
            out: dict[str, list] = {"row": [], "part": [], "last": [], "total": [], "head": [], "head_n": [], "tail": [], "tail_n": []}
            for r in batch.to_pylist():
                e = tokenizer.encode(r["chunk"], add_special_tokens=False)
                words, offsets, size, start = e.word_ids, e.offsets, len(r["chunk"]), r["start"]
                at = [(offsets[k][0], k) for k in range(1, len(words)) if words[k] != words[k - 1]]
                head = [(start + p, k) for p, k in at if p <= overlap] if r["part"] else []
                tail = [] if r["last"] else [(start + p, k) for p, k in at if size - overlap <= p <= size - longest]
                for name, value in (("row", r["row"]), ("part", r["part"]), ("last", r["last"]), ("total", len(words)), ("head", [p for p, _ in head]), ("head_n", [k for _, k in head]), ("tail", [p for p, _ in tail]), ("tail_n", [k for _, k in tail])):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.bool_() if k == "last" else pa.int64() if k in ("row", "part", "total") else pa.list_(pa.int64())) for k, v in out.items()})

    return chunks.mapInArrow(run, "row long, part long, last boolean, total long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")


def _splice(group: pa.Table) -> pa.Table:
    """``(row, n_tokens)``; null where some neighbours share no boundary."""
    parts = sorted(group.to_pylist(), key=lambda r: r["part"])
    total: int | None = 0
    begin = 0
    for left, right in zip(parts, parts[1:], strict=False):
        before = dict(zip(right["head"], right["head_n"], strict=True))
        shared = next(((n, before[p]) for p, n in reversed(list(zip(left["tail"], left["tail_n"], strict=True))) if p in before), None)
        if shared is None:
            total = None
            break
        total += shared[0] - begin
        begin = shared[1]
    if total is not None:
        total += parts[-1]["total"] - begin
    return pa.table({"row": pa.array([parts[0]["row"]], pa.int64()), "n_tokens": pa.array([total], pa.int64())})


def count_huge(texts: DataFrame, path: str, chunk: int = 16_384, overlap: int = 1_024) -> DataFrame:
    """``(row, n_tokens)`` of the stored ``texts`` ``(row, text)``, where ``row`` is unique."""
    found: DataFrame | None = None
    pending = texts
    while True:
        chunks = _cut(pending, chunk, overlap).repartition("row", "part")
        counted = stored(_boundaries(chunks, path, overlap).groupBy("row").applyInArrow(_splice, "row long, n_tokens long"), "spliced")
        done, failed = counted.where(F.col("n_tokens").isNotNull()), counted.where(F.col("n_tokens").isNull())
        found = done if found is None else found.unionByName(done)
        if failed.isEmpty():
            return found
        pending, chunk, overlap = texts.join(failed, "row", "left_semi"), 4 * chunk, 4 * overlap


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 1_024, huge: int = 32_768, chunk: int = 16_384, overlap: int = 1_024) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` of every row.

    Counts are those of the ``tokenizers`` library for the file at ``path``, without added begin or end tokens; special
    strings inside texts count as the library reads them. A null text counts as empty. Null and repeated ids and
    repeated rows stay as they are; other columns are left out; an empty table gives an empty result. Texts over
    ``huge`` characters are cut if the file is of the byte-level kind, else encoded whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    t = F.coalesce(named(text), F.lit(""))
    rows = docs.select(named(id_col).alias("id"), t.alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = byte_level_encoder(path)
        size = own.dtype.itemsize
        counts = [len(own.ids(x)) // size for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    sized = lambda df: df.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    schema = f"id {kind}, n_bytes long, n_tokens long"
    if byte_level_encoder(path).plain:
        counted = map_batches(sized(rows.where(F.length("text") <= huge)), run, schema)
        large = stored(rows.where(F.length("text") > huge).withColumn("row", F.monotonically_increasing_id()), "huge")
        if not large.isEmpty():
            spliced = count_huge(large.select("row", "text"), path, chunk, overlap)
            counted = counted.unionByName(large.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes")).join(spliced, "row").select("id", "n_bytes", "n_tokens"))
    else:
        counted = map_batches(sized(rows), run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
