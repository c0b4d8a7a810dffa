"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of n-grams of one to three characters that both hold (presence, not counts),
divided by the root of the product of their numbers of n-grams. N-grams are hashed to a fixed number of columns.
Landmark documents give the Nystrom approximation; one-versus-rest kernel ridge regression is solved in its feature
space. Kernel against landmarks, whitening and regression are all linear in a text's presence row, so a batch of texts
is scored by one product of its sparse presence matrix with theirs, a columns-by-languages matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import add_columns, map_batches, named

#: Columns that n-grams are hashed to.
COLUMNS = 1 << 15
_LETTER = regex.compile(r"\p{L}")
#: Characters looked at together; bounds the memory for very long texts.
_BLOCK = 1 << 20
UNKNOWN = "und"
#: Texts that are scored by one product.
BATCH = 256


def presence(text: str) -> np.ndarray:
    """Columns of the n-grams of one to three characters that the lower-cased text holds, ascending.

    White space runs count as one space and digits as one sign; blocks of a long text overlap by two characters.
    """
    found = np.zeros(COLUMNS, bool)
    for at in range(0, max(1, len(text)), _BLOCK):
        codes = np.frombuffer(text[max(0, at - 2) : at + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[(codes >= 9) & (codes <= 13)] = 32
        codes[(codes >= 48) & (codes <= 57)] = 48
        if len(codes) > 1:
            codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        gram = codes + np.uint64(1)
        for order in range(3):
            if order:
                gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[order:] + np.uint64(order + 1)
            found[((gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64)] = True
    return np.flatnonzero(found)


#: Entries of the dense factor that a block of a product gathers, and landmarks whose presence is dense at once. Both are
#: 8 MB, as the model is fitted on the driver; any other numbers give the same model but for rounding.
_GATHERED, _LANDMARKS = 1 << 20, 32


def times(rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    """Presence rows, each divided by the root of its size, times a dense matrix with ``COLUMNS`` rows.

    The rows' columns one after another, and where each row begins, are the sparse matrix; it is multiplied in blocks of
    rows, so that what a block gathers of the dense matrix stays bounded.
    """
    size = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), dense.shape[1]))
    block = np.cumsum(size) // max(1, _GATHERED // max(1, dense.shape[1]))
    for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(block)) + 1):
        full = some[size[some] > 0]
        if len(full):
            begin = np.cumsum(size[full]) - size[full]
            out[full] = np.add.reduceat(dense[np.concatenate([rows[k] for k in full])], begin, axis=0)
    return out / np.sqrt(np.maximum(size, 1))[:, None]


def _presence_of(marks: list[np.ndarray]) -> np.ndarray:
    """The presence of landmarks as columns of a dense matrix."""
    basis = np.zeros((COLUMNS, len(marks)))
    for m, row in enumerate(marks):
        basis[row, m] = 1 / np.sqrt(max(len(row), 1))
    return basis


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: COLUMNS x languages: landmarks' presence, whitening and regression in one
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        return times([presence(t) for t in texts], self.weights) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability (soft maximum of five times the one-versus-rest scores) of each text."""
        whole = [t or "" for t in texts]
        if not self.languages or not whole:
            return [UNKNOWN] * len(whole), [0.0] * len(whole)
        s = 5 * self.scores(whole)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = [bool(_LETTER.search(t)) for t in whole]
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], [float(p[i, k]) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, known, strict=True))]


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = 256, ridge: float = 1e-3) -> LanguageModel:
    """Model from ``(lang, presence row)``. ``landmarks`` of them, dealt evenly over the languages and four of each at
    least, span the space; their presence is dense for ``_LANDMARKS`` of them at a time."""
    languages = tuple(sorted({c for c, _ in sample}))
    if not languages:
        return LanguageModel((), np.zeros((COLUMNS, 0)), np.zeros(0))
    rows = [r for _, r in sample]
    by: dict[str, list[int]] = {c: [] for c in languages}
    for k, (own, _) in enumerate(sample):
        by[own].append(k)
    marks = [k for c in languages for k in by[c][: max(4, landmarks // len(languages))]]
    blocks = [marks[k : k + _LANDMARKS] for k in range(0, len(marks), _LANDMARKS)]
    kernel = np.concatenate([times(rows, _presence_of([rows[k] for k in block])) for block in blocks], axis=1)
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ whiten
    place = {c: k for k, c in enumerate(languages)}
    owner = np.array([place[own] for own, _ in sample])
    target = np.full((len(rows), len(languages)), -1.0)
    target[np.arange(len(rows)), owner] = 1.0
    weight = (len(rows) / (len(languages) * np.bincount(owner)))[owner][:, None]  # languages count alike
    mean, goal = (features * weight).mean(axis=0) / weight.mean(), (target * weight).mean(axis=0) / weight.mean()
    features -= mean
    solution = np.linalg.solve(features.T @ (features * weight) + ridge * len(rows) * np.eye(features.shape[1]), features.T @ ((target - goal) * weight))
    by_landmark = whiten @ solution
    weights = np.zeros((COLUMNS, len(languages)))
    for k, block in enumerate(blocks):
        weights += _presence_of([rows[m] for m in block]) @ by_landmark[k * _LANDMARKS : k * _LANDMARKS + len(block)]
    return LanguageModel(languages, weights, goal - mean @ solution)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, sample: int = 20_000) -> LanguageModel:
    """Fit on labelled rows outside the held-out quarter.

    The sample is bounded: ``per_language`` rows of each label, fewer where all labels would pass ``sample`` rows
    together, but one of each at least; those whose ids hash lowest. So every label is learned, and only the number of
    different labels adds to the driver's memory. The hash makes the choice the same on every run; candidates are cut
    inside each task first. Null labels and texts without letters aren't learned from; rows that repeat may be drawn
    twice; texts of any length are read whole, in parts; an empty table gives a model that knows nothing.
    """
    labelled = docs.select(named(id_col).alias("id"), named(text).alias("text"), named(lang).alias("lang")).where(F.col("lang").isNotNull() & ~held_out("id") & F.col("text").rlike(r"\p{L}"))
    sizes = labelled.groupBy("lang").count().collect()  # one row a label
    if not sizes:
        return fit([])
    per_language = max(1, min(per_language, sample // len(sizes)))
    # about four times the rows that are needed pass the hash filter, so the sort is small at any size
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * per_language / r["count"])) for r in sizes], "lang string, share double")
    draw = (F.xxhash64(F.col("id").cast("string"), F.lit("language sample")).bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("draw")
    drawn = labelled.select("*", draw).join(F.broadcast(shares), "lang").where("draw < share")

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [presence(t).astype("<u2").tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["lang", "row", "draw"])

    # presence rows are at most 64 KB each, whatever the text
    rows = map_batches(drawn.select("lang", "text", "draw"), sketch, "lang string, row binary, draw double")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "row"))).where(F.col("rank") <= per_language)
    return fit([(r["lang"], np.frombuffer(r["row"], "<u2")) for r in ranked.orderBy("lang", "rank").select("lang", "row").collect()])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``<prefix>lang_pred`` and ``<prefix>score`` (double, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Only the
    text is read, whole at any length; equal scores go to the language that sorts first; rows with nulls elsewhere and
    repeated rows are scored alike; other columns stay, but one that has a new column's name is replaced; an empty table
    gives an empty result. The model grows with the labels alone and goes out with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        parts = [shared.value.predict(texts[k : k + BATCH]) for k in range(0, len(texts), BATCH)]
        return [pa.array([x for p in parts for x in p[0]], pa.string()), pa.array([x for p in parts for x in p[1]], pa.float64())]

    return add_columns(docs, text, run, {f"{prefix}lang_pred": "string", f"{prefix}score": "double"})
