"""Near-duplicate documents by min-max hashing, with exact confirmation on full shingle sets.

Every permutation gives two signature values, the smallest and the largest hash, so half the hash evaluations band as
many values. Documents with equal shingle sets are one class from the start. Classes are sorted by band value and cut
where range partitioning cuts them, so a value that many classes share is spread over tasks. First every class is
compared with the first of its value in its cut, which costs one comparison each. After that only classes that still are
in different components are compared: in each value those apart from its largest component with all, in blocks of
bounded size, by short sketches of the signatures first and by full sets where the sketches leave a link possible. So a
large group of copies is never paired out and no link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import as_row, discard, from_row, map_batches, named, stored, workspace
from tessera.llm.graph import components

#: Bands of signature values, and values in a band. A pair with Jaccard 0.85 meets in none with probability 7e-9, one with 0.8 with 3e-6.
BANDS, ROWS = 32, 5
#: Classes in a block of the comparison that follows the stars.
BLOCK = 256
#: How far the share of equal sketch bytes may lie under the least similarity before a pair is ruled out. A linked pair
#: falls below with probability 2e-9 at 0.8 and 1e-10 at 0.85, which is under that of meeting in no band.
MARGIN = 0.2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(known: dict[bytes, int], word: bytes) -> int:
    h = known.get(word)
    if h is None:
        if len(known) > 400_000:
            known.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            known[word] = h
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words_each: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of ``words_each`` words, ascending.

    A to Z are lowered; words are split at ASCII white space. Fewer words make one shingle; no word gives an empty set.
    """
    # on bytes, lowering and splitting know ASCII only
    h = np.array([_word_hash(known, w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - words_each + 1)
    out = np.full(n, min(len(h), words_each), np.uint64)
    for k in range(min(words_each, len(h))):
        out = _mix(out * _ODD + h[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Smallest and largest of ``multiplier * x + offset`` (mod 2**64) for each permutation, in turn."""
    low = np.empty(len(multipliers), np.uint64)
    high = np.empty(len(multipliers), np.uint64)
    low[:], high[:] = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    for at in range(0, len(shingles), 4_096):  # bounds the memory for very long texts
        values = multipliers[:, None] * shingles[None, at : at + 4_096] + offsets[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    n = -(-BANDS * ROWS // 2)
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def sketches(docs: DataFrame, id_col: str, text: str, words_each: int) -> DataFrame:
    """``id, text_key`` (hash of the text), ``n_shingles``, ``set_key`` (binary; null without words), ``bands`` (array of
    long) and ``sketch`` (a byte of each signature value)."""
    kind = docs.schema[id_col].dataType.simpleString()
    a, b = _permutations()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        n, keys, bands, short = [], [], [], []
        for t in batch.column(2).to_pylist():
            s = shingle_set(t, words_each, known)
            n.append(len(s))
            if len(s):
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                values = signature(s, a, b)[: BANDS * ROWS]
                bands.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) - (1 << 63) for k, row in enumerate(values.reshape(BANDS, ROWS))])
                short.append((values >> np.uint64(24)).astype(np.uint8).tobytes())
            else:
                keys.append(None)
                bands.append(None)
                short.append(None)
        made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["id", "text_key", "n_shingles", "set_key", "bands", "sketch"])

    rows = docs.select(named(id_col).alias("id"), F.xxhash64(named(text)).alias("text_key"), named(text).alias("text"))
    return map_batches(rows, run, f"id {kind}, text_key long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _sets(texts: DataFrame, words_each: int) -> DataFrame:
    """``(rep, items)`` from ``(rep, text)``: the full sets, as little-endian 64-bit values."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words_each, known).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["rep", "items"])

    return map_batches(texts, run, "rep long, items binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for ascending distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """``(u, v)`` of the pairs ``(u, v, u_items, v_items)`` that are linked."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.select("u", "v", "u_items", "v_items"), run, "u long, v long")


def _in_reach(n: np.ndarray, m: np.ndarray, same: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, with ``same`` equal sketch bytes, may be linked."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (same >= BANDS * ROWS * (percent / 100 - MARGIN))


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """``(u, v)`` of the pairs ``(u, v, u_n, v_n, u_sketch, v_sketch)`` that may be linked."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), -1) for k in (4, 5))
        keep = _in_reach(np.asarray(batch.column(2)), np.asarray(batch.column(3)), (x == y).sum(axis=1), percent) if len(batch) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.select("u", "v", "u_n", "v_n", "u_sketch", "v_sketch"), run, "u long, v long")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted ``(band, value, rep)``: the rows whose value others of the cut have too, with the first of these as
    ``center`` and the number ``seg`` of a run of at most ``BLOCK`` of them. The cut's first and last row stay in any
    case, marked ``edge``, as their value may go on in a neighbouring cut."""
    part = TaskContext.get().partitionId() << 32
    held: np.ndarray | None = None  # the last row so far: whether another follows it isn't known yet
    center, place, opened = 0, 0, False

    def batch_of(rows: np.ndarray, centers: np.ndarray, places: np.ndarray, keep: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(keep)
        columns = {"band": pa.array(rows[0, at].astype(np.int32)), "value": rows[1, at], "seg": part + places[at] // BLOCK, "rep": rows[2, at], "center": centers[at], "edge": edge[at]}
        return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        n = rows.shape[1]
        fresh = np.concatenate([[held is None], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        centers = np.where(start >= 0, rows[2, np.maximum(start, 0)], center)
        places = np.where(start >= 0, np.arange(n) - start, place + np.arange(n))
        edge = np.zeros(n, bool)
        edge[0] = not opened
        more = np.concatenate([~fresh[1:], [False]])
        keep = edge | more | (places > 0)
        keep[-1] = False
        opened = opened or n > 1
        yield batch_of(rows, centers, places, keep, edge)
        held, center, place = rows[:, -1:], int(centers[-1]), int(places[-1])
    if held is not None:
        yes = np.ones(1, bool)
        yield batch_of(held, np.array([center]), np.array([place]), yes, yes)


_BLOCK_ROW = "band int, value long, `left` int, `right` int, block int, rep long, comp long, bands array<long>"


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of the left and of the right block; the same for a block with itself."""
    block = np.asarray(group.column("block"))
    return np.flatnonzero(block == group.column("left")[0].as_py()), np.flatnonzero(block == group.column("right")[0].as_py())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(len(column), -1)


def _block_candidates(percent: int):  # noqa: ANN202
    """The rows of a pair of blocks that may have a link between components, by sketches."""

    def run(group: pa.Table) -> pa.Table:
        left, right = _sides(group)
        n, comp, bands, band = np.asarray(group.column("n")), np.asarray(group.column("comp")), _matrix(group.column("bands")), group.column("band")[0].as_py()
        short = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(n), -1)
        hit = np.zeros(len(n), bool)
        for at in range(0, len(left), 32):
            some = left[at : at + 32]
            may = (comp[some][:, None] != comp[right]) & _in_reach(n[some][:, None], n[right], (short[some][:, None, :] == short[right]).sum(axis=2), percent)
            rows, cols = np.nonzero(may)
            first = (bands[some[rows]] == bands[right[cols]]).argmax(axis=1) == band  # a pair counts in the first band it shares
            hit[some[rows[first]]] = True
            hit[right[cols[first]]] = True
        return group.select(["band", "value", "left", "right", "block", "rep", "comp", "bands"]).take(pa.array(np.flatnonzero(hit)))

    return run


def _block_links(percent: int):  # noqa: ANN202
    """Links that join components within a pair of blocks, by full sets."""

    def run(group: pa.Table) -> pa.Table:
        left, right = _sides(group)
        items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        rep, comp, bands, band = group.column("rep").to_pylist(), group.column("comp").to_pylist(), _matrix(group.column("bands")), group.column("band")[0].as_py()
        parent = {c: c for c in comp}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        us, vs = [], []
        for i in left.tolist():
            for j in right.tolist():
                a, b = root(comp[i]), root(comp[j])
                # compared in the first band they share
                if a != b and np.argmax(bands[i] == bands[j]) == band and linked(items[i], items[j], percent):
                    parent[a] = b
                    us.append(rep[i])
                    vs.append(rep[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _links(docs: DataFrame, id_col: str, text: str, words_each: int, percent: int, classes: DataFrame) -> DataFrame:
    """``(node, component)`` of the classes ``(rep, id, text_key, n, bands, sketch)`` that are linked with another."""
    placed = classes.select("rep", F.posexplode("bands").alias("band", "value")).select("band", "value", "rep")
    met = stored(placed.repartitionByRange("band", "value", "rep").sortWithinPartitions("band", "value", "rep").mapInArrow(_segments, "band int, value long, seg long, rep long, center long, edge boolean"), "met")
    # two rows a cut, so no value has more of them than twice the number of cuts
    across = met.where("edge").groupBy("band", "value").agg(F.min("center").alias("u"), F.collect_set("center").alias("vs")).select("u", F.explode("vs").alias("v")).where("u != v")
    stars = met.where("rep != center").select(F.col("center").alias("u"), F.col("rep").alias("v")).unionByName(across).distinct()
    short = lambda name: classes.select(F.col("rep").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
    likely = stored(_likely(stars.join(short("v"), "v").join(short("u"), "u"), percent), "likely")

    def sets_of(needed: DataFrame) -> DataFrame:
        """Full sets of the classes ``(rep)``, from the text of the first row of each."""
        rows = needed.join(classes.select("rep", "id", "text_key"), "rep")
        keyed = docs.select(named(id_col).alias("id"), F.xxhash64(named(text)).alias("text_key"), named(text).alias("text"))
        # rows alike in id and text fall together where they meet the class, before sets are made
        return stored(_sets(keyed.join(rows, ["id", "text_key"]).dropDuplicates(["id", "text_key"]).select("rep", "text"), words_each), "sets")

    sets = sets_of(likely.select(F.col("u").alias("rep")).union(likely.select("v")).distinct())
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("items").alias(f"{name}_items"))
    links = _confirmed(likely.join(side("v"), "v").join(side("u"), "u"), percent)
    comps = stored(components(links), "components")
    # values whose classes aren't all of one component: their largest one, and the numbers of classes apart and in it
    with_comp = stored(met.join(comps, F.col("rep") == F.col("node"), "left").select("band", "value", "seg", "rep", F.coalesce("component", "rep").alias("comp")), "met-components")
    sizes = with_comp.groupBy("band", "value", "comp").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("band", "value").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("m"), (F.sum("k") - F.max("k")).alias("r")).where("r > 0")
    # a value with many classes has many segments, so the join with its classes has no hot key
    of_segment = stored(with_comp.select("band", "value", "seg").distinct().join(mixed, ["band", "value"]), "mixed")
    rest = with_comp.join(of_segment, ["band", "value", "seg"]).withColumn("apart", F.col("comp") != F.col("main"))
    n_apart, n_main, spread = F.ceil(F.col("r") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int"), F.xxhash64("rep")
    rest = rest.withColumn("block", F.when(F.col("apart"), F.pmod(spread, n_apart)).otherwise(n_apart + F.pmod(spread, n_main)).cast("int")).withColumn("last", F.when(F.col("apart"), n_apart + n_main - 1).otherwise(n_apart - 1))
    rest = rest.join(classes.select("rep", "n", "bands", "sketch"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rest = rest.select("band", "value", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "rep", "comp", "bands", "n", "sketch")
    key = ["band", "value", "left", "right"]
    close = stored(rest.groupBy(*key).applyInArrow(_block_candidates(percent), _BLOCK_ROW), "close")
    if close.isEmpty():
        return comps
    missing = close.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti")
    more = stored(close.join(sets.unionByName(sets_of(missing)), "rep").groupBy(*key).applyInArrow(_block_links(percent), "u long, v long"), "more")
    return comps if more.isEmpty() else components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def _verdicts(docs: DataFrame, id_col: str, text: str, words_each: int, percent: int) -> DataFrame:
    """``id, text_key, n_shingles, first, stays`` of every row that has an id.

    ``first`` is the smallest id of the row's component; ``stays`` is true for the rows of the document that stands for
    it: of its class with that id, the first by ``text_key``. Both are null without words. What the search stores on the
    way is removed when the table is written.
    """
    spark = docs.sparkSession
    with workspace(spark, "minhash") as place:
        own = stored(sketches(docs, id_col, text, words_each).where("id IS NOT NULL"), "sketches")
        by_set = own.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        # numbers are made when the table is written, and read from it ever after
        classes = stored(by_set.select(F.monotonically_increasing_id().alias("rep"), "set_key", "one.id", "one.text_key", "n", "bands", "sketch"), "classes")
        final = stored(_links(docs, id_col, text, words_each, percent, classes), "labels")
        labelled = classes.select("rep", "set_key", "id", "text_key").join(final, F.col("rep") == F.col("node"), "left")
        # one row a component; stored, as is the other side, so that Spark can split a component that has many classes
        leads = stored(labelled.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "set_key", "rep")).alias("lead")).select("component", F.col("lead.id").alias("first"), F.col("lead.rep").alias("lead")), "leads")
        joined = stored(labelled, "labelled").join(leads, "component", "left")
        of_class = stored(joined.select("set_key", F.coalesce("first", "id").alias("first"), F.when(F.coalesce(F.col("lead") == F.col("rep"), F.lit(True)), F.col("text_key")).alias("kept_key")), "class-verdicts")
        rows = own.select("id", "text_key", "n_shingles", "set_key").join(of_class, "set_key", "left")
        stays = F.when(F.col("set_key").isNotNull(), F.coalesce((F.col("id") == F.col("first")) & (F.col("text_key") == F.col("kept_key")), F.lit(False)))
        work = rows.select("id", "text_key", "n_shingles", "first", stays.alias("stays"))
    out = stored(work, "near-duplicates")
    discard(spark, place)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_each: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row.

    Rows whose shingle sets have 100 * intersection >= ``percent`` * union are linked; ``component_id`` is the smallest
    id reachable, ``kept`` whether it is the row's own. A row without words is linked with nothing. A row with a null
    id takes part in no component (null) and is kept. Repeated rows are all returned, alike; rows that repeat an id with
    other texts follow each its own text. Texts of any length are read whole, in parts of bounded memory. Other columns
    are left out; an empty table gives an empty result.
    """
    found = _verdicts(docs, id_col, text, words_each, percent)
    component = F.coalesce("first", "id")
    rows = found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))
    unnamed = sketches(docs.where(named(id_col).isNull()), id_col, text, words_each)
    return rows.unionByName(unnamed.select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest id.

    Rows that repeat an id count as documents of their own if their texts differ; of those of one component with the
    smallest id one stays, the first by its set and text. Of rows alike in id and text one stays, the first by a hash of
    the other columns. Rows with a null id and rows without words are in no component and all stay. Texts of any length
    are compared whole. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    found = _verdicts(docs, id_col, text, words_each, percent)
    stays = found.where("stays").select(F.col("id").alias("stay_id"), F.col("text_key").alias("stay_key")).distinct()
    rows = docs.select(as_row(docs.columns), named(id_col).alias("id"), named(text).alias("text"))
    lone = F.col("id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows alike are cut to one within each task before they meet
    order = Window.partitionBy("id", "text_key").orderBy(F.xxhash64("__row"))
    firsts = rows.where(~lone).select("__row", "id", F.xxhash64("text").alias("text_key")).withColumn("k", F.row_number().over(order)).where("k = 1")
    kept = firsts.join(stays, (F.col("id") == F.col("stay_id")) & (F.col("text_key") == F.col("stay_key")), "left_semi")
    return from_row(kept.select("__row").unionByName(rows.where(lone).select("__row")), {}, docs.columns)
