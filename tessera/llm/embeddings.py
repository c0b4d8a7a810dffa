"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t are at most ``eps = sqrt(2 - 2t)`` apart. Their outlooks, the projections on the leading
principal axes and the length of what these leave, are unit vectors too and at most as far apart. Vectors are sorted by
their grid cells of side ``eps`` on the foremost axes and cut into sequence intervals (blocks); a block's rows are put in
the order of leaves, by halving boxes across their widest side. For every pair of blocks that isn't provably distant, the leaves that come within ``eps`` of one on the
other side are joined: sequences are halved recursively, distant halves skipped and the rest compared, outlooks alone
first, and full vectors in double precision for the leaves where those leave a link possible. Tasks return link counts
and a spanning forest of their links, never all pairs. Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, map_batches, new_path, stored, workspace
from tessera.llm._shared import named as column
from tessera.llm.graph import components

#: Vectors in a block, most in a leaf, and those at which a leaf is split no more; principal axes, and those of the grid; most groups of blocks.
BLOCK, LEAF, LEAST, AXES, GRID, GROUPS = 4_096, 256, 32, 24, 8, 128
#: Least blocks of a share of the sequence, if it can have them; most tasks that pairs of shares are dealt to.
SHARE, PAIR_TASKS = 8, 1_024
#: Most dimensions whose whole covariance is summed.
WHOLE = 256
#: Allowances for single-precision outlooks: in their products and in squared distances of boxes.
_IN_PRODUCT, _IN_SQUARE = 1e-5, 1e-4


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim) if len(column) else np.empty((0, dim))


def _outlooks(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, AXES + 1)


def _moments(classes: DataFrame, dim: int, basis: np.ndarray) -> np.ndarray:
    """``C @ basis`` of the covariance ``C`` of all unit vectors ``payload`` of dimension ``dim``. Every task sums its
    vectors' products; the sums, as many as the basis has entries, are added up by Spark."""
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, mean = np.zeros((dim, width)), 0, np.zeros(dim)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total, n, mean = total + x.T @ (x @ basis), n + len(x), mean + x.sum(axis=0)
        if n:
            values = np.concatenate([total.ravel(), mean, [n]])
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(values)), pa.int64()), "x": pa.array(values)})

    sums = np.zeros(dim * width + dim + 1)
    for r in classes.where(F.col("dim") == dim).select("payload").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        sums[r["k"]] = r["x"]
    n, mean = max(sums[-1], 1), sums[dim * width : -1] / max(sums[-1], 1)
    return sums[: dim * width].reshape(dim, width) / n - np.outer(mean, mean @ basis)


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """The ``AXES`` leading principal axes (columns) of all unit vectors ``payload`` of dimension ``dim``.

    Up to ``WHOLE`` dimensions from the covariance itself. Beyond, it is multiplied by a random basis of a few more columns
    than axes, and then looked at within the span of the product: two scans, and sums that grow with the dimension, not
    with its square. Any orthonormal axes are right; near the principal ones they tell more apart.
    """
    if dim <= WHOLE:
        inner, span = _moments(classes, dim, np.eye(dim)), np.eye(dim)
    else:
        span, _ = np.linalg.qr(_moments(classes, dim, np.random.default_rng(dim).normal(size=(dim, AXES + 8))))
        inner = span.T @ _moments(classes, dim, span)
    _, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return (span @ vectors)[:, ::-1][:, :AXES]


def outlook(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections of the unit vectors on the axes, and the length of the rest; vectors of another dimension than the
    axes' use their own first coordinates. Products of outlooks are never under those of the unit vectors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    seen = unit @ axes if x.shape[1] == axes.shape[0] else unit[:, :AXES]
    rest = np.sqrt(np.maximum(0, 1 - (seen * seen).sum(axis=1, keepdims=True)))
    return np.concatenate([np.pad(seen, ((0, 0), (0, AXES - seen.shape[1]))), rest], axis=1).astype(np.float32)


def arrange(near: np.ndarray, eps: float) -> list[np.ndarray]:
    """The places of a block's outlooks, leaf by leaf: boxes are halved across their widest side until they hold ``LEAST``
    rows or fewer, or ``LEAF`` or fewer and have a diagonal of ``2 * eps`` at most."""
    leaves, open_ = [], [np.arange(len(near))]
    while open_:
        rows = open_.pop()
        box = near[rows]
        low, high = box.min(axis=0), box.max(axis=0)
        width = high - low
        if len(rows) <= LEAST or len(rows) <= LEAF and (width * width).sum() <= 4 * eps * eps:
            leaves.append(rows)
            continue
        axis = int(width.argmax())
        below = box[:, axis] <= (low[axis] + high[axis]) / 2 if width[axis] > 0 else np.arange(len(rows)) < len(rows) // 2
        if below.all():  # the middle of two neighbouring numbers may be the larger one
            below = box[:, axis] < high[axis]
        open_ += [rows[~below], rows[below]]
    return leaves


def _apart(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Squared distances of boxes, by pairs of the last-but-one axes' entries."""
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return (gap * gap).sum(axis=-1)


class _Forest:
    """Components of the rows met so far, by their places."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[ra] = rb
            self.edges.append((a, b))


def join_sequences(px: np.ndarray, py: np.ndarray, own: bool, eps2: float, compare: Callable[[int, int, int, int], None]) -> None:
    """Call ``compare`` for the pairs of intervals of ``LEAF`` rows at most that aren't provably distant. Sequences are
    halved recursively; with ``own`` both are one, and a pair of its intervals is met once."""

    def halves(lo: int, hi: int) -> list[tuple[int, int]]:
        middle = lo + -(-(hi - lo) // 2)
        return [(lo, middle), (middle, hi)] if hi - lo > LEAF else [(lo, hi)]

    def visit(i: tuple[int, int], j: tuple[int, int]) -> None:
        if i[0] >= i[1] or j[0] >= j[1]:
            return
        x, y = px[slice(*i)], py[slice(*j)]
        if _apart(x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0)) > eps2:
            return
        if max(i[1] - i[0], j[1] - j[0]) <= LEAF:
            compare(*i, *j)
            return
        for a in halves(*i):
            for b in halves(*j):
                if not own or a[0] <= b[0]:
                    visit(a, b)

    visit((0, len(px)), (0, len(py)))


def _possible(px: np.ndarray, py: np.ndarray, i0: int, i1: int, j0: int, j1: int, own: bool, threshold: float) -> np.ndarray:
    near = px[i0:i1] @ py[j0:j1].T >= threshold - _IN_PRODUCT
    return np.triu(near, 1) if own and i0 == j0 else near


def sift(px: np.ndarray, py: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either side whose outlooks leave a link possible; ``py`` is None for a block with itself."""
    own = py is None
    other = px if own else py
    hit_x = np.zeros(len(px), bool)
    hit_y = hit_x if own else np.zeros(len(other), bool)

    def compare(i0: int, i1: int, j0: int, j1: int) -> None:
        near = _possible(px, other, i0, i1, j0, j1, own, threshold)
        hit_x[i0:i1] |= near.any(axis=1)
        hit_y[j0:j1] |= near.any(axis=0)

    join_sequences(px, other, own, 2 - 2 * threshold + _IN_SQUARE, compare)
    return hit_x, hit_y


def join_blocks(x: np.ndarray, y: np.ndarray | None, px: np.ndarray, py: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Link counts of either side, weighted by the other side's copies, and a spanning forest.

    ``y`` is None for a block with itself. Places of the second side follow those of the first.
    """
    own = y is None
    a = x / np.linalg.norm(x, axis=1, keepdims=True)
    b = a if own else y / np.linalg.norm(y, axis=1, keepdims=True)
    shift = 0 if own else len(x)
    count_x = np.zeros(len(x), np.int64)
    count_y = count_x if own else np.zeros(len(b), np.int64)
    forest = _Forest(len(x) + (0 if own else len(b)))

    def compare(i0: int, i1: int, j0: int, j1: int) -> None:
        near = _possible(px, py, i0, i1, j0, j1, own, threshold)
        rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return
        sub = near[np.ix_(rows, cols)] & (a[rows + i0] @ b[cols + j0].T >= threshold)
        if not sub.any():
            return
        count_x[rows + i0] += sub @ ny[cols + j0]
        count_y[cols + j0] += nx[rows + i0] @ sub
        rows, cols, sub = rows[sub.any(axis=1)], cols[sub.any(axis=0)], sub[np.ix_(sub.any(axis=1), sub.any(axis=0))]
        # labels of the leaf's components: the smallest place among the linked rows, spread until nothing changes
        label, none = rows + i0, np.iinfo(np.int64).max
        while True:
            over = np.where(sub, label[:, None], none).min(axis=0)
            new = np.minimum(label, np.where(sub, over[None, :], none).min(axis=1))
            if (new == label).all():
                break
            label = new
        for k, m in zip((rows + i0).tolist(), label.tolist(), strict=True):
            forest.join(k, m)
        for k, m in zip((cols + j0 + shift).tolist(), over.tolist(), strict=True):
            forest.join(k, m)

    join_sequences(px, py, own, 2 - 2 * threshold + _IN_SQUARE, compare)
    return count_x, count_y, forest.edges


def leaves_of(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """``block, leaf, dim, size, lo, hi, reps, copies, near, data``: the classes ``(rep, n, payload, dim)`` in grid
    order, cut into blocks and leaves; a block's number has that of its partition, and so of its place, in front."""

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = np.asarray(batch.column(3))
        near = np.empty((len(batch), AXES + 1), np.float32)
        for dim in np.unique(dims).tolist():
            some = np.flatnonzero(dims == dim)
            near[some] = outlook(_matrix(batch.column(2).take(pa.array(some)), dim), axes)
        cells = np.floor(near[:, :GRID] / eps).astype(np.int32)
        made = [pa.array([x.tobytes() for x in near], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * GRID, pa.int32()), pa.array(cells.ravel()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "near", "cells"])

    parts = max(1, -(-classes.count() // (4 * BLOCK)))
    # stored: range partitioning looks at its rows twice
    placed = stored(map_batches(classes, place, "rep long, n long, payload binary, dim int, near binary, cells array<int>"), "placed")
    order = ["dim", *(F.get("cells", F.lit(k)) for k in range(GRID)), "rep"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("cells")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            nonlocal serial, held
            near = np.frombuffer(b"".join(r[4] for r in held), np.float32).reshape(-1, AXES + 1)
            rows = []
            for k, places in enumerate(arrange(near, eps)):
                own, box = [held[p] for p in places.tolist()], near[places]
                rows.append({
                    "block": serial, "leaf": k, "dim": own[0][3], "size": len(own), "lo": box.min(axis=0).tobytes(), "hi": box.max(axis=0).tobytes(),
                    "reps": np.array([r[0] for r in own], np.int64).tobytes(), "copies": np.array([r[1] for r in own], np.int64).tobytes(), "near": box.tobytes(), "data": b"".join(r[2] for r in own),
                })
            serial, held = serial + 1, []
            return pa.RecordBatch.from_pylist(rows, _LEAF_SCHEMA)

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and (len(held) == BLOCK or held[0][3] != r[3]):
                    yield emit()
                held.append(r)
        if held:
            yield emit()

    return stored(ordered.mapInArrow(cut, "block long, leaf int, dim int, size int, lo binary, hi binary, reps binary, copies binary, near binary, data binary"), "leaves")


_LEAF_SCHEMA = pa.schema([("block", pa.int64()), *((c, pa.int32()) for c in ("leaf", "dim", "size")), *((c, pa.binary()) for c in ("lo", "hi", "reps", "copies", "near", "data"))])


def _near_pairs(left: pa.Table, right: pa.Table, own: bool, eps2: float) -> Iterator[pa.RecordBatch]:
    """``(l, r, block, leaf)`` of two shares' blocks: blocks whose boxes come within ``eps`` are looked into, leaf by leaf."""
    box = lambda t, name: np.array(t.column(name).to_pylist(), np.float32).reshape(-1, AXES + 1)
    lo, hi, dims, blocks = box(left, "least"), box(left, "most"), np.asarray(left.column("dim")), left.column("block").to_pylist()
    lo2, hi2, dims2, blocks2 = box(right, "least"), box(right, "most"), np.asarray(right.column("dim")), right.column("block").to_pylist()
    leaves = lambda t, k: tuple(np.frombuffer(t.column(name)[k].as_py(), np.float32).reshape(-1, AXES + 1) for name in ("lo", "hi"))
    for i, l in enumerate(blocks):
        close = (_apart(lo[i], hi[i], lo2, hi2) <= eps2) & (dims2 == dims[i])
        for j in np.flatnonzero(close).tolist():
            r = blocks2[j]
            if own and r < l:
                continue
            (a, b), (c, d) = leaves(left, i), leaves(right, j)
            near = np.stack([_apart(x, y, c, d) <= eps2 for x, y in zip(a, b, strict=True)])
            found = [(l, k) for k in np.flatnonzero(near.any(axis=1)).tolist()] + [(r, k) for k in np.flatnonzero(near.any(axis=0)).tolist() if l != r]
            if found:
                yield pa.RecordBatch.from_pydict({"l": pa.array([l] * len(found), pa.int64()), "r": pa.array([r] * len(found), pa.int64()), "block": pa.array([b for b, _ in found], pa.int64()), "leaf": pa.array([k for _, k in found], pa.int32())})


def near_leaves(leaves: DataFrame, eps: float) -> DataFrame:
    """``(l, r, block, leaf)``: for pairs of blocks the leaves of either that come within ``eps`` of one of the other.

    A tree of boxes is gone down: shares of the sequence, blocks, leaves. Boxes of shares, ``GROUPS`` at most, meet in the
    driver; a task takes pairs of shares within ``eps``, reads either's boxes from the shared folder, 200 bytes a leaf,
    and looks into those blocks alone that come within ``eps``. So no pair of blocks is a row unless it is near.
    """
    eps2, spark = eps * eps + _IN_SQUARE, leaves.sparkSession

    def boxes(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        lo, hi = _outlooks(group.column("lo")), _outlooks(group.column("hi"))
        return pa.table({
            "block": group.column("block").slice(0, 1), "part": group.column("part").slice(0, 1), "dim": group.column("dim").slice(0, 1), "lo": pa.array([lo.tobytes()], pa.binary()), "hi": pa.array([hi.tobytes()], pa.binary()),
            "least": pa.array([lo.min(axis=0).tolist()], pa.list_(pa.float32())), "most": pa.array([hi.max(axis=0).tolist()], pa.list_(pa.float32())),
        })

    path = new_path(spark, "boxes")
    # shares of the partitions there are, for a few blocks each
    size = leaves.agg(F.coalesce(F.max(F.shiftright("block", 32)), F.lit(0)).alias("last"), F.count_if(F.col("leaf") == 0).alias("blocks")).first()
    groups = max(1, min(GROUPS, -(-size["blocks"] // SHARE)))
    part = F.floor(F.shiftright("block", 32) * groups / (size["last"] + 1)).cast("int")
    made = leaves.select("block", "leaf", part.alias("part"), "dim", "lo", "hi").groupBy("block").applyInArrow(boxes, "block long, part int, dim int, lo binary, hi binary, least array<float>, most array<float>")
    made.repartition("part").write.partitionBy("part").parquet(path)  # a folder a share
    blocks = spark.read.parquet(path)
    each = lambda f, name: F.array(*(f(F.get(name, F.lit(k))) for k in range(AXES + 1))).alias(name)
    parts = sorted(tuple(r) for r in blocks.groupBy("part").agg(each(F.min, "least"), each(F.max, "most")).collect())
    lo, hi = np.array([p[1] for p in parts]).reshape(-1, AXES + 1), np.array([p[2] for p in parts]).reshape(-1, AXES + 1)
    close = np.argwhere(np.triu(_apart(lo[:, None], hi[:, None], lo, hi) <= eps2)) if parts else []
    pairs = spark.createDataFrame([(parts[i][0], parts[j][0]) for i, j in close], "g int, h int").repartition(max(1, min(len(close), PAIR_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(path)
        share = lambda g: dataset.dataset(f"{place}/part={g}", filesystem=store, format="parquet").to_table(columns=["block", "dim", "lo", "hi", "least", "most"])
        for batch in batches:
            for g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _near_pairs(left := share(g), left if g == h else share(h), g == h, eps2)

    return pairs.mapInArrow(run, "l long, r long, block long, leaf int")


def _by_side(group: pa.Table) -> tuple[list[pa.Table], bool]:
    """The leaves of the left and the right block in order, one table for a block with itself."""
    group = group.sort_by([("block", "ascending"), ("leaf", "ascending")])
    l, r = group.column("l")[0].as_py(), group.column("r")[0].as_py()
    of = lambda b: group.filter(pa.array(np.asarray(group.column("block")) == b))
    return ([of(l)] if l == r else [of(l), of(r)]), l == r


def _sifted(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        sides, own = _by_side(group)
        p = [_outlooks(t.column("near")) for t in sides]
        hits = sift(p[0], None if own else p[1], threshold)
        kept = []
        for t, hit in zip(sides, hits, strict=False):
            begin = np.cumsum(np.asarray(t.column("size"))) - np.asarray(t.column("size"))
            if len(begin):
                kept.append(t.select(["l", "r", "block", "leaf"]).filter(pa.array(np.logical_or.reduceat(hit, begin))))
        return pa.concat_tables(kept)

    return run


def _linked(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        sides, own = _by_side(group)
        dim = group.column("dim")[0].as_py()
        longs = lambda t, name: np.frombuffer(b"".join(t.column(name).to_pylist()), np.int64)
        x, p, n, reps = [_matrix(t.column("data"), dim) for t in sides], [_outlooks(t.column("near")) for t in sides], [longs(t, "copies") for t in sides], [longs(t, "reps") for t in sides]
        count_x, count_y, edges = join_blocks(x[0], None if own else x[1], p[0], p[-1], n[0], n[-1], threshold)
        ids, counts = np.concatenate(reps), count_x if own else np.concatenate([count_x, count_y])
        some = np.flatnonzero(counts)
        return pa.table({
            "rep": pa.array(np.concatenate([ids[some], [ids[i] for i, _ in edges]]).astype(np.int64)), "links": pa.array(np.concatenate([counts[some], np.zeros(len(edges), np.int64)]).astype(np.int64)),
            "other": pa.array([*([None] * len(some)), *(int(ids[j]) for _, j in edges)], pa.int64()),
        })

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row.

    Vectors of one length with cosine >= ``threshold`` (over 0) are linked. A null or empty vector, one of zeros and one
    with null or non-finite components links with nothing, nor does a row with a null id. Rows that repeat an id are
    vectors of their own and share its component. Equal vectors are linked. Vectors may have any length. Other columns
    are left out; an empty table gives an empty result.
    """
    c, v = column(id_col).cast("long"), column(vector).cast("array<double>")
    rows = vectors.select(c.alias("id"), v.alias("v"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(usable, F.lit(False)))
    eps = float(np.sqrt(2 - 2 * threshold))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = [np.array(x, np.float64) for x in batch.column(2).to_pylist()]
        flat = [x / np.abs(x).max() for x in flat]  # so that squares neither overflow nor vanish
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array([len(x) for x in flat], pa.int32())], ["rep", "n", "payload", "dim"])

    with workspace(vectors.sparkSession, "vectors") as folder:
        named = stored(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
        classes = stored(map_batches(named.select("rep", "n", "v"), pack, "rep long, n long, payload binary, dim int"), "packed")
        common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
        if common is None:
            return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        leaves = leaves_of(classes, principal_axes(classes, common["dim"]), eps)
        wanted = near_leaves(leaves, eps).join(leaves.select("block", "leaf", "size", "near"), ["block", "leaf"])
        sifted = stored(wanted.groupBy("l", "r").applyInArrow(_sifted(threshold), "l long, r long, block long, leaf int"), "sifted")
        full = sifted.join(leaves.select("block", "leaf", "dim", "reps", "copies", "near", "data"), ["block", "leaf"])
        found = stored(full.groupBy("l", "r").applyInArrow(_linked(threshold), "rep long, links long, other long"), "vector-links")
        counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
        comps = components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
        # copies of a class are linked with each other; two classes of one id are one node
        per_class = named.join(counts, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    per_class = stored(per_class.withColumnRenamed("v", "key"), "vector-verdicts")
    discard(vectors.sparkSession, folder)
    keyed = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    out = keyed.join(per_class, "key", "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
