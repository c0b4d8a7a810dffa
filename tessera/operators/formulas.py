"""Scoring and fitting formulas to groups of points ``(group, x double, y double)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.formulas import MAX_ABS, Formula, constants, enumerate_formulas, predict, rpn, with_constants
from tessera.session import written

#: Up to this many formulas are scored as generated columns; more would pass the limits of generated code.
COLUMNS_MAX = 64
#: A constant is tried times these factors, plus these steps and as these values; its least value; passes.
FACTORS, STEPS, VALUES = (0.25, 0.5, 2.0, 4.0), (0.1, -0.1, 1.0, -1.0), (0.5, 1.0, 2.0, 3.0, 4.0, 5.0)
LEAST, PASSES = 1e-6, 8
#: Points of a group that a task of the tuning holds, and those that it looks at first.
POINTS_MAX, POINTS_FIRST = 50_000, 512


def _values(formula: Formula, x: np.ndarray, known: dict) -> np.ndarray:
    """The formula on a batch, NaN where a node fails; sub-formulas are computed once."""
    if formula in known:
        return known[formula]
    if isinstance(formula, tuple) and formula[0] == "eml":
        a, b = _values(formula[1], x, known), _values(formula[2], x, known)
        with np.errstate(all="ignore"):
            v = np.where(b > 0, np.exp(a) - np.log(np.where(b > 0, b, 1.0)), np.nan)
    else:
        v = np.ones_like(x) if formula == "1" else x if formula == "x" else np.full_like(x, formula[1])
    with np.errstate(invalid="ignore"):
        v = np.where(np.abs(v) <= MAX_ABS, v, np.nan)
    known[formula] = v
    return v


def score_formulas(points: DataFrame, formulas: list[Formula]) -> DataFrame:
    """``(group, formula_id, mse)`` by place in ``formulas``; infinite if any prediction isn't finite."""
    if len(formulas) <= COLUMNS_MAX:
        errors = [F.pow(F.nullif(predict(f, F.col("x")), F.lit(float("nan"))) - F.col("y"), 2) for f in formulas]
        each = points.select("group", F.posexplode(F.array(*errors)).alias("formula_id", "e"))
        sums = each.groupBy("group", "formula_id").agg(F.sum("e").alias("sse"), F.count("*").alias("n"), F.count_if(F.col("e").isNull()).alias("bad"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups = batch.column(0).dictionary_encode()
                index, names = np.asarray(groups.indices.fill_null(len(groups.dictionary))), [*groups.dictionary.to_pylist(), None]
                x, y = np.asarray(batch.column(1), float), np.asarray(batch.column(2), float)
                n = np.bincount(index, minlength=len(names))
                known: dict = {}
                out: dict[str, list] = {"group": [], "formula_id": [], "sse": [], "n": [], "bad": []}
                for k, f in enumerate(formulas):
                    e = (_values(f, x, known) - y) ** 2
                    bad = ~np.isfinite(e)
                    sse, failed = np.bincount(index, np.where(bad, 0, e), len(names)), np.bincount(index, bad, len(names))
                    for g in np.flatnonzero(n):
                        for name, value in zip(out, (names[g], k, float(sse[g]), int(n[g]), int(failed[g])), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({"group": pa.array(out["group"], batch.column(0).type), "formula_id": pa.array(out["formula_id"], pa.int32()), "sse": pa.array(out["sse"], pa.float64()), "n": pa.array(out["n"], pa.int64()), "bad": pa.array(out["bad"], pa.int64())})

        kind = points.schema["group"].dataType.simpleString()
        parts = points.select("group", F.col("x").cast("double"), F.col("y").cast("double")).mapInArrow(run, f"group {kind}, formula_id int, sse double, n long, bad long")
        sums = parts.groupBy("group", "formula_id").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return sums.select("group", "formula_id", F.when(F.col("bad") > 0, float("inf")).otherwise(F.col("sse") / F.col("n")).alias("mse"))


def _chosen(scores: DataFrame, goal_mse: float) -> DataFrame:
    """``(group, formula_id, mse)``: the least error, the first formula on ties; the first that meets a goal if any does."""
    met = F.when(F.lit(goal_mse > 0) & (F.col("mse") <= goal_mse), F.col("formula_id"))
    best = scores.groupBy("group").agg(F.min(F.struct("mse", "formula_id")).alias("b"), F.min(F.struct(met.isNull().alias("no"), met.alias("formula_id"), "mse")).alias("g"))
    pick = lambda name: F.when(~F.col("g.no"), F.col(f"g.{name}")).otherwise(F.col(f"b.{name}")).alias(name)
    return best.select("group", pick("formula_id"), pick("mse"))


def fit_formulas(points: DataFrame, max_nodes: int = 3, goal_mse: float = 0.0, tune: bool = False) -> DataFrame:
    """``(group, rpn, mse)``: the formula of least error, the first in order on ties.

    With a goal, the first formula in order that meets it is taken where one does. ``tune`` moves every formula's
    constants by coordinate descent first, for each group on its own, and adds them as ``constants``; with a goal, a group
    that meets it by formulas of some size isn't tried on larger ones.
    """
    formulas = enumerate_formulas(max_nodes)
    if tune:
        return _tuned(points, formulas, goal_mse)
    spark = points.sparkSession
    names = spark.createDataFrame([(k, rpn(f)) for k, f in enumerate(formulas)], "formula_id int, rpn string")
    return _chosen(score_formulas(points, formulas), goal_mse).join(F.broadcast(names), "formula_id").select("group", "rpn", "mse")


def _probes(start: float) -> list[float]:
    """The value itself and what it is tried as."""
    return [start, *(max(v, LEAST) for v in (*(start * x for x in FACTORS), *(start + x for x in STEPS), *VALUES))]


Try = tuple[int, int, Formula, float]


def errors_below(x: np.ndarray, y: np.ndarray, tries: list[Try], free: set[Formula]) -> tuple[list[tuple[int, int, float]], int]:
    """``(form, probe, sum of squared errors)`` of the tries ``(form, probe, formula, bound)`` whose sum stays under their
    bound, and the number of values computed. Points come in growing chunks; a try ends at the chunk where its partial sum
    reaches the bound or a value isn't finite. Sub-formulas in ``free``, without constants, are computed once a chunk."""
    sums, computed, lo, size = dict.fromkeys(range(len(tries)), 0.0), 0, 0, POINTS_FIRST
    while lo < len(x) and sums:
        some, known = slice(lo, lo + size), {}
        lo, size = lo + size, 2 * size
        for t in list(sums):
            computed += len(x[some])
            sums[t] += float(((_values(tries[t][2], x[some], known) - y[some]) ** 2).sum())
            for g in [g for g in known if g not in free]:
                del known[g]
            if not sums[t] < tries[t][3]:  # NaN as well
                del sums[t]
    return [(*tries[t][:2], e) for t, e in sums.items()], computed


def _free(formula: Formula) -> set[Formula]:
    """The sub-formulas without constants."""
    own = set() if constants(formula) else {formula}
    return own | _free(formula[1]) | _free(formula[2]) if formula[0] == "eml" else own


def _size(formula: Formula) -> int:
    return 1 + _size(formula[1]) + _size(formula[2]) if formula[0] == "eml" else 0


def _descended(parts: DataFrame, groups: DataFrame, formulas: list[Formula]) -> DataFrame:
    """``(group, form, mse, constants)``: coordinate descent on the constants of every formula, for every group on its own.

    A table holds each group's constants, each formula's error so far and whether its last pass moved it. A step probes
    one place of all formulas that still move: parts of at most about ``POINTS_MAX`` points of a group meet its row. A
    probe counts only if it beats its formula's error, so it is given up where its partial sum reaches that; what every
    part of the group lets through is added up, and the least one, the first on ties, gives the next row. So descents are
    those of all probes in full. Nothing of this goes through the driver but whether a pass changed anything.
    """
    kind = groups.schema["group"].dataType.simpleString()
    first = np.cumsum([0, *(len(constants(f)) for f in formulas)])
    longest, free = max(len(constants(f)) for f in formulas), set().union(*map(_free, formulas))
    no = F.array_repeat(F.lit(False), len(formulas))
    columns = "n long, at array<double>, err array<double>, open array<boolean>, moved array<boolean>, changed boolean"
    state = groups.select("group", "n", F.array_repeat(F.lit(1.0), int(first[-1])).alias("at"), F.array_repeat(F.lit(float("inf")), len(formulas)).alias("err"), F.array_repeat(F.lit(True), len(formulas)).alias("open"), no.alias("moved"))
    n_parts = F.ceil(F.col("n") / POINTS_MAX)

    def chosen(state: DataFrame, place: int | None) -> DataFrame:
        """``(group, found)``: by formula the probe of the place that beats its error, or the error at the start."""

        def run(own: pa.Table, rows: pa.Table) -> pa.Table:
            at, err, open_ = (rows.column(c)[0].as_py() for c in ("at", "err", "open"))
            tries: list[Try] = []
            for k, f in enumerate(formulas):
                values = at[first[k] : first[k + 1]]
                if place is None:
                    tries.append((k, 0, with_constants(f, iter(values)), float("inf")))
                elif open_[k] and len(values) > place:
                    tries += [(k, p, with_constants(f, iter([*values[:place], v, *values[place + 1 :]])), err[k]) for p, v in enumerate(_probes(values[place])) if p]
            out, _ = errors_below(np.asarray(own.column("x")), np.asarray(own.column("y")), tries, free)
            group = pa.array([rows.column("group")[0].as_py()] * len(out), rows.schema.field("group").type)
            return pa.table({"group": group, "form": pa.array([r[0] for r in out], pa.int32()), "probe": pa.array([r[1] for r in out], pa.int32()), "sse": pa.array([r[2] for r in out], pa.float64())})

        each = state.select("group", "at", "err", "open", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("part"))
        sums = parts.groupBy("group", "part").cogroup(each.groupBy("group", "part")).applyInArrow(run, f"group {kind}, form int, probe int, sse double")
        whole = sums.groupBy("group", "form", "probe").agg(F.sum("sse").alias("sse"), F.count("*").alias("got")).join(groups, "group").where(F.col("got") == n_parts)
        return whole.groupBy("group", "form").agg(F.min(F.struct("sse", "probe")).alias("b")).groupBy("group").agg(F.collect_list(F.struct("form", "b.probe", "b.sse")).alias("found"))  # one entry a formula

    def moved(state: DataFrame, place: int | None) -> DataFrame:
        """The next state; the last place of a pass says which formulas stay open."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for group, n, at, err, open_, went, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for c in found or []:
                        k, p = c["form"], c["probe"]
                        if c["sse"] < err[k]:
                            err[k] = c["sse"]
                            if place is not None:
                                at[first[k] + place], went[k] = _probes(at[first[k] + place])[p], True
                    ends = place == longest - 1
                    rows.append({"group": group, "n": n, "at": at, "err": err, "open": went if ends else open_, "moved": [False] * len(went) if ends else went, "changed": any(went)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, batch.schema.field(c).type) for c in ("group", "n", "at", "err", "open", "moved")] + [("changed", pa.bool_())]))

        joined = state.select("group", "n", "at", "err", "open", "moved").join(chosen(state, place), "group", "left")
        return written(joined.mapInArrow(run, f"group {kind}, {columns}"), "constants")

    state = moved(state, None)
    for _ in range(PASSES if longest else 0):
        for place in range(longest):
            state = moved(state, place)
        if state.where("changed").isEmpty():
            break
    spans = F.array(*(F.struct(F.lit(int(b)).alias("begin"), F.lit(int(e - b)).alias("size")) for b, e in zip(first, first[1:], strict=False)))
    each = state.select("group", "n", "at", F.posexplode(F.arrays_zip(F.col("err").alias("err"), spans.alias("span"))).alias("form", "of"))
    return each.select("group", "form", (F.col("of.err") / F.col("n")).alias("mse"), F.slice("at", F.col("of.span.begin") + 1, F.col("of.span.size")).alias("constants"))


def _tuned(points: DataFrame, formulas: list[Formula], goal_mse: float) -> DataFrame:
    """Formulas of all sizes at once, or with a goal size by size: groups that meet it are left out of the next round."""
    groups = written(points.groupBy("group").agg(F.count("*").alias("n")), "group-sizes")
    parts = points.select("group", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(groups, "group")
    parts = written(parts.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / POINTS_MAX)).cast("long")).select("group", "part", "x", "y"), "group-parts")
    sizes = sorted({_size(f) for f in formulas}) if goal_mse > 0 else [None]
    found: DataFrame | None = None
    for size in sizes:
        own = [(k, f) for k, f in enumerate(formulas) if size is None or _size(f) == size]
        names = points.sparkSession.createDataFrame([(j, k, rpn(f)) for j, (k, f) in enumerate(own)], "form int, formula_id int, rpn string")
        scores = written(_descended(parts, groups, [f for _, f in own]).join(F.broadcast(names), "form"), "tuned")
        best = _chosen(scores.select("group", "formula_id", "mse"), goal_mse).join(scores.drop("mse"), ["group", "formula_id"])
        found = best if found is None else found.unionByName(best)
        if goal_mse > 0:
            groups = written(groups.join(best.where(F.col("mse") <= goal_mse), "group", "left_anti"), "group-sizes")
            if groups.isEmpty():
                break
            parts = written(parts.join(groups.select("group"), "group", "left_semi"), "group-parts")
    return _chosen(found.select("group", "formula_id", "mse"), goal_mse).join(found.drop("mse"), ["group", "formula_id"]).select("group", "rpn", "constants", "mse")


def baseline_mse(points: DataFrame) -> DataFrame:
    """``(group, mse)`` of the mean as prediction."""
    return points.groupBy("group").agg(F.var_pop("y").alias("mse"))
