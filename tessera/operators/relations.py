"""Sets and binary relations, folded from a log of operations.

``ops(seq long, op, name, a, b)`` with op SADD, SREM, RADD or RREM; ``members(set, atom)``; ``pairs(rel, left,
right)``. Results are distinct; order them by their columns for byte order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import valid_name
from tessera.session import new_path, written

#: Least arguments by operation; set operations take exactly as many.
ARITY = {"SADD": 2, "SREM": 2, "RADD": 3, "RREM": 3}
OPS = "seq long, op string, name string, a string, b string"


@dataclass(frozen=True)
class State:
    members: DataFrame
    pairs: DataFrame
    #: ``(kind, name)``: a name exists once something was added to it, even if it is empty now
    names: DataFrame


def fold_ops(ops: DataFrame) -> State:
    """The last operation on each atom or pair decides."""
    last = ops.groupBy(F.substring("op", 1, 1).alias("kind"), "name", "a", F.coalesce("b", F.lit("")).alias("b")).agg(F.max_by("op", "seq").alias("op"))
    kept = last.where(F.substring("op", 2, 3) == "ADD")
    return State(
        kept.where("kind = 'S'").select(F.col("name").alias("set"), F.col("a").alias("atom")),
        kept.where("kind = 'R'").select(F.col("name").alias("rel"), F.col("a").alias("left"), F.col("b").alias("right")),
        ops.where(F.col("op").isin("SADD", "RADD")).select(F.when(F.col("op") == "SADD", "set").otherwise("relation").alias("kind"), "name").distinct(),
    )


def parse_facts(lines: DataFrame) -> DataFrame:
    """``(seq, op, name, a, b, bad)`` from ``(line_no, line)``; comments and empty lines are left out. Lines of several
    files are in the order of their ``seq``, where they have one."""
    at = "seq" if "seq" in lines.columns else "line_no"
    words = F.array_remove(F.split("line", " "), "")
    rows = lines.where((F.length("line") > 0) & ~F.col("line").startswith("#")).select(F.col(at).alias("seq"), words.alias("w"))
    need = F.lit(None).cast("int")
    for op, n in ARITY.items():
        need = F.when(F.get("w", F.lit(0)) == op, n).otherwise(need)
    args = F.size("w") - 1
    relation = need == 3
    named = valid_name(F.get("w", F.lit(1))) & valid_name(F.get("w", F.lit(2))) & (~relation | valid_name(F.get("w", F.lit(3))))
    good = F.coalesce(need.isNotNull() & F.when(relation, args >= 3).otherwise(args == 2) & named, F.lit(False))
    return rows.select("seq", F.get("w", F.lit(0)).alias("op"), F.get("w", F.lit(1)).alias("name"), F.get("w", F.lit(2)).alias("a"), F.when(relation, F.get("w", F.lit(3))).alias("b"), (~good).alias("bad"))


def load_facts(lines: DataFrame, state_ops: DataFrame | None = None) -> tuple[State, int | None]:
    """The state after the lines before the first bad one, and that line's number (None if all are good): its ``seq``,
    the number over all files, where lines have one. ``bad_line`` tells its file."""
    parsed = parse_facts(lines)
    first_bad = parsed.where("bad").agg(F.min("seq").alias("n")).first()["n"]
    ops = parsed if first_bad is None else parsed.where(F.col("seq") < first_bad)
    ops = ops.select("seq", "op", "name", "a", "b")
    return fold_ops(ops if state_ops is None else append_ops(state_ops, ops)), first_bad


def bad_line(lines: DataFrame, number: int) -> tuple[str, int]:
    """The path of the line with the number that ``load_facts`` gave, and its number there."""
    r = lines.where(F.col("seq" if "seq" in lines.columns else "line_no") == number).select("path", "line_no").first()
    return r["path"], r["line_no"]


def append_ops(ops: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (by its own ``seq``) after all of ``ops``."""
    end = ops.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first()["n"]
    low = more.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("n")).first()["n"]
    return ops.unionByName(more.withColumn("seq", F.col("seq") - low + end + 1).select(*ops.columns))


def new_ops(spark: SparkSession, op: str, name: str, items: list[tuple[str, ...]]) -> DataFrame:
    """Rows for add (SADD), remove (SREM), relate (RADD) and unrelate (RREM)."""
    if op not in ARITY:
        raise ValueError(f"unknown operation {op}")
    return spark.createDataFrame([(k, op, name, x[0], x[1] if len(x) > 1 else None) for k, x in enumerate(items)], OPS)


def add(spark: SparkSession, name: str, *atoms: str) -> DataFrame:
    return new_ops(spark, "SADD", name, [(a,) for a in atoms])


def remove(spark: SparkSession, name: str, *atoms: str) -> DataFrame:
    return new_ops(spark, "SREM", name, [(a,) for a in atoms])


def relate(spark: SparkSession, name: str, left: str, right: str) -> DataFrame:
    return new_ops(spark, "RADD", name, [(left, right)])


def unrelate(spark: SparkSession, name: str, left: str, right: str) -> DataFrame:
    return new_ops(spark, "RREM", name, [(left, right)])


def members(state: State, name: str) -> DataFrame:
    return state.members.where(F.col("set") == name).select("atom")


def is_member(state: State, name: str, atom: str) -> bool:
    return not members(state, name).where(F.col("atom") == atom).isEmpty()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def is_subset(state: State, a: str, b: str) -> bool:
    """A missing left set is a subset of anything; else a missing right set holds nothing, not even an emptied left."""
    known = {r["name"] for r in state.names.where((F.col("kind") == "set") & F.col("name").isin(a, b)).collect()}
    if a not in known:
        return True
    return b in known and members(state, a).join(members(state, b), "atom", "left_anti").isEmpty()


def sets_containing(state: State, atom: str) -> DataFrame:
    return state.members.where(F.col("atom") == atom).select("set").distinct()


def set_names(state: State) -> DataFrame:
    return state.names.where("kind = 'set'").select("name")


def relation_names(state: State) -> DataFrame:
    return state.names.where("kind = 'relation'").select("name")


def pairs(state: State, name: str) -> DataFrame:
    return state.pairs.where(F.col("rel") == name).select("left", "right")


def select(relation: DataFrame, side: str, atom: str) -> DataFrame:
    """The other ends of the pairs whose ``first`` or ``second`` end is ``atom``."""
    if side not in ("first", "second"):
        raise ValueError("side is 'first' or 'second'")
    at, other = ("left", "right") if side == "first" else ("right", "left")
    return relation.where(F.col(at) == atom).select(F.col(other).alias("atom")).distinct()


def _joined(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.select("left", F.col("right").alias("__mid")).join(s.select(F.col("left").alias("__mid"), "right"), "__mid").select("left", "right")


def compose(r: DataFrame, s: DataFrame) -> DataFrame:
    """``(a, c)`` for ``(a, b)`` in r and ``(b, c)`` in s."""
    return _joined(r, s).distinct()


def domain(relation: DataFrame) -> DataFrame:
    return relation.select(F.col("left").alias("atom")).distinct()


def range_(relation: DataFrame) -> DataFrame:
    return relation.select(F.col("right").alias("atom")).distinct()


def inverse(relation: DataFrame) -> DataFrame:
    return relation.select(F.col("right").alias("left"), F.col("left").alias("right")).distinct()


def rdiff(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.subtract(s)


def runion(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.union(s).distinct()


def rintersect(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.intersect(s)


def transitive_closure(relation: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Pairs joined by a path of one or more steps, in rounds that double the length of paths.

    A round knows all pairs less than ``2**n`` steps apart, and those exactly ``2**n`` apart. Any part of a shortest path
    is one itself, so pairs less than ``2**(n + 1)`` apart are the known ones, the exact ones and known ones extended by
    an exact one; and those exactly ``2**(n + 1)`` apart are two exact ones together, unless they are known by then. So
    there are as many rounds as the longest shortest path has binary digits, cycles or not, and one at which no pair is
    exactly that far apart is the last. Every round's new pairs are one more folder of a single table, so the plan doesn't
    grow with the rounds; pairs extended twice over are dropped inside tasks before they are shuffled.
    """
    spark, place = relation.sparkSession, new_path(relation.sparkSession, "closure")
    exact = written(relation.select("left", "right").distinct(), "steps")
    known = spark.read.schema(exact.schema).option("recursiveFileLookup", "true")
    exact.write.parquet(f"{place}/round=0")
    for n in range(max_rounds):
        if n:
            before = known.parquet(place)
            new = _joined(before, exact).unionByName(exact).distinct().join(before, ["left", "right"], "left_anti")
            new.write.parquet(f"{place}/round={n}")
        exact = written(compose(exact, exact).join(known.parquet(place), ["left", "right"], "left_anti"), "exact")
        if exact.isEmpty():
            return known.parquet(place)
    raise RuntimeError(f"paths are longer than 2 ** {max_rounds} steps")


def stored_ops(result: DataFrame, target: str) -> DataFrame:
    """Add operations that keep a set ``(atom)`` or relation ``(left, right)`` under the name ``target``."""
    if "atom" in result.columns:
        rows = result.select(F.lit("SADD").alias("op"), F.lit(target).alias("name"), F.col("atom").alias("a"), F.lit(None).cast("string").alias("b"))
    else:
        rows = result.select(F.lit("RADD").alias("op"), F.lit(target).alias("name"), F.col("left").alias("a"), F.col("right").alias("b"))
    return rows.select(F.monotonically_increasing_id().alias("seq"), "*")


def store_domain(ops: DataFrame, relation: DataFrame, target: str) -> DataFrame:
    return append_ops(ops, stored_ops(domain(relation), target))


def store_range(ops: DataFrame, relation: DataFrame, target: str) -> DataFrame:
    return append_ops(ops, stored_ops(range_(relation), target))


def store_inverse(ops: DataFrame, relation: DataFrame, target: str) -> DataFrame:
    return append_ops(ops, stored_ops(inverse(relation), target))


def tag(tagged: DataFrame) -> DataFrame:
    """Operations for ``(file, tags array)``: the file to ``files``, its tags to ``tags``, each pair to ``has_tag``."""
    each = tagged.select("file", F.explode("tags").alias("tag"))
    none = F.lit(None).cast("string")
    rows = (
        tagged.select(F.lit("SADD").alias("op"), F.lit("files").alias("name"), F.col("file").alias("a"), none.alias("b"))
        .union(each.select(F.lit("SADD"), F.lit("tags"), "tag", none))
        .union(each.select(F.lit("RADD"), F.lit("has_tag"), "file", "tag"))
    )
    return rows.select(F.monotonically_increasing_id().alias("seq"), "*")


def files_with(state: State, tag_name: str) -> DataFrame:
    return select(pairs(state, "has_tag"), "second", tag_name)


def tags_of(state: State, file: str) -> DataFrame:
    return select(pairs(state, "has_tag"), "first", file)


def dump_facts(state: State) -> DataFrame:
    """``(line)``: the state as add operations; loading them gives the same members and pairs."""
    sets = state.members.select(F.concat_ws(" ", F.lit("SADD"), "set", "atom").alias("line"))
    return sets.unionByName(state.pairs.select(F.concat_ws(" ", F.lit("RADD"), "rel", "left", "right").alias("line")))


def coverage_audit(state: State, checks: list[tuple[str, str, str, str]]) -> DataFrame:
    """``(check, atom)``: for each ``(check, set, relation, side)`` the members that are on no ``side`` of the relation."""
    out: DataFrame | None = None
    for name, of, relation, side in checks:
        covered = (domain if side == "domain" else range_)(pairs(state, relation))
        rows = diff(members(state, of), covered).select(F.lit(name).alias("check"), "atom")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no checks")
    return out
