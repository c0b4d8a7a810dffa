"""The registered queries over the shared tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.checksum import crc32c
from tessera.functions.formulas import predict
from tessera.functions.text import snippet
from tessera.functions.vectors import dot, l2_norm
from tessera.operators import documents as D
from tessera.operators import formulas as E
from tessera.operators import keyed as M
from tessera.operators import lines as K
from tessera.operators import relations as R
from tessera.operators import series as W
from tessera.operators import topics as L
from tessera.operators import vectors as V
from tessera.operators.ids import dense_ids
from tessera.session import new_path
from tessera.sources import files as S
from tessera.sources import tables as T
from tessera.sources import topics as TS
from tessera.streaming import jobs

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTERED[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _query_vector(vectors: DataFrame, doc_id: int = 0) -> list[float]:
    return vectors.where(F.col("doc_id") == doc_id).first()["vector"]


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return V.cosine_topk(vectors, _query_vector(vectors), 8)


@query
def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    queries = vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return V.cosine_topk_batch(vectors, queries, 10)


@query
def cosine_topk_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    base, delta = vectors.where("doc_id % 10 != 3"), vectors.where("doc_id % 10 = 3")
    return V.cosine_topk_merged(base, delta, vectors.where("doc_id % 7 = 0").select("doc_id"), _query_vector(vectors), 8)


@query
def same_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether searches of all vectors and of parts of them give the same hits."""
    vectors = _vectors(spark, sf_dir)
    q = _query_vector(vectors)
    whole = V.cosine_topk(vectors, q, 8)
    merged = V.cosine_topk_merged(vectors.where("doc_id % 3 = 0"), vectors.where("doc_id % 3 != 0"), vectors.select("doc_id").limit(0), q, 8)
    cut = V.cosine_topk(vectors.where("doc_id % 3 = 0"), q, 8)
    return spark.createDataFrame([("base and delta", V.same_hits(whole, merged)), ("a third", V.same_hits(whole, cut))], "of string, same boolean")


@query
def unit_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    both = V.normalize(vectors).select("doc_id", F.round("norm", 4).cast("double").alias("unit_norm"))
    return vectors.select("doc_id", F.round(l2_norm("vector"), 6).alias("norm"), F.round(dot("vector", "vector"), 6).alias("square")).join(both, "doc_id")


@query
def contains_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.contains_ids(_vectors(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id"))


# --- documents


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")


@query
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = D.assign_doc_ids(D.chunk_documents(_docs(spark, sf_dir)))
    return made.select("doc_id", "path", "offset", "length", F.sha2("text", 256).alias("sha256"))


@query
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.build_manifest(_docs(spark, sf_dir)).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.countDistinct("doc_id").alias("ids"), F.sum("length").alias("bytes"))


@query
def file_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    state = D.state_from_chunks(D.assign_doc_ids(D.chunk_documents(docs)), D.hash_files(docs))
    return state.select("path", "hash", F.size("doc_ids").cast("long").alias("n_ids"), F.array_min("doc_ids").alias("first_id"), F.array_max("doc_ids").alias("last_id"))


def _before_after(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents as they were and as they are: of ten, one was added since, one edited and one dropped."""
    docs = _docs(spark, sf_dir)
    if ascii_only:
        docs = docs.withColumn("content", F.regexp_replace(F.col("content").cast("string"), r"[^\x00-\x7F]", "?").cast("binary"))
    edited = F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit(b" edited"))).otherwise(F.col("content"))
    return docs.where("doc_id % 10 != 0"), docs.where("doc_id % 10 != 5").withColumn("content", edited)


@query
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _before_after(spark, sf_dir)
    return D.plan_refresh(D.hash_files(before), D.hash_files(after))


@query
def refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.refresh_counts(refresh_plan(spark, sf_dir))


def _letters(texts: list[str]) -> list[list[float]]:
    """An embedder that counts letters, and one more."""
    return [[1.0, *(float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz")] for t in texts]


def _refreshed(spark: SparkSession, sf_dir: str, embedder: D.Embedder | None = None, ascii_only: bool = False) -> tuple[D.DocumentIndex, DataFrame]:
    before, after = _before_after(spark, sf_dir, ascii_only)
    embedder = embedder or D.hashing_embedder(16)
    return D.apply_refresh(D.build_index(before.select("path", "content"), embedder), after.select("path", "content"), embedder)


@query
def refresh_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[0].manifest.select("doc_id", "path", "offset", "length")


@query
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    return D.embed(docs, "text", _letters).select("doc_id", F.transform("vector", lambda x: x.cast("long")).cast("string").alias("counts"))


@query
def refresh_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh refuses: another root, model or dimension, and an index whose vectors aren't of its dimension."""
    docs = _docs(spark, sf_dir).select("path", "content")
    index = D.build_index(docs, _letters, "root", "letters")
    tries = {"the same": {}, "root": {"root": "other"}, "model": {"model": "other"}, "dimension": {"embedder": D.hashing_embedder(5)}, "vectors": {"index": replace(index, dim=9), "embedder": D.hashing_embedder(9)}}

    def refused(index: D.DocumentIndex = index, embedder: D.Embedder = _letters, **how: str) -> bool:
        try:
            D.apply_refresh(index, docs, embedder, **how)
        except D.DocumentIndexError:
            return True
        return False

    return spark.createDataFrame([(name, refused(**how)) for name, how in tries.items()], "what string, refused boolean")


@query
def refresh_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[0].superseded


@query
def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    hits = V.cosine_topk(vectors, _query_vector(vectors), 8)
    docs = table(spark, sf_dir, "documents")
    manifest = docs.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(0).cast("long").alias("offset"), F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    return D.hits_with_sources(hits, manifest)


@query
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    return docs.select("doc_id", snippet("text", 60).alias("snippet"), snippet("text", 20, F.lit(10)).alias("inner"))


# --- sets and relations


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("atom")).distinct()
    return orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("atom")).distinct()


@query
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union(*_state(spark, sf_dir))


@query
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.intersect(*_state(spark, sf_dir))


@query
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").cast("string").alias("atom")).distinct()
    return R.diff(_state(spark, sf_dir)[1], urgent)


@query
def set_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order priority, whether its customers are a subset of all customers with urgent orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("set"), F.col("o_custkey").cast("string").alias("atom")).distinct()
    names = orders.select(F.lit("set").alias("kind"), F.col("set").alias("name")).distinct()
    state = R.State(orders, orders.select(F.col("set").alias("rel"), F.col("atom").alias("left"), F.col("atom").alias("right")).limit(0), names)
    sets = sorted(r["name"] for r in R.set_names(state).collect())  # the few priorities
    urgent = next(n for n in sets if n.startswith("1"))
    return spark.createDataFrame([(n, R.is_subset(state, n, urgent)) for n in [*sets, "none at all"]], "name string, is_subset boolean")


@query
def set_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every set of the log, whether user 7 is in it."""
    state = R.fold_ops(_ops(spark, sf_dir))
    names = sorted(r["name"] for r in R.set_names(state).collect())  # ten sets
    return spark.createDataFrame([(n, R.is_member(state, n, "7")) for n in names], "name string, is_member boolean")


def _relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pair = lambda name, a, b: table(spark, sf_dir, name).select(F.col(a).alias("left"), F.col(b).alias("right")).distinct()
    return {"ordered": pair("orders", "o_custkey", "o_orderkey"), "holds": pair("lineitem", "l_orderkey", "l_partkey"), "supplies": pair("lineitem", "l_suppkey", "l_partkey")}


@query
def rel_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _relations(spark, sf_dir)
    return R.compose(r["ordered"], r["holds"])


@query
def rel_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domain(_relations(spark, sf_dir)["ordered"])


@query
def rel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.range_(_relations(spark, sf_dir)["supplies"])


@query
def rel_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inverse(_relations(spark, sf_dir)["supplies"])


@query
def rel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _relations(spark, sf_dir)
    return R.rdiff(r["holds"], r["supplies"])


@query
def rel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _relations(spark, sf_dir)
    return R.runion(r["holds"], r["supplies"])


@query
def rel_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _relations(spark, sf_dir)
    return R.rintersect(r["holds"], r["supplies"])


@query
def rel_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select(_relations(spark, sf_dir)["supplies"], "first", 1)


@query
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders of a customer follow which, from each one's successor, in runs of eight orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("left"), F.lead("o_orderkey").over(w).alias("right"), F.row_number().over(w).alias("n"))
    return R.transitive_closure(orders.where("right IS NOT NULL AND n % 8 != 0"))


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ops_of(table(spark, sf_dir, "events"))


def _ops_of(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type").isin("click", "view", "signup"), "SADD").otherwise("SREM")
    name = F.concat(F.lit("s"), F.get_json_object("props", "$.k").cast("long") % 10)
    return events.select(F.col("event_id").alias("seq"), op.alias("op"), name.alias("name"), F.col("user_id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))


@query
def fold_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold_ops(_ops(spark, sf_dir)).members


@query
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with an atom added, one removed, a pair related and one unrelated at its end."""
    ops = _ops(spark, sf_dir)
    for more in (R.add(spark, "s3", "new one"), R.remove(spark, "s3", "7"), R.relate(spark, "knows", "a", "b"), R.relate(spark, "knows", "b", "c"), R.unrelate(spark, "knows", "a", "b")):
        ops = R.append_ops(ops, more)
    state = R.fold_ops(ops)
    return R.members(state, "s3").select(F.lit("s3").alias("name"), "atom").unionByName(R.pairs(state, "knows").select(F.lit("knows").alias("name"), F.concat_ws(" ", "left", "right").alias("atom")))


@query
def facts_until_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as lines of facts, of which number 777 is bad: what comes before it counts, and its number is told."""
    line = F.when(F.col("seq") == 777, F.lit("SADD s1")).otherwise(F.concat_ws(" ", "op", "name", "a"))
    state, bad = R.load_facts(_ops(spark, sf_dir).select(F.col("seq").alias("line_no"), line.alias("line")))
    return state.members.withColumn("bad", F.lit(bad).cast("long"))


@query
def sets_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sets_containing(R.fold_ops(_ops(spark, sf_dir)), "7")


@query
def relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation for every market segment, of which one is emptied again and another only removed from."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.concat(F.lit("of."), F.lower("c_mktsegment")).alias("name"), F.col("c_nationkey").cast("string").alias("b"))
    added = customer.select(F.col("k").alias("seq"), F.lit("RADD").alias("op"), "name", F.col("k").cast("string").alias("a"), "b")
    removed = added.where("name IN ('of.building', 'of.machinery')").withColumn("op", F.lit("RREM")).withColumn("seq", -F.col("seq"))
    state = R.fold_ops(added.where("name != 'of.machinery'").unionByName(removed.withColumn("seq", F.abs("seq") + 10_000_000_000)))
    sizes = state.pairs.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n"))
    return R.relation_names(state).join(sizes, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query
def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation's range kept as a set beside what the log had."""
    customer = table(spark, sf_dir, "customer")
    ops = customer.select(F.col("c_custkey").cast("long").alias("seq"), F.lit("RADD").alias("op"), F.lit("lives_in").alias("name"), F.col("c_custkey").cast("string").alias("a"), F.col("c_nationkey").cast("string").alias("b"))
    return R.members(R.fold_ops(R.store_range(ops, R.pairs(R.fold_ops(ops), "lives_in"), "nations")), "nations")


@query
def set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.set_names(R.fold_ops(_ops(spark, sf_dir)))


@query
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order and parts of which no delivery came back."""
    text = lambda c: F.col(c).cast("string")
    members = table(spark, sf_dir, "customer").select(F.lit("customers").alias("set"), text("c_custkey").alias("atom")).union(table(spark, sf_dir, "part").select(F.lit("parts"), text("p_partkey")))
    pairs = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.lit("ordered").alias("rel"), text("o_custkey").alias("left"), text("o_orderkey").alias("right")).union(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lit("supplies"), text("l_suppkey"), text("l_partkey"))).distinct()
    state = R.State(members, pairs, members.select(F.lit("set").alias("kind"), F.col("set").alias("name")).distinct())
    return R.coverage_audit(state, [("no urgent order", "customers", "ordered", "domain"), ("nothing returned", "parts", "supplies", "range")])


# --- lines


def _lines(spark: SparkSession, sf_dir: str, max_len: int | None = None) -> DataFrame:
    return K.lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), max_len=max_len)


@query
def grep_lines_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the search reads them by default: longer lines are left out."""
    return K.grep(_lines(spark, sf_dir, K.SEARCH_MAX), "license").select("path", "line_no", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


@query
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.grep(_lines(spark, sf_dir), "license").select("path", "line_no", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


@query
def grep_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.grep(_lines(spark, sf_dir), "LICENSE", ignore_case=True).select("path", "line_no", F.octet_length("line").cast("long").alias("n_bytes"))


@query
def grep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.grep_count(_lines(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")), "the")


@query
def grep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = K.lines_of(table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text")), max_len=None)
    return K.grep_files(pages, "example.net")


def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("path"), F.lit(1).cast("long").alias("line_no"), F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("level"), "props")).alias("line"))


@query
def jsonl_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("props").alias("line"))
    return K.jsonl_field_eq(lines, "k", "7").select("path")


@query
def jsonl_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of the key decides, at any depth: here it is inside ``props``, before a later one at the top."""
    events = table(spark, sf_dir, "events")
    line = F.concat(F.lit('{"props":'), "props", F.lit(',"k":"7"}'))
    return K.jsonl_field_eq(events.select(F.col("event_id").alias("path"), line.alias("line")), "k", "7", first_match=True).select("path")


@query
def jsonl_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.slice_lines(_jsonl(spark, sf_dir), contains_text="1", level="error", jsonl=True).select("path")


@query
def jsonl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.slice_count(_jsonl(spark, sf_dir), level="purchase", jsonl=True)


# --- topics


def _topic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), F.col("props").cast("binary").alias("payload"))
    empty = events.limit(0).select("topic", F.col("seq").alias("offset"))
    return L.append(empty, events).withColumn("segment_base", F.floor(F.col("offset") / 1000).cast("long") * 1000)


@query
def topic_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_log(spark, sf_dir).select("topic", "offset", F.col("payload").cast("string").alias("payload"))


@query
def fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fetch(_topic_log(spark, sf_dir), "click", 5, 400).select("offset", F.col("payload").cast("string").alias("payload"))


@query
def fetch_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fetch_batch(_topic_log(spark, sf_dir), "view", 950, 4_000).select("offset", F.col("payload").cast("string").alias("payload"))


def _topic_files(spark: SparkSession, sf_dir: str) -> str:
    root = new_path(spark, "log")
    S.write_topic(_topic_log(spark, sf_dir), root)
    return root


@query
def fetch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fetch``, from segment files of which only the needed ones are opened."""
    return TS.fetch_from(spark, _topic_files(spark, sf_dir), "click", 5, 400).select("offset", F.col("payload").cast("string").alias("payload"))


@query
def fetch_batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fetch_batch``, from segment files of which one is opened."""
    return TS.fetch_batch_from(spark, _topic_files(spark, sf_dir), "view", 950, 4_000).select("offset", F.col("payload").cast("string").alias("payload"))


@query
def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``read_from_group``, from segment files of which those before the group's offset aren't opened."""
    return TS.resume_from(spark, _topic_files(spark, sf_dir), _offsets(spark, sf_dir), "g1", "purchase").select("offset", F.col("payload").cast("string").alias("payload"))


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("g"), F.col("user_id") % 5).alias("group"), F.col("event_type").alias("topic"), (F.col("event_id") % 997).alias("offset"), F.col("event_id").alias("seq"))


@query
def committed_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.committed_offsets(_offsets(spark, sf_dir))


@query
def read_from_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.read_from_group(_topic_log(spark, sf_dir), _offsets(spark, sf_dir), "g1", "purchase").select("offset", F.col("payload").cast("string").alias("payload"))


@query
def committed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every topic, the records of the segments that the index names: all but each fifth segment."""
    log = _topic_log(spark, sf_dir)
    return L.committed(log, log.where("segment_base % 5000 != 0").select("topic", "offset", "segment_base")).groupBy("topic").agg(F.count("*").alias("n"), F.max("offset").alias("last"))


# --- keyed state, listings, series


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd = F.col("event_type")
    kind = F.when(cmd == "click", "INCR").when(cmd == "view", "DECR").when(cmd.isin("signup", "purchase"), "SET").otherwise("DEL")
    value = F.when(cmd == "signup", F.get_json_object("props", "$.k")).when(cmd == "purchase", F.concat(F.lit("p"), F.get_json_object("props", "$.k")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("cmd"), F.col("user_id").cast("string").alias("key"), value.alias("value"))


@query
def fold_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold_kv(_commands(spark, sf_dir))


@query
def kv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kv_errors(_commands(spark, sf_dir))


@query
def mget(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("position"), F.col("c_custkey").cast("string").alias("key"))
    return M.mget(M.fold_kv(_commands(spark, sf_dir)), wanted)


@query
def kv_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dbsize(M.fold_kv(_commands(spark, sf_dir)))


@query
def path_summary_(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "source", "doc_id").alias("path"), F.lit(False).alias("is_dir"), F.octet_length("text").cast("long").alias("length"))
    return S.path_summary(files.union(docs.select("source", F.lit(True), F.lit(0).cast("long")).distinct()))


@query
def best_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return W.best_trade(events, "user_id", "at", "value").select("user_id", F.round("best", 6).alias("best"))


@query
def max_run_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("value", F.col("value") - 100)
    return W.max_run_sum(events, "user_id", "at", "value").select("user_id", F.round("best", 4).alias("best"))


# --- formulas


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_discount").cast("double") + 0.1
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), x.alias("x"), (F.exp(x) + F.col("l_tax").cast("double")).alias("y"))


#: The one-operator formulas without constants, in the order of enumeration.
ONE_NODE = [("eml", a, b) for b in ("1", "x") for a in ("1", "x")]


@query
def score_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_formulas(_points(spark, sf_dir), ONE_NODE).select("group", F.col("formula_id").cast("long").alias("formula_id"), F.round("mse", 6).alias("mse"))


@query
def fit_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fit_formulas(_points(spark, sf_dir), max_nodes=1).select("group", "rpn", F.round("mse", 6).alias("mse"))


@query
def score_many_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More formulas than are scored as columns: the four of one operator, seventeen times."""
    return E.score_formulas(_points(spark, sf_dir), ONE_NODE * 17).select("group", F.col("formula_id").cast("long").alias("formula_id"), F.round("mse", 6).alias("mse"))


@query
def fit_formulas_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formulas of up to three operators."""
    return E.fit_formulas(_points(spark, sf_dir)).select("group", "rpn", F.round("mse", 6).alias("mse"))


@query
def tune_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuned_columns(E.fit_formulas(_points(spark, sf_dir), max_nodes=1, tune=True))


def _tuned_columns(found: DataFrame) -> DataFrame:
    return found.select("group", "rpn", F.transform("constants", lambda c: F.round(c, 6)).cast("string").alias("constants"), F.round("mse", 6).alias("mse"))


#: Between the best errors of the groups.
GOAL = 0.00238


@query
def tune_formulas_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first formula whose tuned error is within the goal, where there is one."""
    return _tuned_columns(E.fit_formulas(_points(spark, sf_dir), max_nodes=1, goal_mse=GOAL, tune=True))


@query
def fit_formulas_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first formula, untuned, whose error is within a goal that only some formulas meet."""
    return E.fit_formulas(_points(spark, sf_dir), max_nodes=1, goal_mse=0.5).select("group", "rpn", F.round("mse", 6).alias("mse"))


@query
def predict_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp(x) of quantities: most are over the bound of a node."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), predict(("eml", "x", "1"), F.col("l_quantity").cast("double")).alias("p"))
    return points.groupBy("group").agg(F.round(F.sum(F.nanvl("p", F.lit(0.0))), 1).alias("total"), F.count_if(F.isnan("p")).alias("bad"))


@query
def baseline_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.baseline_mse(_points(spark, sf_dir)).select("group", F.round("mse", 6).alias("mse"))


@query
def predict_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("p", predict(("eml", "x", ("eml", "1", "x")), F.col("x")))
    return points.groupBy("group").agg(F.round(F.sum(F.nanvl("p", F.lit(0.0))), 3).alias("total"), F.count_if(F.isnan("p")).alias("bad"))


@query
def dense_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_ids(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], "rank")


# --- sources and sinks, through the shared folder


@query
def payload_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as payloads, every other one without an id of its own, decoded, checked, normalised and searched."""
    vectors = _vectors(spark, sf_dir)
    rows = vectors.select(F.col("doc_id").alias("auto_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("own_id"), "vector")
    built = V.build_vectors(V.encode_payloads(rows, "own_id").select("auto_id", "payload"))
    return V.cosine_topk(built, _query_vector(vectors), 8)


@query
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vectors")
    T.write_vectors(_vectors(spark, sf_dir), path)
    return T.read_vectors(spark, path).agg(F.count("*").alias("n"), F.max(F.size("vector")).cast("long").alias("dim"), F.round(F.sum("norm"), 2).alias("norms"))


@query
def topic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as segments and read back, checksums verified, up to what the global index holds."""
    root = new_path(spark, "log")
    S.write_topic(_topic_log(spark, sf_dir), root)
    kept = L.committed(S.scan_topic(spark, root, "click"), S.scan_global_index(spark, root, "click"))
    return kept.select("topic", "offset", "segment_base", F.col("payload").cast("string").alias("payload"), "crc_ok")


@query
def topic_bad_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last byte of a segment is flipped: its last record is flagged, and no other."""
    root = new_path(spark, "log")
    S.write_topic(_topic_log(spark, sf_dir).where("topic = 'view'"), root)
    store, place = fs.FileSystem.from_uri(f"{root}/topics/view/{0:020}.log")
    with store.open_input_stream(place) as f:
        data = f.read()
    with store.open_output_stream(place) as f:
        f.write(data[:-1] + bytes([data[-1] ^ 1]))
    return S.scan_topic(spark, root, "view", on_error="flag").select("offset", "segment_base", "crc_ok")


@query
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files under folders, some hidden and some of no document's extension, found and read again."""
    root = new_path(spark, "tree")
    kind = F.col("doc_id") % 5
    name = F.when(kind == 0, ".md").when(kind == 1, ".txt").when(kind == 2, ".TXT").when(kind == 3, ".bin").otherwise(".py")
    folder = F.when(F.col("lang") == "fr", F.concat(F.lit("."), "source")).otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), name).alias("path"), F.col("text").cast("binary").alias("content"))
    S.write_files(docs, root)
    return S.scan_documents(spark, root).select("path", "length", F.sha2("content", 256).alias("sha256"))


@query
def payload_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as one payload a file, numbered by name."""
    root = new_path(spark, "payloads")
    vectors = _vectors(spark, sf_dir)
    payloads = V.encode_payloads(vectors, None)
    S.write_files(payloads.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".bin")).alias("path"), F.col("payload").alias("content")), root)
    decoded = V.decode_payloads(S.scan_payload_dir(spark, root))
    return decoded.select("auto_id", "name", F.col("dim").cast("long").alias("dim"), F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("head"))


@query
def payload_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", crc32c(F.col("props").cast("binary")).alias("crc32c"))


@query
def facts_dump_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "facts")
    S.save_facts(R.dump_facts(R.fold_ops(_ops(spark, sf_dir))), path)
    state, bad = R.load_facts(S.scan_lines(spark, path, K.FACTS_MAX))
    if bad is not None:
        raise ValueError(f"line {bad} is bad")
    return state.members


@query
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as lines of text files, read over small ranges of bytes and numbered through all files."""
    path = new_path(spark, "text")
    table(spark, sf_dir, "documents").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select(F.coalesce("text", F.lit(""))).write.text(path)
    return S.scan_lines(spark, path, None, 1 << 18).select("seq", F.sha2("line", 256).alias("sha256"))


@query
def facts_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as five files of facts with a bad line in a later one: the files before it and its lines before count."""
    path = new_path(spark, "facts")
    line = F.when(F.col("seq") == 777, F.lit("SREM")).otherwise(F.concat_ws(" ", "op", "name", "a"))
    _ops(spark, sf_dir).repartitionByRange(5, "seq").sortWithinPartitions("seq").select(line.alias("line")).write.text(path)
    state, bad = R.load_facts(S.scan_lines(spark, path, K.FACTS_MAX, 1 << 14))
    return state.members.withColumn("bad", F.lit(bad).cast("long"))


@query
def kv_dump_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "kv")
    S.save_kv(M.fold_kv(_commands(spark, sf_dir)), path)
    return S.load_kv(spark, path)


@query
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "manifest")
    T.write_manifest(spark, D.build_manifest(_docs(spark, sf_dir)), path, 0, "", D.CHUNK_SIZE, D.OVERLAP, sf_dir)
    return T.read_manifest(spark, path).select("doc_id", "path", "offset", "length")


@query
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _docs(spark, sf_dir), new_path(spark, "state")
    files = D.state_from_chunks(D.assign_doc_ids(D.chunk_documents(docs)), D.hash_files(docs))
    T.write_state(spark, files, docs.select("doc_id").where("doc_id % 100 = 0"), path, 0, D.CHUNK_SIZE, D.OVERLAP, "", sf_dir)
    read, superseded, _ = T.read_state(spark, path)
    return read.select("path", "hash", F.size("doc_ids").cast("long").alias("n_ids")).unionByName(superseded.select(F.lit("superseded").alias("path"), F.lit("").alias("hash"), F.col("doc_id").alias("n_ids")))


# --- more of the document index and the algebra


@query
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.index_report(_refreshed(spark, sf_dir)[0])


@query
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("path", "content")
    index = D.build_index(docs, D.hashing_embedder(16))
    return D.validate_full(index.manifest, index.base, 16).select("check", "ok")


@query
def merged_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a manifest over all documents when only those with a vector have one and some are superseded."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vectors = _vectors(spark, sf_dir)
    return D.validate_merged(docs, vectors.where("doc_id % 2 = 0"), vectors.where("doc_id % 2 = 1"), docs.where("doc_id % 97 = 0"), 64)


@query
def index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full validation of an index that has gaps, too few chunks and vectors of another dimension."""
    docs = table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 97 != 5")
    return D.validate_full(docs, _vectors(spark, sf_dir), 63)


@query
def index_report_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an index that lists some of its chunks as superseded."""
    index, _ = _refreshed(spark, sf_dir)
    return D.index_report(replace(index, superseded=index.superseded.unionByName(index.manifest.where("doc_id % 50 = 7").select("doc_id"))))


@query
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full search over a refreshed index: base and delta, without superseded chunks, joined back to the sources."""
    index, _ = _refreshed(spark, sf_dir, _letters, ascii_only=True)
    docs = _before_after(spark, sf_dir, ascii_only=True)[1]
    found = D.search(index, _letters(["the quick brown fox jumps over a lazy dog"])[0], 8, docs=docs)
    return found.withColumn("score", F.round("score", 4))


@query
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits joined to a manifest of chunks without texts: their first bytes, cut anywhere, are read from the documents'
    files, and no others are."""
    root, vectors = new_path(spark, "tree"), _vectors(spark, sf_dir)
    docs = _docs(spark, sf_dir).select("path", "content")
    S.write_files(docs, root)
    manifest = D.manifest_from_chunks(D.assign_doc_ids(D.chunk_documents(docs)), embed_text=False)
    found = F.broadcast(V.cosine_topk(vectors, _query_vector(vectors), 8)).join(manifest, "doc_id")
    return D.read_snippets(found, root, 61).select("doc_id", "score", "path", "offset", F.hex("snippet").alias("snippet"))


@query
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a table by the ids of every seventh document: only the row groups that may hold them are read."""
    path = new_path(spark, "vectors")
    T.write_vectors(_vectors(spark, sf_dir), path, 1 << 15)
    wanted = table(spark, sf_dir, "documents").where("doc_id % 7 = 3").select("doc_id")
    return T.lookup(spark, path, wanted).select("doc_id", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("head"))


@query
def contains_ids_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vectors")
    T.write_vectors(_vectors(spark, sf_dir), path, 1 << 15)
    return T.contains(spark, path, table(spark, sf_dir, "documents").select("doc_id"))


@query
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a refreshed index after compaction: ids are dense again."""
    index, _ = _refreshed(spark, sf_dir)
    docs = _before_after(spark, sf_dir)[1].select("path", "content")
    return D.compact(index, docs, D.hashing_embedder(16)).manifest.select("doc_id", "path", "offset", "length")


@query
def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.array("lang", "source").alias("tags"))
    state = R.fold_ops(R.tag(docs))
    return R.files_with(state, "fr").withColumn("of", F.lit("files")).unionByName(R.tags_of(state, "7").withColumn("of", F.lit("tags")))


@query
def stored_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation's domain kept as a set, and its inverse as a relation, beside what the log had."""
    text = lambda c: F.col(c).cast("string")
    customer = table(spark, sf_dir, "customer")
    ops = customer.select(F.col("c_custkey").cast("long").alias("seq"), F.lit("RADD").alias("op"), F.lit("lives_in").alias("name"), text("c_custkey").alias("a"), text("c_nationkey").alias("b"))
    relation = R.pairs(R.fold_ops(ops), "lives_in")
    state = R.fold_ops(R.store_inverse(R.store_domain(ops, relation, "customers"), relation, "has"))
    return R.members(state, "customers").select(F.lit("customers").alias("name"), "atom").unionByName(R.select(R.pairs(state, "has"), "first", "1").select(F.lit("has 1").alias("name"), "atom"))


@query
def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.members(R.fold_ops(_ops(spark, sf_dir)), "s3")


@query
def rel_select_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select(_relations(spark, sf_dir)["supplies"], "second", 5)


@query
def kv_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return M.keys(M.exists(M.fold_kv(_commands(spark, sf_dir)), wanted))


@query
def path_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("path"), F.lit(False).alias("is_dir"), F.octet_length("text").cast("long").alias("length"))
    return S.path_rollup(files)


# --- streams over the tables' files, run until they have read all of them


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as they come; the pattern lets one file be a stream too."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}?.parquet")


@query
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fold")
    ops = _ops_of(_stream(spark, sf_dir, "events"))
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n:06}")
    jobs.stream_fold(ops).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(f"{path}/out")
    last = states.agg(F.max("batch").alias("batch"))
    return states.join(F.broadcast(last), "batch").where("kind = 'S' AND op = 'SADD'").select(F.col("name").alias("set"), F.col("a").alias("atom"))


@query
def stream_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "slice")
    lines = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("props").alias("line"))
    found = jobs.stream_slice(lines, field=("k", "7"), jsonl=True)
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").select("path")


@query
def stream_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tail")
    vectors = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("auto_id"), F.col("embedding").alias("vector"))
    payloads = V.encode_payloads(vectors, None).select("auto_id", "payload")
    jobs.stream_vectors(payloads, f"{path}/delta", f"{path}/check").awaitTermination()
    delta = spark.read.parquet(f"{path}/delta").select("doc_id", "vector")
    return V.cosine_topk(delta, _query_vector(_vectors(spark, sf_dir)), 8)


@query
def stream_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as messages of a topic whose files a stream tails: the first half of its segments is there at the first
    run, all are at the second, which goes on where the first ended."""
    path = new_path(spark, "tail")
    vectors = _vectors(spark, sf_dir)
    log = dense_ids(V.encode_payloads(vectors, "doc_id").select("doc_id", "payload"), ["doc_id"], "offset").select(F.lit("vectors").alias("topic"), "offset", (F.floor(F.col("offset") / 100) * 100).cast("long").alias("segment_base"), "payload")
    half = log.count() // 2
    for part in (log.where(F.col("segment_base") < half), log):
        S.write_topic(part, path)
        tail = TS.stream_topic(spark, path, "vectors").select(F.col("offset").alias("auto_id"), "payload")
        jobs.stream_vectors(tail, f"{path}/delta", f"{path}/check").awaitTermination()
    delta = spark.read.parquet(f"{path}/delta")
    hits = V.cosine_topk(delta.select("doc_id", "vector"), _query_vector(vectors), 8)
    size = delta.agg(F.count("*").alias("n"), F.countDistinct("batch").alias("batches"))
    return hits.join(F.broadcast(size))
