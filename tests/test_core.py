import struct
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.functions.checksum import crc32c, crc32c_many
from tessera.operators import documents as D
from tessera.operators import formulas as E
from tessera.operators import keyed as M
from tessera.operators import lines as K
from tessera.operators import series as W
from tessera.operators import topics as L
from tessera.operators import vectors as V
from tessera.operators.ids import dense_ids
from tessera.sources import files as S
from tessera.sources import tables as T
from tessera.streaming import jobs

ROWS = [(100, [1.0, 0.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0, 0.0]), (300, [0.9, 0.1, 0.0, 0.0])]


def payload(v, n=None):
    return struct.pack(f"<I{len(v)}f", len(v), *v) + (b"" if n is None else struct.pack("<Q", n))


def hits(df):
    return [(r["doc_id"], r["score"]) for r in df.collect()]


def test_search_is_the_same_for_any_partitions(spark):
    for n in (1, 2, 4):
        vectors = spark.createDataFrame(ROWS, "doc_id long, vector array<float>").repartition(n)
        assert hits(V.cosine_topk(vectors, [1, 0, 0, 0], 2)) == [(100, 1.0), (300, 0.993884)]
        queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0, 0.0])], "query_id long, vector array<float>")
        got = V.cosine_topk_batch(vectors, queries, 2).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["doc_id"], r["score"]) for r in got] == [(1, 100, 1.0), (1, 300, 0.993884), (2, 200, 1.0), (2, 300, 0.110432)]
    with pytest.raises(V.VectorError):
        V.cosine_topk(vectors, [0, 0, 0, 0], 2)
    with pytest.raises(Exception, match="another dimension"):
        V.cosine_topk(vectors, [1, 0], 2).collect()
    assert hits(V.cosine_topk(vectors.limit(0), [1, 0, 0, 0], 2)) == []
    a = V.cosine_topk(vectors, [1, 0, 0, 0], 2)
    assert V.same_hits(a, a) and not V.same_hits(a, V.cosine_topk(vectors, [1, 0, 0, 0], 3))


def test_batch_search_refuses_what_single_search_does(spark):
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, vector array<float>")
    ask = lambda rows: spark.createDataFrame(rows, "query_id long, vector array<float>")
    one = ask([(1, [1.0, 0.0])])
    for bad in ([(1, [1.0, 0.0]), (2, [0.0, 0.0])], [(1, [1.0]), (2, [1.0, 2.0, 3.0])], [(1, None)], [(1, [1.0, None])], [(1, [float("nan"), 1.0])], [(1, [])]):
        with pytest.raises(Exception, match="vector"):
            V.cosine_topk_batch(of(bad), one, 2).collect()
        with pytest.raises(Exception, match="a vector of"):
            V.cosine_topk(of(bad), [1.0, 0.0], 2).collect()
        with pytest.raises(V.VectorError):
            V.cosine_topk_batch(of([(1, [1.0, 0.0])]), ask(bad), 2)
    assert V.cosine_topk_batch(of([]), one, 2).isEmpty() and V.cosine_topk_batch(of([(1, [1.0, 0.0])]), ask([]), 2).isEmpty()


def test_batch_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(700, 12)).astype(np.float32), rng.normal(size=(60, 12)).astype(np.float32)
    x[100:140] = x[5]  # ties go to the smaller id
    q[3] = x[5] * 3
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, vector array<float>")
    a, b = x.astype(float), q.astype(float)
    s = (b / np.linalg.norm(b, axis=1, keepdims=True)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T
    s[:, 100:140] = s[:, [5]]
    for k in (1, 7, 50):
        got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in V.cosine_topk_batch(vectors, queries, k).collect()}
        want = np.argsort(-s, axis=1, kind="stable")[:, :k]
        assert len(got) == 60 * k
        assert all(got[i, r + 1] == (want[i, r], pytest.approx(s[i, want[i, r]], abs=1e-6)) for i in range(60) for r in range(k))
    monkeypatch.setattr(V, "PRODUCT", 100)
    rows, ids, score = V._best(b, a, b.astype(np.float32) / np.linalg.norm(b, axis=1, keepdims=True).astype(np.float32), a.astype(np.float32) / np.linalg.norm(a, axis=1, keepdims=True).astype(np.float32), np.arange(700), 3)
    assert len(rows) == 180 and (score.reshape(60, 3)[:, 0] == score.reshape(60, 3).max(axis=1)).all()


def test_payloads(spark):
    rows = [(0, payload(ROWS[0][1], 100)), (1, payload(ROWS[1][1])), (2, payload(ROWS[2][1], 2**64 - 1))]
    built = V.build_vectors(spark.createDataFrame(rows, "auto_id long, payload binary"))
    assert hits(V.cosine_topk(built, [1, 0, 0, 0], 2)) == [(100, 1.0), (2, 0.993884)]
    for bad in (payload([1.0, 2.0])[:-1], payload([]), b"", None, payload([1.0], 2**63)):
        with pytest.raises(V.VectorError):
            V.build_vectors(spark.createDataFrame([(0, bad)], "auto_id long, payload binary"))
    with pytest.raises(V.VectorError):
        V.build_vectors(spark.createDataFrame([(0, payload([1.0, 2.0])), (1, payload([1.0]))], "auto_id long, payload binary"))
    with pytest.raises(Exception, match="norm zero"):
        V.build_vectors(spark.createDataFrame([(0, payload([0.0, 0.0]))], "auto_id long, payload binary")).collect()


def test_payloads_beside_columns_of_any_name(spark):
    odd = {"a`b": 1, "c.d": "x", "explicit_id": 5, "DIM": 6, "ok": None, "payload": b"old"}
    rows = spark.createDataFrame([(0, [1.0, 2.0], *odd.values()), (None, [3.0], *odd.values())], "doc_id long, vector array<float>, `a``b` long, `c.d` string, explicit_id long, DIM long, ok boolean, payload binary")
    got = V.decode_payloads(V.encode_payloads(rows))
    assert sorted(got.columns) == sorted(["doc_id", "a`b", "c.d", "payload", "explicit_id", "dim", "vector", "ok"])
    assert sorted((tuple(r["vector"]), r["explicit_id"], r["dim"], r["ok"], r["a`b"], r["c.d"]) for r in got.collect()) == [((1.0, 2.0), 0, 2, True, 1, "x"), ((3.0,), None, 1, True, 1, "x")]


def test_vector_tables(spark, tmp_path):
    vectors = spark.createDataFrame(ROWS, "doc_id long, vector array<float>")
    T.write_vectors(vectors, str(tmp_path / "v"))
    assert T.read_vectors(spark, str(tmp_path / "v")).count() == 3
    with pytest.raises(V.VectorError):
        T.write_vectors(vectors.limit(0), str(tmp_path / "w"))


def test_chunk_arithmetic(spark):
    sizes = [0, 1, 799, 800, 801, 1500, 1501]
    docs = spark.createDataFrame([(f"d{n:05}", b"x" * n) for n in sizes], "path string, content binary")
    got = {r["path"]: r["count"] for r in D.chunk_documents(docs).groupBy("path").count().collect()}
    assert [got.get(f"d{n:05}", 0) for n in sizes] == [0, 1, 1, 1, 2, 2, 3]
    with pytest.raises(D.DocumentIndexError):
        D.chunk_documents(docs, 10, 10)


def test_refresh_equals_fresh_build(spark):
    embedder = D.hashing_embedder(8)
    make = lambda rows: spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary")
    index = D.build_index(make([("a", "one two " * 200), ("b", "three"), ("c", "four"), ("e", "")]), embedder)
    after = make([("a", "one two " * 150), ("c", "four"), ("d", "five é" * 300), ("e", "")])
    fresh, plan = D.apply_refresh(index, after, embedder)
    assert {(r["path"], r["action"]) for r in plan.collect()} == {("a", "changed"), ("b", "deleted"), ("d", "added")}
    rebuilt = D.build_index(after, embedder)
    multiset = lambda i: sorted((r["path"], r["offset"], r["length"]) for r in i.manifest.collect())
    assert multiset(fresh) == multiset(rebuilt)
    assert D.validate_merged(fresh.manifest, fresh.base, fresh.delta, fresh.superseded, fresh.dim).isEmpty()
    assert all(r["ok"] for r in D.index_report(fresh).collect()) and all(r["ok"] for r in D.index_report(index).collect())
    found = D.search(fresh, embedder(["five"])[0], 2, docs=after).collect()
    assert found[0]["path"] in ("c", "d", "a") and all(r["snippet"] for r in found)
    same, none = D.apply_refresh(fresh, after, embedder)
    assert none.isEmpty() and same is fresh
    with pytest.raises(D.DocumentIndexError):
        D.apply_refresh(fresh, after, embedder, model="other")


def test_search_goldens(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0, 0.0])], "doc_id long, vector array<float>")
    delta = spark.createDataFrame([(3, [0.9, 0.1, 0.0, 0.0])], "doc_id long, vector array<float>")
    none = vectors.select("doc_id").limit(0)
    manifest = spark.createDataFrame([(3, "docs/auth.md", 0, 4, "auth")], "doc_id long, path string, offset long, length long, text string")
    assert hits(V.cosine_topk_merged(vectors, None, none, [1, 0, 0, 0], 1)) == [(0, 1.0)]
    top = V.cosine_topk_merged(vectors, delta, vectors.where("doc_id = 0").select("doc_id"), [1, 0, 0, 0], 2)
    got = D.hits_with_sources(top, manifest).collect()
    assert [(r["doc_id"], r["score"], r["path"], r["snippet"]) for r in got] == [(3, 0.993884, "docs/auth.md", "auth"), (1, 0.0, "", "")]


def test_manifest_and_state(spark, tmp_path):
    records = spark.createDataFrame([(0, "a", 0, 3, "abc"), (1, "b", 0, 1, "x")], "doc_id long, path string, offset long, length long, text string")
    where = f"file://{tmp_path}/m"
    for text in (True, False):  # the second version takes the first one's place
        T.write_manifest(spark, records, where, 4, "m", 800, 100, "r", embed_text=text)
        assert sorted((r["doc_id"], r["path"], r["text"]) for r in T.read_manifest(spark, where).collect()) == [(0, "a", "abc" if text else None), (1, "b", "x" if text else None)]
    files = spark.createDataFrame([("a", "h", [0, 1]), ("e", "g", [])], "path string, hash string, doc_ids array<long>")
    T.write_state(spark, files, records.select("doc_id").where("doc_id = 1"), f"file://{tmp_path}/s", 2, 800, 100, "m", "r")
    got, superseded, scalars = T.read_state(spark, f"file://{tmp_path}/s")
    assert sorted((r["path"], r["hash"], r["doc_ids"]) for r in got.collect()) == [("a", "h", [0, 1]), ("e", "g", [])]
    assert [r[0] for r in superseded.collect()] == [1] and scalars["next_doc_id"] == 2
    (tmp_path / "x.json").write_text('{"version": 2, "records": [{"doc_id": 1}]}')
    with pytest.raises(Exception, match="version"):
        T.read_manifest(spark, f"file://{tmp_path}/x.json", versioned=False).collect()


def test_topics(spark):
    new = spark.createDataFrame([(0, "events", b"hello"), (1, "events", b"world"), (2, "events", b"again"), (9, "other", b"x")], "seq long, topic string, payload binary")
    empty = spark.createDataFrame([], "topic string, offset long, payload binary")
    log = L.append(empty, new)
    log = log.union(L.append(log, spark.createDataFrame([(0, "events", b"after")], "seq long, topic string, payload binary")))
    log = log.withColumn("segment_base", F.when(F.col("offset") < 2, 0).otherwise(2).cast("long"))
    rows = lambda df: [(r["offset"], bytes(r["payload"])) for r in df.orderBy("offset").collect()]
    everything = [(0, b"hello"), (1, b"world"), (2, b"again"), (3, b"after")]
    assert rows(L.fetch(log, "events", 0, 4096)) == everything and rows(L.fetch(log, "events", 2)) == everything[2:] and rows(L.fetch(log, "events", 99)) == []
    assert rows(L.fetch(log, "events", 0, 14)) == everything[:2] and rows(L.fetch(log, "events", 0, 4)) == []
    assert rows(L.fetch_batch(log, "events", 0, 4096)) == everything[:2] and rows(L.fetch_batch(log, "events", 2)) == everything[2:]
    assert rows(L.fetch_batch(log, "events", 0, 13)) == everything[:1] and rows(L.replay(log, "events", 1)) == everything[1:]
    offsets = spark.createDataFrame([], "group string, topic string, offset long, seq long")
    offsets = L.commit(L.commit(offsets, "group1", "events", 4), "group1", "events", 3)
    assert L.committed_offset(offsets, "group1", "events") == 3 and L.committed_offset(offsets, "g", "events") == 0
    assert rows(L.read_from_group(log, offsets, "group1", "events")) == everything[3:]
    index = log.where("offset < 3").select("topic", "offset", "segment_base")
    assert rows(L.committed(log.where("topic = 'events'"), index)) == everything[:3]
    for bad in (("bad/name", b"x"), ("ok", b"x" * 5000)):
        with pytest.raises(L.TopicError):
            L.append(empty, spark.createDataFrame([(0, *bad)], "seq long, topic string, payload binary"))
    for call in (lambda: L.fetch(log, "events", -1), lambda: L.fetch(log, "events", 0, 0), lambda: L.commit(offsets, "g", "t", -1)):
        with pytest.raises(L.TopicError):
            call()


def test_topic_files(spark, tmp_path):
    folder = tmp_path / "topics" / "events"
    folder.mkdir(parents=True)
    record = lambda p: struct.pack("<II", len(p), int(crc32c_many([p])[0])) + p
    (folder / f"{0:020}.log").write_bytes(record(b"hello") + record(b"world"))
    (folder / f"{2:020}.log").write_bytes(record(b"again") + record(b"orphan"))
    (folder / "global.idx").write_bytes(struct.pack("<3Q", 0, 0, 2))
    log = S.scan_topic(spark, str(tmp_path), "events")
    assert [(r["offset"], bytes(r["payload"]), r["crc_ok"]) for r in log.orderBy("offset").collect()] == [(0, b"hello", True), (1, b"world", True), (2, b"again", True), (3, b"orphan", True)]
    assert L.committed(log, S.scan_global_index(spark, str(tmp_path), "events")).count() == 3
    (folder / f"{2:020}.log").write_bytes(record(b"again")[:-1] + b"!")
    assert S.scan_topic(spark, str(tmp_path), "events", "flag").where("NOT crc_ok").count() == 1
    with pytest.raises(Exception, match="checksum"):
        S.scan_topic(spark, str(tmp_path), "events").collect()
    (folder / f"{2:020}.log").write_bytes(record(b"again")[:-1])
    with pytest.raises(Exception, match="truncated"):
        S.scan_topic(spark, str(tmp_path), "events", "flag").collect()


def test_crc32c(spark):
    assert list(crc32c_many([b"123456789", b"", b"a" * 4096, b"123456789"])) == [0xE3069283, 0, crc32c_many([b"a" * 4096])[0], 0xE3069283]
    df = spark.createDataFrame([(b"123456789",), (None,)], "p binary")
    assert [r[0] for r in df.select(crc32c("p")).collect()] == [0xE3069283, None]


def test_files(spark, tmp_path):
    for name, data in {"a.txt": "é\n", "__init__.py": "", "sub/.dot.py": "x", "sub/UP.MD": "x", ".git/x.md": "x", "node_modules/y.js": "x", "sub/deep/z.zig": "zz", "sub/.md": "hidden", "b.bin": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    (tmp_path / "empty").mkdir()
    got = S.scan_documents(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["path"], r["length"]) for r in got] == [("__init__.py", 0), ("a.txt", 3), ("sub/.dot.py", 1), ("sub/deep/z.zig", 2)]
    listing = S.list_files(spark, str(tmp_path))
    one = S.path_summary(listing).first()
    assert (one["files"], one["dirs"], one["bytes"]) == (9, 5, 3 + 1 + 1 + 1 + 1 + 2 + 6 + 2)
    assert S.path_rollup(listing).where("dir IS NULL AND ext IS NULL").first()["files"] == 9


def test_payload_dir(spark, tmp_path):
    for name, data in (("00-x.bin", payload(ROWS[0][1], 100)), ("01-y.bin", payload(ROWS[1][1])), ("02-z.bin", payload(ROWS[2][1]))):
        (tmp_path / name).write_bytes(data)
    built = V.build_vectors(S.scan_payload_dir(spark, str(tmp_path)))
    assert hits(V.cosine_topk(built, [1, 0, 0, 0], 2)) == [(100, 1.0), (2, 0.993884)]


def test_lines(spark):
    texts = spark.createDataFrame([("a", "alpha\nneedle one\nlast"), ("b", "needle two\r\nplain\n"), ("c", ""), ("d", "\n\n" + "x" * 20 + "\nÄneedle"), ("e", None)], "path string, text string")
    lines = K.lines_of(texts, max_len=15)
    assert [(r["path"], r["line_no"]) for r in K.grep(lines, "needle").orderBy("path").collect()] == [("a", 2), ("b", 1), ("d", 4)]
    assert K.grep(lines, "NEEDLE", ignore_case=True).count() == 3 and K.grep(lines, "äNEEDLE", ignore_case=True).isEmpty()
    assert {r["path"]: r["n"] for r in K.grep_count(lines, texts, "needle").collect()} == {"a": 1, "b": 1, "c": 0, "d": 1, "e": 0}
    assert [r["path"] for r in K.grep_files(lines, "two").collect()] == ["b"]
    assert lines.where("path = 'b'").count() == 2 and lines.where("path = 'd'").count() == 3
    with pytest.raises(ValueError):
        K.grep(lines, "")


def test_jsonl(spark):
    rows = ['{"ts":1,"level":"info","status":200,"msg":"ok"}', '{"ts":2,"level":"error","status": 500,"msg":"time \\" out"}', '{"ts":3,"n":{"status":"500"},"status":404,"level":"error"}', "no json"]
    lines = spark.createDataFrame([("f", k + 1, r) for k, r in enumerate(rows)], "path string, line_no long, line string")
    no = lambda df: [r["line_no"] for r in df.orderBy("line_no").collect()]
    assert no(K.jsonl_field_eq(lines, "status", "500")) == [2] and no(K.jsonl_field_eq(lines, "status", "500", first_match=True)) == [2, 3]
    assert K.slice_count(lines, level="error", jsonl=True).first()["n"] == 2 and no(K.slice_lines(lines, level="error")) == []
    assert no(K.slice_lines(lines, contains_text="out", field=("level", "error"), jsonl=True)) == [2] and len(no(K.lines_containing(lines, ""))) == 4


def test_kv(spark, tmp_path):
    cmds = [("SET", "user", "42"), ("SET", "greeting", "hello"), ("INCR", "user", None), ("INCR", "greeting", None), ("DECR", "new", None), ("DEL", "gone", None), ("SET", "x", "1"), ("DEL", "x", None), ("SET", "neg", "-5"), ("DECR", "neg", None), ("DEL", "back", None), ("INCR", "back", None)]
    commands = spark.createDataFrame([(k, *c) for k, c in enumerate(cmds)], "seq long, cmd string, key string, value string")
    kv = M.fold_kv(commands)
    assert {r["key"]: r["int_value"] if r["kind"] == "int" else r["str_value"] for r in kv.collect()} == {"user": 43, "greeting": "hello", "new": -1, "neg": -6, "back": 1}
    assert [r["seq"] for r in M.kv_errors(commands).collect()] == [3]
    wanted = spark.createDataFrame([(0, "x"), (1, "user"), (2, "greeting")], "position int, key string")
    assert [r["value"] for r in M.mget(kv, wanted).collect()] == [None, "43", "hello"]
    assert M.dbsize(kv).first()["n"] == 5 and M.exists(kv, wanted).count() == 2
    S.save_kv(kv, str(tmp_path / "kv"))
    assert sorted(map(tuple, S.load_kv(spark, str(tmp_path / "kv")).collect())) == sorted(map(tuple, kv.collect()))
    (tmp_path / "dump").write_text("# miniature\n\nI user 42\nS greeting hello you\nI bad x\nI short\nZ q 1\n")
    assert {r["key"]: r["int_value"] or r["str_value"] for r in S.load_kv(spark, str(tmp_path / "dump")).collect()} == {"user": 42, "greeting": "hello you"}


def test_series(spark):
    rng = np.random.default_rng(1)
    data = {"a": [7, 1, 5, 3, 6, 4], "b": [5, 4, 3], "c": [2], "m": [-2, 1, -3, 4, -1, 2, 1, -5, 4], "n": [-3, -1, -2], "z": rng.integers(-9, 9, 300).tolist()}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "key string, o int, v double").repartition(5)
    trade = {k: max([0, *(x[j] - x[i] for i in range(len(x)) for j in range(i, len(x)))]) for k, x in data.items()}
    run = {k: max(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)) for k, x in data.items()}
    assert {r["key"]: r["best"] for r in W.best_trade(df, "key", "o", "v").collect()} == trade and trade["a"] == 5
    assert {r["key"]: r["best"] for r in W.max_run_sum(df, "key", "o", "v").collect()} == run and run["m"] == 6


def test_formulas(spark):
    assert [len(f.enumerate_formulas(n)) for n in (1, 2, 3)] == [9, 63, 468]
    assert [f.rpn(x) for x in f.enumerate_formulas(1)[:4]] == ["1 1 eml", "x 1 eml", "f 1 eml", "1 x eml"]
    points = spark.createDataFrame([("e", 0.1, 1.105170918), ("e", 0.5, 1.648721271), ("e", 1.0, 2.718281828), ("p", 1.0, 2.0), ("p", 2.0, 5.0), ("p", 3.0, 10.0), ("p", 4.0, 17.0)], "group string, x double, y double")
    best = {r["group"]: r for r in E.fit_formulas(points, 2).collect()}
    assert best["e"]["rpn"] == "x 1 eml" and best["e"]["mse"] < 1e-6
    assert np.isclose({r["group"]: r["mse"] for r in E.baseline_mse(points).collect()}["p"], 32.25)
    line = spark.createDataFrame([("l", x, float(np.exp(x) - np.log(4.0))) for x in (0.1, 0.5, 0.9)], "group string, x double, y double")
    tuned = E.fit_formulas(line, 1, tune=True).first()
    assert tuned["rpn"] == "x f eml" and tuned["constants"] == [4.0] and tuned["mse"] < 1e-12
    with_goal = E.fit_formulas(line, 1, goal_mse=0.5, tune=True).first()
    assert with_goal["mse"] <= 0.5 and f.enumerate_formulas(1)[[f.rpn(x) for x in f.enumerate_formulas(1)].index(with_goal["rpn"])] != "x f eml"
    some = f.enumerate_formulas(2)[:40]
    both = [{(r["group"], r["formula_id"]): r["mse"] for r in E.score_formulas(points, x).collect()} for x in (some, some * 2)]
    assert all(np.isclose(both[0][k], both[1][k]) or both[0][k] == both[1][k] for k in both[0])
    assert E.fit_formulas(points, 1, goal_mse=1e9).where("rpn = '1 1 eml'").count() == 2
    nan = spark.createDataFrame([(-1.0,)], "x double").select(f.predict(("eml", "1", "x"), F.col("x"))).first()[0]
    assert np.isnan(nan)


def test_tuning_equals_descents_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(E, "POINTS_MAX", 4)
    rng = np.random.default_rng(2)
    data = {g: [(x, float(np.exp(x * s) - np.log(c) + rng.normal() * 0.05)) for x in rng.uniform(0.1, 1.2, n).tolist()] for g, s, c, n in (("a", 1.0, 3.3, 11), ("b", 0.4, 0.7, 5), ("c", 1.5, 2.0, 3))}
    points = spark.createDataFrame([(g, *p) for g, ps in data.items() for p in ps], "group string, x double, y double")
    formulas = f.enumerate_formulas(1)

    def error(form, at, ps):
        e = E._values(f.with_constants(form, iter(at)), np.array([p[0] for p in ps]), {}) - np.array([p[1] for p in ps])
        return float((e * e).mean()) if np.isfinite(e).all() else float("inf")

    got = {r["group"]: r for r in E.fit_formulas(points, 1, tune=True).collect()}
    for g, ps in data.items():
        best = (float("inf"), 0, [])
        for k, form in enumerate(formulas):
            at = f.constants(form)
            for _ in range(8):
                before = list(at)
                for i in range(len(at)):
                    tries = [at[i], *(max(v, 1e-6) for v in (at[i] * 0.25, at[i] * 0.5, at[i] * 2, at[i] * 4, at[i] + 0.1, at[i] - 0.1, at[i] + 1, at[i] - 1, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0))]
                    at[i] = min(tries, key=lambda v: error(form, [*at[:i], v, *at[i + 1 :]], ps))
                if at == before:
                    break
            best = min(best, (error(form, at, ps), k, at), key=lambda b: b[:2])
        assert got[g]["mse"] == pytest.approx(best[0], rel=1e-6) and f.rpn(formulas[best[1]]) == got[g]["rpn"]


def test_bounds_stop_sums_and_lose_no_better_probe():
    rng = np.random.default_rng(4)
    x = rng.uniform(0.1, 1.2, 5_000)
    y = np.exp(x) - np.log(2.5) + rng.normal(size=len(x)) * 0.01
    forms = f.enumerate_formulas(2)
    free = set().union(*map(E._free, forms))
    tries, want, whole = [], set(), 0
    for k, form in enumerate(forms):
        at = f.constants(form)
        for p, v in enumerate(E._probes(1.0)):
            tried = f.with_constants(form, iter([v, *at[1:]])) if at else form
            e = (E._values(tried, x, {}) - y) ** 2
            bound = float(e.sum()) if p == 0 and np.isfinite(e).all() else bound if p else float("inf")
            if p and at:
                tries.append((k, p, tried, bound))
                whole += len(x)
                if np.isfinite(e).all() and e.sum() < bound * (1 - 1e-9):
                    want.add((k, p))
    got, computed = E.errors_below(x, y, tries, free)
    assert want <= {(k, p) for k, p, _ in got} and len(want) > 50
    for k, p, e in got:
        tried = next(t for a, b, t, _ in tries if (a, b) == (k, p))
        assert np.isclose(e, ((E._values(tried, x, {}) - y) ** 2).sum())
    assert computed < 0.7 * whole
    assert E.errors_below(x[:0], y[:0], tries[:2], free)[0] == [(*tries[0][:2], 0.0), (*tries[1][:2], 0.0)]


def test_groups_that_meet_the_goal_leave(spark, monkeypatch):
    """One group meets the goal by a formula of one operator, one needs two, one never does."""
    xs = [0.2, 0.5, 0.9, 1.1]
    data = {"one": [float(np.exp(x) - np.log(3.0)) for x in xs], "two": [float(np.exp(np.exp(x)) - np.log(2.0)) for x in xs], "none": [1e5, -1e5, 3.0, 7.0]}
    points = spark.createDataFrame([(g, x, y) for g, ys in data.items() for x, y in zip(xs, ys, strict=True)], "group string, x double, y double")
    tried = []
    descended = E._descended
    monkeypatch.setattr(E, "_descended", lambda parts, groups, forms: tried.append((sorted(r["group"] for r in groups.collect()), len(forms))) or descended(parts, groups, forms))
    got = {r["group"]: r for r in E.fit_formulas(points, 2, goal_mse=1e-3, tune=True).collect()}
    assert tried == [(["none", "one", "two"], 9), (["none", "two"], 54)]
    assert got["one"]["rpn"] == "x f eml" and got["one"]["constants"] == [3.0] and got["two"]["mse"] <= 1e-3 < got["none"]["mse"]
    assert got["none"]["rpn"] == next(r["rpn"] for r in E.fit_formulas(points.where("group = 'none'"), 2, tune=True).collect())


def test_dense_ids(spark):
    df = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "v int").repartition(4)
    got = dense_ids(df, ["v"], "n", start=10).orderBy("v").collect()
    assert [r["n"] for r in got] == list(range(10, 111)) and dense_ids(df.limit(0), ["v"], "n").isEmpty()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(k, payload(v)) for k, v in ROWS], "auto_id long, payload binary").write.parquet(str(source))
    stream = spark.readStream.schema("auto_id long, payload binary").parquet(str(source))
    jobs.stream_vectors(stream, str(tmp_path / "delta"), str(tmp_path / "check")).awaitTermination()
    delta = spark.read.parquet(str(tmp_path / "delta")).select("doc_id", "vector")
    assert hits(V.cosine_topk(delta, [1, 0, 0, 0], 2)) == [(100, 1.0), (300, 0.993884)]
    ops = spark.createDataFrame([(0, "SADD", "s", "a", None), (1, "SADD", "s", "b", None), (2, "SREM", "s", "a", None)], "seq long, op string, name string, a string, b string")
    ops.write.parquet(str(tmp_path / "ops"))
    folded = jobs.stream_fold(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops")))
    q = folded.writeStream.outputMode("complete").format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["a"], r["op"]) for r in spark.table("folded").orderBy("a").collect()] == [("a", "SREM"), ("b", "SADD")]
    spark.createDataFrame([("x error",), ("y",)], "line string").write.parquet(str(tmp_path / "lines"))
    q = jobs.stream_slice(spark.readStream.schema("line string").parquet(str(tmp_path / "lines")), contains_text="error").writeStream.format("memory").queryName("sliced").start()
    q.processAllAvailable()
    q.stop()
    assert [r["line"] for r in spark.table("sliced").collect()] == ["x error"]


def test_written_tables_and_workspaces(spark, tmp_path, monkeypatch):
    from tessera import session

    df = session.written(spark.range(3), "x")
    assert df.count() == 3 and session.shared_folder(spark).startswith("file:")
    with session.workspace(spark, "one") as place:
        inner = session.written(spark.range(4), "y")
        assert inner.inputFiles()[0].startswith(place)
        with session.workspace(spark, "two") as deeper:
            assert deeper.startswith(place) and session.new_path(spark, "z").startswith(deeper)
    assert not session.new_path(spark, "x").startswith(place) and inner.count() == 4
    session.discard(spark, place)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        inner.collect()
    assert df.count() == 3
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(session.SharedFolderError):
        session.shared_folder(bare)
