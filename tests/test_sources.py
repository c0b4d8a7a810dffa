"""Sources over splits of files, topics as a data source, atomic pointers and ranged reads."""

import io
import random
import struct
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.operators import documents as D
from tessera.operators import relations as R
from tessera.operators.topics import TopicError
from tessera.sources import files as S
from tessera.sources import tables as T
from tessera.sources import topics as TS
from tessera.sources.splits import lines_from, split_lines


def plain(data):
    """``(number, line)`` as a scan of the whole file gives them."""
    parts = data.split(b"\n")
    return [(k + 1, x) for k, x in enumerate(parts) if k < len(parts) - 1 or x]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_every_line_is_in_one_split(block):
    rng = random.Random(block)
    texts = [b"", b"\n", b"a", b"a\n", b"\n\n\n", b"\na", b"ab\n\ncd\n"] + [bytes(rng.choice(b"ab\n\n") for _ in range(rng.randint(1, 90))) for _ in range(40)]
    for data in texts:
        for size in (1, 2, 5, 17, 100):
            got = [x for start in range(0, len(data), size) for x in lines_from(io.BytesIO(data), start, min(start + size, len(data)), None, block)]
            assert got == [x for _, x in plain(data)], (data, size)
            capped = [x for start in range(0, len(data), size) for x in lines_from(io.BytesIO(data), start, min(start + size, len(data)), 4, block)]
            assert capped == [x if len(x) <= 4 else None for _, x in plain(data)]


def test_lines_of_split_files_have_the_numbers_of_a_plain_scan(spark, tmp_path):
    rng = random.Random(1)
    files = {"a.txt": b"", "b.txt": b"\n", "c.txt": b"x" * 5_000 + b"\r\nlast", "d/e.txt": "é\nßß\n".encode() * 300, "_no.txt": b"n\n", "d/.no.txt": b"n\n"}
    files |= {f"f{k}.txt": b"\n".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(200)) for k in range(3)}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want, seq = [], 0
    for name in sorted(n for n in files if "no" not in n):
        for no, line in plain(files[name]):
            want.append((f"{tmp_path}/{name}", no, line.decode(), seq + no))
        seq += len(plain(files[name]))
    got = S.scan_lines(spark, str(tmp_path), None, 137)
    assert got.columns == ["path", "line_no", "line", "seq"] and sorted(map(tuple, got.collect())) == sorted(want)
    few = S.scan_lines(spark, [f"{tmp_path}/f1.txt", f"{tmp_path}/c.txt"], 4_000, 1_000).collect()
    assert {(r["path"].rpartition("/")[2], r["line_no"]) for r in few} == {("c.txt", 2)} | {("f1.txt", no) for no, _ in plain(files["f1.txt"])}
    assert min(r["seq"] for r in few if "f1" in r["path"]) == 3  # the line that is left out counts
    assert S.scan_lines(spark, f"{tmp_path}/a.txt").isEmpty()
    listing = spark.createDataFrame([(f"{tmp_path}/f0.txt", len(files["f0.txt"]))], "path string, length long")
    assert split_lines(listing, None, 64).rdd.getNumPartitions() >= len(files["f0.txt"]) // 64
    with pytest.raises(FileNotFoundError):
        S.scan_lines(spark, f"{tmp_path}/none")


def test_facts_of_several_files_are_one_log(spark, tmp_path):
    """A bad line in the second of three files keeps the first whole and the second up to it."""
    for name, text in {"a": "SADD s a1\nSADD s a2\nSADD s a3\n", "b": "SADD s b1\nSADD s\nSADD s b3\n", "c": "SREM s a1\n"}.items():
        (tmp_path / name).write_text(text)
    lines = S.scan_lines(spark, str(tmp_path))
    state, bad = R.load_facts(lines)
    assert {r["atom"] for r in state.members.collect()} == {"a1", "a2", "a3", "b1"}
    assert bad == 5 and R.bad_line(lines, bad) == (f"{tmp_path}/b", 2)
    (tmp_path / "b").write_text("SADD s b1\n# fine\n")
    state, bad = R.load_facts(S.scan_lines(spark, str(tmp_path)))
    assert bad is None and {r["atom"] for r in state.members.collect()} == {"a2", "a3", "b1"}


def test_last_line_of_a_key_counts_over_files(spark, tmp_path):
    for name, text in {"1": "I k 1\nI k 2\nI k 3\nS t x\n", "2": "I k 9\n"}.items():
        (tmp_path / name).write_text(text)
    assert {r["key"]: r["int_value"] or r["str_value"] for r in S.load_kv(spark, str(tmp_path)).collect()} == {"k": 9, "t": "x"}


def topic_rows(spark, n, size):
    return spark.createDataFrame([("t", k, k // size * size, b"%d" % k * (k % 5)) for k in range(n)], "topic string, offset long, segment_base long, payload binary")


def test_only_segments_from_the_offset_are_opened(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    S.write_topic(topic_rows(spark, 95, 10), root)
    folder = tmp_path / "topics" / "t"
    (folder / f"{95:020}.log").write_bytes(b"an orphan segment")
    with open(folder / f"{90:020}.log", "ab") as f:
        f.write(b"\x01")  # an orphan tail
    want = {k: b"%d" % k * (k % 5) for k in range(95)}
    whole = TS.read_topic(spark, root, "t")
    assert {r["offset"]: bytes(r["payload"]) for r in whole.collect()} == want and whole.where("crc_ok AND topic = 't'").count() == 95
    options = {"root": root, "topic": "t", "start": "47", "until": "63"}
    reader = TS.TopicReader(options)
    spans = reader.partitions()
    assert [(s.base, s.first, s.until) for s in spans] == [(40, 47, 63), (50, 50, 63), (60, 60, 63)]
    opened = []
    records = TS.TopicFiles.records
    monkeypatch.setattr(TS.TopicFiles, "records", lambda self, base, *a: opened.append(base) or records(self, base, *a))
    assert [o for s in spans for b in reader.read(s) for o in b.column(1).to_pylist()] == list(range(47, 63)) and opened == [40, 50, 60]
    for base in (0, 10, 20, 30, 70, 80):  # what isn't needed isn't read
        (folder / f"{base:020}.log").write_bytes(b"broken")
    assert [r["offset"] for r in TS.fetch_from(spark, root, "t", 47, max_records=13).orderBy("offset").collect()] == list(range(47, 60))
    assert [r["offset"] for r in TS.fetch_batch_from(spark, root, "t", 45).orderBy("offset").collect()] == [45, 46, 47, 48, 49]
    assert [r["offset"] for r in TS.fetch_batch_from(spark, root, "t", 61, 8 + 2 + 8 + 4 + 8 + 6).orderBy("offset").collect()] == [61, 62, 63]
    assert [r["offset"] for r in TS.fetch_from(spark, root, "t", 41, max_bytes=9, max_records=20).orderBy("offset").collect()] == [41, 42]
    assert TS.fetch_from(spark, root, "t", 95).isEmpty() and TS.fetch_batch_from(spark, root, "t", 95).isEmpty() and TS.read_topic(spark, root, "none").isEmpty()
    offsets = spark.createDataFrame([("g", "t", 91, 1)], "group string, topic string, offset long, seq long")
    assert [r["offset"] for r in TS.resume_from(spark, root, offsets, "g", "t").collect()] == [91, 92, 93, 94]
    (folder / f"{90:020}.idx").unlink()  # from head to head, then
    assert [r["offset"] for r in TS.resume_from(spark, root, offsets, "g", "t").collect()] == [91, 92, 93, 94]
    with pytest.raises(Exception, match="truncated"):
        TS.read_topic(spark, root, "t", 75, 76).collect()
    for bad in (lambda: TS.fetch_from(spark, root, "t", -1), lambda: TS.fetch_batch_from(spark, root, "t", 0, 0)):
        with pytest.raises(TopicError):
            bad()


def test_filters_on_offsets_are_pushed_down(spark, tmp_path):
    root = str(tmp_path)
    S.write_topic(topic_rows(spark, 60, 10), root)
    for base in (0, 10, 40, 50):
        (tmp_path / "topics" / "t" / f"{base:020}.log").write_bytes(b"broken")
    spark.conf.set(TS.PUSHDOWN, "true")
    try:
        got = TS.read_topic(spark, root, "t").where("offset > 24 AND offset <= 31 AND offset < 35").select("offset").collect()
        one = TS.read_topic(spark, root, "t").where("offset = 33").select("offset").collect()
    finally:
        spark.conf.unset(TS.PUSHDOWN)
    assert sorted(r["offset"] for r in got) == list(range(25, 32)) and [r["offset"] for r in one] == [33]
    with pytest.raises(Exception, match="truncated"):
        TS.read_topic(spark, root, "t").where("offset > 24 AND offset <= 31").collect()


def test_wrong_checksums(spark, tmp_path):
    root = str(tmp_path)
    S.write_topic(topic_rows(spark, 20, 10), root)
    place = tmp_path / "topics" / "t" / f"{10:020}.log"
    data = place.read_bytes()
    place.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert [r["offset"] for r in TS.read_topic(spark, root, "t", on_error="flag").where("NOT crc_ok").collect()] == [19]
    with pytest.raises(Exception, match="checksum"):
        TS.read_topic(spark, root, "t").collect()
    with pytest.raises(ValueError):
        TS.read_topic(spark, root, "t", on_error="ignore")


def test_a_stream_reads_each_message_once_and_goes_on(spark, tmp_path):
    root, out, check = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        TS.stream_topic(spark, root, "t").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["offset"] for r in spark.read.parquet(out).collect())

    S.write_topic(topic_rows(spark, 25, 10), root)
    assert run() == list(range(25))
    (tmp_path / "log" / "topics" / "t" / f"{0:020}.log").write_bytes(b"gone")  # never opened again
    assert run() == list(range(25))
    S.write_topic(topic_rows(spark, 48, 10).where("segment_base >= 20"), str(tmp_path / "more"))
    for base in (20, 30, 40):  # messages and segments added, then the index that commits them
        for kind in ("log", "idx"):
            (tmp_path / "log" / "topics" / "t" / f"{base:020}.{kind}").write_bytes((tmp_path / "more" / "topics" / "t" / f"{base:020}.{kind}").read_bytes())
    assert run() == list(range(25))
    (tmp_path / "log" / "topics" / "t" / "global.idx").write_bytes(b"".join(struct.pack("<Q", k // 10 * 10) for k in range(48)))
    assert run() == list(range(48))


def test_a_reader_finds_a_version_during_200_commits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        T.current(spark, path)
    T.commit(spark, path, "v-000")
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(T.current(spark, path))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 201):
        T.commit(spark, path, f"v-{k:03}")
    stop.set()
    reader.join()
    assert not failed and seen == sorted(seen) and len(seen) > 20 and T.current(spark, path).endswith("v-200")
    assert len([p for p in (tmp_path / "t" / "_commits").iterdir() if p.suffix != ".crc" and not p.name.startswith(".")]) == T.KEPT


def test_old_versions_stay_until_they_are_dropped(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    rows = spark.createDataFrame([(0, "a", 0, 3, "abc")], "doc_id long, path string, offset long, length long, text string")
    T.write_manifest(spark, rows, path, 4, "m", 800, 100, "r")
    old = T.read_manifest(spark, path)
    T.write_manifest(spark, rows.limit(0).unionByName(rows.withColumn("doc_id", rows["doc_id"] + 7)), path, 4, "m", 800, 100, "r")
    assert [r["doc_id"] for r in old.collect()] == [0] and [r["doc_id"] for r in T.read_manifest(spark, path).collect()] == [7]
    T.drop_versions(spark, path)
    assert [r["doc_id"] for r in T.read_manifest(spark, path).collect()] == [7] and len(list((tmp_path / "m").glob("v-*"))) == 1


def test_snippets_are_read_by_ranges(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    text = "é" * 5_000
    (tmp_path / "d" / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_bytes(b"short")
    read = []
    store, base = D.store_of(str(tmp_path))

    class Counting:
        def open_input_file(self, path):
            f = store.open_input_file(path)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    f.close()

                def seek(self, at):
                    f.seek(at)

                def read(self, n):
                    read.append(n)
                    return f.read(n)

            return File()

    monkeypatch.setattr(D, "store_of", lambda root: (Counting(), base))
    assert D.read_ranges(str(tmp_path), [("d/a.txt", 1, 4), ("b.txt", 0, 5)]) == [text.encode()[1:5], b"short"] and read == [4, 5]
    with pytest.raises(D.DocumentIndexError):
        D.read_ranges(str(tmp_path), [("b.txt", 3, 4)])
    monkeypatch.undo()
    hits = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7), (9, 0.1)], "doc_id long, score double")
    manifest = spark.createDataFrame([(1, "d/a.txt", 700, 800, None), (2, "b.txt", 1, 4, None), (3, "b.txt", 0, 5, "own text")], "doc_id long, path string, offset long, length long, text string")
    got = [tuple(r) for r in D.hits_with_sources(hits, manifest, 5, root=str(tmp_path)).collect()]
    assert got == [(1, 0.9, "d/a.txt", 700, "éé�"), (2, 0.8, "b.txt", 1, "hort"), (3, 0.7, "b.txt", 0, "own t"), (9, 0.1, "", 0, "")]
    with pytest.raises(Exception, match="ends before"):
        D.hits_with_sources(hits.where("doc_id = 2"), manifest.withColumn("length", manifest["length"] + 1), 9, root=str(tmp_path)).collect()


def test_an_index_without_texts_reads_snippets_below_its_root(spark, tmp_path):
    (tmp_path / "one.md").write_text("alpha beta " * 100)
    (tmp_path / "two.md").write_text("gamma delta " * 100)
    docs = S.scan_documents(spark, str(tmp_path)).select("path", "content")
    embedder = D.hashing_embedder(16)
    index = D.build_index(docs, embedder, str(tmp_path))
    whole = D.search(index, embedder(["gamma"])[0], 3).collect()
    lite = replace(index, manifest=index.manifest.withColumn("text", F.lit(None).cast("string")))
    assert [tuple(r) for r in D.search(lite, embedder(["gamma"])[0], 3).collect()] == [tuple(r) for r in whole] and all(len(r["snippet"]) == 200 for r in whole)


def test_lookups_open_only_row_groups_that_may_hold_an_id(spark, tmp_path):
    rng = random.Random(7)
    ids = rng.sample(range(100_000), 6_000)
    vectors = spark.createDataFrame([(i, [float(i % 91 + 1), 1.0]) for i in ids], "doc_id long, vector array<float>").repartition(3)
    path = str(tmp_path / "v")
    T.write_vectors(vectors, path, 4_096)
    ranges = spark.read.parquet(f"{path}/_ranges").collect()
    assert len(ranges) > 10 and sum(r["n"] for r in ranges) == 6_000 and T.read_vectors(spark, path).count() == 6_000
    some = sorted(ids)[100:160]
    wanted = spark.createDataFrame([(i,) for i in [*some, *some, -5, 200_000, some[0] + 0, None]], "doc_id long")
    groups = T.wanted_groups(spark, path, wanted).select("file", "row_group").distinct().collect()
    assert 1 <= len(groups) <= 3
    opened = {g["file"] for g in groups}
    for p in (tmp_path / "v").glob("*.parquet"):
        if p.name not in opened:
            p.write_bytes(b"not opened")
    got = {r["doc_id"]: r["vector"] for r in T.lookup(spark, path, wanted).collect()}
    assert sorted(got) == some and all(abs(v[0] / v[1] - (i % 91 + 1)) < 1e-3 for i, v in got.items())
    assert sorted(r["doc_id"] for r in T.contains(spark, path, wanted).collect()) == some
    assert T.lookup(spark, path, wanted.where("doc_id < 0")).isEmpty()


def test_the_message_index_is_read_over_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ENTRIES_EACH", 7)
    S.write_topic(topic_rows(spark, 95, 10), str(tmp_path))
    got = S.scan_global_index(spark, str(tmp_path), "t")
    assert got.rdd.getNumPartitions() == 14 and sorted(map(tuple, got.collect())) == [("t", k, k // 10 * 10) for k in range(95)]
    assert S.scan_global_index(spark, str(tmp_path), "none").isEmpty()


def test_files_are_dealt_by_number_and_bytes():
    assert S._tasks(0) == S._tasks(1) == 1 and S._tasks(1_000, 0) == 16 and S._tasks(3, 64 << 30) == 3 and S._tasks(10_000, 64 << 30) == 1_024
