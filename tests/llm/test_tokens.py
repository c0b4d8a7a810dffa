"""BPE, token counts, packing and WARC against the libraries and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import _vocab, bpe, packing, token_counts, warc

public = pytest.importorskip("public_tokenizers")
JSON, MULTI = public.path("byte_bpe_50k.json"), public.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["the ", "foo", "\n ", "  ", "<|endoftext|>", "<|endof", "é", "日本", "1", "!!", "x ", "'s", "\t", "　", "\x1c", "😀", "ǅ", "²"]


def texts(n=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 600))) for _ in range(n)]


def frame(spark, values):
    rows = [(k, t) for k, t in enumerate(values)] + [(None, None), (0, values[0]), (900, ""), (901, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "ids", "row", "shard", "n_tokens", "start")})


def test_encoder_equals_library():
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        ranks = _vocab.read_ranks(public.path(name))
        own, library = bpe.BytePairEncoder(ranks), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rng = random.Random(2)
        cases = texts(200) + ["".join(rng.choice("abcderaeinst") for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["a" * 5_000, bytes(range(256)).decode("latin-1"), "Ж" * 999]
        for t in cases:
            ids = own.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_round_trip(spark):
    rows, df = frame(spark, texts())
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=_vocab.read_ranks(MULTI), special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(df, MULTI).collect())) == want
    both = bpe.decode_ids(bpe.encode_texts(df, MULTI), MULTI).select("doc_id", F.sha2("decoded", 256).alias("d"), "n_tokens").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["d"]) for r in both) == Counter((i, n, d) for i, n, _, d in want.elements())
    assert bpe.round_trip(df.limit(0), MULTI).isEmpty()


def test_counts_with_spliced_chunks(spark):
    rows, df = frame(spark, [*texts(), "a" * 9_000, " " * 5_000, "hello <|endoftext|> x" * 300, "\n \n" * 2_000])
    library = Tokenizer.from_file(JSON)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = token_counts.count_tokens(df, JSON, huge=500, chunk=200, overlap=20).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    plain = token_counts.count_tokens(df, JSON).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in plain) == want
    other = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = token_counts.count_tokens(df, public.path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(other.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert token_counts.count_tokens(df.limit(0), JSON).isEmpty()


def test_packing(spark):
    rows, df = frame(spark, [*texts(), "word " * 5_000])
    library = Tokenizer.from_file(JSON)
    got = packing.pack(df, JSON, shard_rows=20, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows:
        if i in (0, None):
            continue  # repeated below
        want, have = [*library.encode(t or "", add_special_tokens=False).ids, 0], []
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == len(have) and r["doc_tokens"] == len(want)
            have += np.frombuffer(r["ids"], "<u4").tolist()
        assert have == want
    first = [*library.encode(rows[0][1], add_special_tokens=False).ids, 0]
    assert sum(r["length"] for r in pieces[0]) == 2 * len(first) and sum(r["length"] for r in pieces[None]) == 1
    for s in sequences.values():
        place = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= 1024 and place & (place - 1) == 0  # full, or a power of two: no padding
    assert packing.pack(df.limit(0), JSON).isEmpty()


def test_packing_splits_copies(spark):
    rows = [(k, "one text that many rows hold") for k in range(150)] + [(7, None)] * 90 + [(None, "")] * 60 + [(k, f"text {k}") for k in range(200, 230)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(df, JSON, shard_rows=20).collect()
    docs = Counter(r["sequence_id"] >> packing.SEQUENCE_BITS for r in got if r["start"] == 0)
    assert sum(docs.values()) == len(rows) and max(docs.values()) <= 20 and len(docs) <= -(-len(rows) // 20) + 3  # one part shard a cut
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(i for i, _ in rows)


def test_shards_are_bounded_in_tokens_whatever_the_texts(spark):
    """Long texts don't meet first, and shards of long and of short texts hold alike many tokens."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(2_000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(3_000 if k % 10 == 0 else rng.randint(5, 200)))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(df, JSON, shard_tokens=40_000).collect()
    sizes, longest = Counter(), Counter()
    for r in got:
        sizes[r["sequence_id"] >> packing.SEQUENCE_BITS] += r["length"]
        if r["start"] == 0:
            longest[r["sequence_id"] >> packing.SEQUENCE_BITS] = max(longest[r["sequence_id"] >> packing.SEQUENCE_BITS], r["doc_tokens"])
    last = {max(s for s in sizes if s >> packing.SHARD_BITS == p) for p in {s >> packing.SHARD_BITS for s in sizes}}  # a cut's rest
    assert all(40_000 <= n < 40_000 + longest[s] for s, n in sizes.items() if s not in last) and max(sizes.values()) < 60_000 and len(sizes) > 8
    own = _vocab.byte_level_encoder(JSON)
    keys = sorted(rows, key=lambda r: packing.min_tokens(np.frombuffer(own.ids(r[1]), own.dtype)))
    places = [p for p, (k, _) in enumerate(keys) if k % 10 == 0]
    assert 150 < np.mean(places) < 450


def test_packing_of_one_hot_text(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same few words in every row").alias("text"))
    got = packing.pack(rows, JSON)
    docs = got.where("start = 0").groupBy(F.shiftright("sequence_id", packing.SEQUENCE_BITS).alias("shard")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert docs["most"] <= 512 and docs["all"] == 50_000
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n != end OR n > 1024 OR bit_count(n) != 1").isEmpty()


def test_near_copies_meet_in_a_shard(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(3_000)]
    rows = []
    for k in range(300):
        own = [rng.choice(words) for _ in range(120)]
        rows += [(k, " ".join(own)), (1_000 + k, " ".join(own[:55] + own[57:]))]
    shards = {r["doc_id"]: r["sequence_id"] >> packing.SEQUENCE_BITS for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), JSON, shard_rows=20).collect() if r["start"] == 0}
    assert sum(shards[k] == shards[1_000 + k] for k in range(300)) > 200  # 10 of 300 by chance


def test_all_terms_of_the_seed_count():
    seed = np.arange(60, dtype=np.uint16)
    # pairs of rare terms before a common one
    docs = [seed, *(np.array([k, 100 + k], np.uint16) for k in range(59)), *(np.array([59, 200 + k], np.uint16) for k in range(30))]
    assert set(packing.ShardIndex(docs).neighbours(0, np.arange(len(docs)) == 0)) == set(range(1, len(docs)))
    rng = np.random.default_rng(2)
    index = packing.ShardIndex([rng.integers(0, 900, rng.integers(5, 300)).astype(np.uint16) for _ in range(80)])
    none = np.zeros(80, bool)
    assert index.common.any() and all(list(index.neighbours(k, none)) == list(index.neighbours(k, none, 900)) for k in range(80))
    assert not list(packing.ShardIndex([seed[:3], seed[5:9]]).neighbours(0, np.zeros(2, bool)))


def test_retrieval_is_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, rng.integers(5, 80)).astype(np.uint16) for _ in range(40)]
    index = packing.ShardIndex(docs)
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(60)}

    def score(q, d):
        terms = sorted(set(q.tolist()), key=lambda t: (-(np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) if df[t] > 1 else 0.0), t))[:10]
        tf = Counter(d.tolist())
        return sum(np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms if df[t] > 1)

    used = np.zeros(40, bool)
    used[[3, 9]] = True
    got = list(index.neighbours(3, used, 10))
    want = {k: score(docs[3], docs[k]) for k in range(40) if not used[k]}
    assert set(got) == {k for k, s in want.items() if s > 0}
    values = [want[k] for k in got]
    assert all(a >= b - 1e-5 for a, b in zip(values, values[1:], strict=False))


def test_warc(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, " http://b/%20é\n b ", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 3_000_000), (7, "u", "one\r\n\r\ntwo"), (6, "u", "one\r\n\r\ntwo"), (6, "u", "one\r\n\r\ntwo"), (None, "u", "one\r\n\r\ntwo")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "payload", "first_id", "n")}).repartition(3)
    got = warc.round_trip(df, with_payload=True).collect()
    assert len(got) == len(rows)
    smallest = {}
    for i, _, h in rows:
        if i is not None:
            smallest[h or ""] = min(smallest.get(h or "", i), i)
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r["page_id"])
        first = smallest[h]
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == warc.payload_digest(h.encode())
        assert r["record_type"] == ("response" if r["page_id"] == first else "revisit") and r["refers_to"] == (None if r["page_id"] == first else first)
        assert r["payload"] == (h.encode() if r["page_id"] == first else None)
    assert sorted(str(r["url"]) for r in got) == sorted(u or "" for _, u, _ in rows)
    assert warc.round_trip(df.limit(0)).isEmpty()


def test_warc_reader_finds_damage():
    block = b"HTTP/1.1 200 OK\r\n\r\npayload"
    fields = {"WARC-Payload-Digest": f"sha1:{warc.payload_digest(b'payload')}"}
    good = warc.record_bytes("response", fields, block)
    assert [b for _, b in warc.read_records(BytesIO(good * 3))] == [block] * 3
    for bad in (good[:-5], warc.record_bytes("response", fields, block + b"!"), good + b"garbage here", zlib.compress(b"x"), warc.record_bytes("response", {**fields, "Content-Length": "x"}, block)[:-9]):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_records(BytesIO(bad)))
    import gzip

    for text in (b"WARC/1.1\r\nContent-Length: 2\r\n\r\n" + b"x" * 5_000_000, b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n", b"WARC/1.1\r\n\r\n", b"x" * 3_000_000, b"WARC/1.1\r\nContent-Length: -1\r\n\r\n\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(BytesIO(gzip.compress(text))))
