"""Top-k search, centroid clustering and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, resampling, topk

CLASH = ("id", "x", "ask", "need", "uid", "v", "place", "score", "rank", "__text", "cluster", "a`b")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c.replace("`", "``") if "`" not in c else c: F.lit(1) for c in CLASH})


def sample(rng, dims, n, clusters=9):
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def odd_rows():
    """Vectors that take no part, or are special."""
    return [(7000, None), (7050, [1.0, None]), (None, [0.5] * 12), (7100, [float("nan")] * 12), (7150, [float("inf")] + [0.0] * 11), (7200, []), (7250, []), (7300, [0.0] * 12), (7350, [3e38] * 12), (7400, [-3e38] * 12), (7450, [1.0, 2.0])]


def brute_top(rows, k=5, scale=256):
    most = lambda d: math.isqrt((1 << 62) // max(d, 1))
    usable = [(i, [min(max(math.floor(float(x) * scale), -most(len(v))), most(len(v))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % 50:
            continue
        found = sorted((-sum(s * t for s, t in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(usable) if a != b and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "slab", "few"), [(16, 3, 1 / 16), (64, 5, 0.0), (1024, 16, 1.0)])
def test_top_k(spark, monkeypatch, block, slab, few):
    for name, value in {"BLOCK": block, "SLAB": slab, "FEW": few, "QUERIES": 7, "FIRST": 3, "OPEN": 12 * 40}.items():
        monkeypatch.setattr(topk, name, value)
    x = sample(np.random.default_rng(block), 12, 700)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(701, rows[50][1]), (702, rows[50][1]), (50, rows[50][1]), (-50, rows[3][1]), (800, [-c for c in rows[0][1]])] + odd_rows()
    random.Random(block).shuffle(rows)
    got = topk.top_k(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    as32 = [(i, v if v is None else [None if c is None else np.float32(c) for c in v]) for i, v in rows]
    want = brute_top(as32)
    mine = sorted(tuple(r) for r in got.collect())
    huge = lambda t: [r for r in t if r[0] not in (7350, 7400) and r[2] not in (7350, 7400)]  # noqa: E731  their components are held at a root in doubles
    assert huge(mine) == huge(want) and len(mine) == len(want)
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).isEmpty()
    assert topk.top_k(vectors(spark, rows[:20]), F.lit(False)).isEmpty()


def test_bounds_prune_and_lose_nothing():
    """On clustered vectors few pairs reach the last slab, and the best are those of the full product."""
    rng = np.random.default_rng(5)
    x = np.floor(sample(rng, 64, 4096, 40) * 256).astype(np.int64)
    q, order = x[:64], np.argsort(-(x**2).sum(axis=0))
    block = topk.Block(np.ascontiguousarray(x[:, order].T), order, np.arange(4096), np.arange(4096))
    full = q @ x.T
    need = np.sort(full, axis=1)[:, -6].astype(float)
    rows, cols, score = block.survivors(q, need)
    assert (score == full[rows, cols]).all() and set(zip(rows.tolist(), cols.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(full >= need[:, None])), strict=True))
    third = (q[:, order[:48]] @ x[:, order[:48]].T) + np.linalg.norm(q[:, order[48:]], axis=1)[:, None] * np.linalg.norm(x[:, order[48:]], axis=1)
    assert (third >= need[:, None]).mean() < 0.05


def brute_clusters(rows, dim, k=16, rounds=3, scale=64):
    clip = lambda x: math.floor(min(max(float(x) * scale, -centroids.LIMIT), centroids.LIMIT))
    kept = [(i, [clip(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(((key(i), v) for i, v in kept))[:k]]
    gap = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def assigned():
        return [min((gap(v, c), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        of = assigned()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(kept, of, strict=True) if m == n]
            if own:
                centres[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    of = assigned()
    inertia = [sum(d for d, m in of if m == n) for n in range(len(centres))]
    return sorted(((i, n, d, inertia[n], sum(inertia), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, of, strict=True)), key=repr)


def test_clusters(spark):
    x = sample(np.random.default_rng(2), 12, 400)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(401, rows[5][1]), (5, rows[5][1]), (None, rows[6][1])] + [r for r in odd_rows() if r[0] not in (7350, 7400)]
    got = centroids.cluster(vectors(spark, rows).repartition(3), dim=12)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    as32 = [(i, v if v is None else [None if c is None else np.float32(c) for c in v]) for i, v in rows]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(as32, 12)
    for few in (rows[:3], [rows[0]] * 4, []):  # fewer vectors than centroids, all alike, none
        assert sorted((tuple(r) for r in centroids.cluster(vectors(spark, few), dim=12).collect()), key=repr) == brute_clusters([(i, [np.float32(c) for c in v]) for i, v in few], 12)
    held = centroids.cluster(vectors(spark, [r for r in odd_rows() if r[0] in (7350, 7400)] + rows[:3]), dim=12).collect()
    assert len(held) == 5 and all(r["distance"] >= 0 for r in held)


def test_dot_products_change_by_moved_components_alone():
    rng = np.random.default_rng(3)
    x, old = rng.integers(-64, 64, (50, 8)), rng.integers(-64, 64, (4, 8))
    new = old.copy()
    new[1, 3] += 2
    new[2] = -new[2]
    moved = centroids.changes(old, new)
    assert [(c, at.tolist()) for c, at, _ in moved] == [(1, [3]), (2, np.flatnonzero(old[2]).tolist())]
    assert (centroids.advance(x, x @ old.T, moved) == x @ new.T).all()


def brute_resample(rows, target, percent=10, least=20, max_words=1, buckets=10_000, seed=2024):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def parts(t):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, max_words + 1) for k in range(len(w) - n + 1)]

    own, other = [parts(t) for _, t in rows], [parts(t) for t in target]
    s, t = ([sum(1 for _, f in side for b in f if b == n) for n in range(buckets)] for side in (own, other))
    gain = [math.floor(1000 * math.log((t[n] + 1) * (sum(s) + buckets) / ((s[n] + 1) * (sum(t) + buckets)))) for n in range(buckets)]
    scored = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in scored]


@pytest.mark.parametrize("max_words", [1, 3])
def test_resample(spark, monkeypatch, max_words):
    monkeypatch.setattr(resampling, "_HELD", 50)
    rng = random.Random(max_words)
    words = ["River", "stone", "Été", "naïve", "x1", "99", "日本", "tea-pot", "end."] + ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(60)]
    rows = [(k, rng.choice((" ", "\n", " -- ", "\x00")).join(rng.choice(words[: rng.choice((9, 69))]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, " .,;\n"), (903, "w" * 200_000 + " two"), (904, "again and " * 5_000), (None, rows[3][1]), (3, rows[3][1])]
    target = [" ".join(rng.choice(words[:9]) for _ in range(30)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs.repartition(3), goal, max_words=max_words, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    want = brute_resample(rows, target, max_words=max_words, buckets=500)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) and sum(r[4] is not None for r in want) > 5
    assert resampling.resample(docs.limit(0), goal).isEmpty()
    assert resampling.resample(docs, goal.limit(0), buckets=500).count() == len(rows)


def test_spans_are_those_of_overlapping_runs():
    clean = resampling.collapsed("Ab  c,d 日本!e".encode())
    spans = [m.span() for found in resampling.features(clean, resampling.patterns(2)) for m in found]
    assert [clean[b:e].decode() for b, e in spans] == ["ab", "c", "d", "日本", "e", "ab c", "c d", "d 日本", "日本 e"]
