"""Components, min-max hashing and the grid order join against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, graph, minhash


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 90)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (9, 8), (8, 9), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({n for e in real for n in e}, real)
    assert graph.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_components_of_stars_in_few_tasks(spark):
    """Every task takes driver's memory: stars are told from others without a round, and a round has five exchanges."""
    sc = spark.sparkContext

    def tasks(edges):
        group = f"components of {len(edges)}"
        sc.setLocalProperty("spark.jobGroup.id", group)
        got = {r["node"]: r["component"] for r in graph.components(edges_of(edges)).collect()}
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert got == roots({n for e in edges for n in e}, edges)
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)

    edges_of = lambda edges: spark.createDataFrame(edges, "u long, v long").repartition(3)
    before = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 20)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        stars = tasks([(c, c + k) for c in range(0, 1000, 100) for k in range(1, 40)])
        chain = tasks([(k, k + 1) for k in range(30)])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert stars <= 120 and chain <= 650


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, n, percent):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows = [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "Élan é"), (905, "élan é"), (None, "one two"), (None, None), (906, " \t\n"), (1, "dup " * 50), (0, "dup " * 40), (907, "long " * 30_000 + "x")]
    k = 10
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((k, " ".join(text)))
            k += 1
    rows.append(rows[-1])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "rep", "bands", "component", "node")})
    got = minhash.near_duplicates(df, words_each=n, percent=percent).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(df.limit(0)).isEmpty()


def test_deduplicate_keeps_rows(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    one, two, three = text(), text(), text()
    rows = [(5, one, "x"), (5, two, "x"), (3, two + " end", "y"), (7, one + " end", "x"), (8, one, "x"), (5, one, "a"), (5, one, "x"), (9, None, "x"), (9, None, "x"), (10, " ", "x"), (None, one, "x"), (None, one, "x"), (11, three, "x"), (12, three.upper(), "x"), (2, one.replace(" ", "\n"), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "k", "text_key", "__row", "stay_id")})
    got = minhash.deduplicate(df)
    assert got.columns == df.columns
    # of the group of one the row of id 2 stays, of that of two the row of id 3
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got.collect()), key=str) == sorted([rows[2], rows[7], rows[8], rows[9], rows[10], rows[11], rows[12], rows[14]], key=str)
    some = spark.createDataFrame([rows[0], rows[1], rows[5], rows[6]], "doc_id long, text string, source string")
    kept = minhash.deduplicate(some).collect()
    assert sorted(r["text"] for r in kept) == sorted([one, two])  # one id, two documents
    assert minhash.deduplicate(df.limit(0)).isEmpty()


def test_cuts_of_sorted_band_values(spark):
    rows = [(b, v, r) for b in (0, 1) for v, n in ((5, 700), (6, 1), (7, 2), (9, 300)) for r in range(n)]
    df = spark.createDataFrame(rows, "band int, value long, rep long").repartition(9)
    for parts in (1, 2, 7):
        got = df.repartitionByRange(parts, "band", "value", "rep").sortWithinPartitions("band", "value", "rep").mapInArrow(minhash._segments, "band int, value long, seg long, rep long, center long, edge boolean").collect()
        by = {}
        for r in got:
            by.setdefault((r["band"], r["value"]), []).append(r)
        edges = sum(r["edge"] for r in got)
        assert all(sorted(r["rep"] for r in by[b, v]) == list(range(n)) for b in (0, 1) for v, n in ((5, 700), (7, 2), (9, 300))) and edges <= 2 * parts
        for x in by.values():
            centers = {r["center"] for r in x}
            assert len(centers) <= parts and all(r["center"] <= r["rep"] for r in x)
            if len(centers) > 1:  # every cut's center is on an edge row
                assert centers == {r["center"] for r in x if r["edge"]}
            sizes = {}
            for r in x:
                sizes[r["seg"]] = sizes.get(r["seg"], 0) + 1
            assert max(sizes.values()) <= minhash.BLOCK


def test_signature_is_min_and_max():
    a, b = minhash._permutations()
    x = minhash.shingle_set("one two three four five six seven", 3, {})
    s = minhash.signature(x, a, b).reshape(-1, 2)
    values = [[(int(m) * int(v) + int(o)) % 2**64 for v in x] for m, o in zip(a, b, strict=True)]
    assert s.tolist() == [[min(v), max(v)] for v in values] and 2 * len(a) >= minhash.BANDS * minhash.ROWS


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    monkeypatch.setattr(embeddings, "LEAF", 16)
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for _ in range(30):
        center = rng.normal(size=16)
        for _ in range(rng.choice([1, 2, 4, 25])):
            rows.append((k, (center * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.uniform(0, 0.35)).astype(np.float32).tolist()))
            k += 1
    rows += [(k + j, rows[3][1]) for j in range(30)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16), (None, rows[3][1]), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [1e-30] * 16), (9009, [1e30] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "rep", "n", "key")})
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(range(len(rows)), list(zip(*np.nonzero(near), strict=True)))
    links = 0
    for r in got:
        i = r["vec_id"]
        if i is not None and i < len(rows):
            assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum(), want[i], want[i] == i)
            links += r["n_links"]
    assert links > 500
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert all(by[i] == (0, i) for i in range(9000, 9006)) and by[None] == (0, None) and by[9007] == (1, 9006) and by[9009] == (1, 9008)
    assert embeddings.near_duplicates(df.limit(0)).isEmpty()


def test_grid_order_skips_distant_leaves(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(400, 64))
    x = np.repeat(centers, 50, axis=0) + rng.normal(size=(20_000, 64)) * 0.1
    rows = spark.createDataFrame([(k, 1, v.tobytes(), 64) for k, v in enumerate(x)], "rep long, n long, payload binary, dim int").repartition(4)
    eps = float(np.sqrt(0.1))
    leaves = embeddings.leaves_of(rows, embeddings.principal_axes(rows, 64), eps)
    table = leaves.select("block", "leaf", "size", "lo", "hi").collect()
    lo, hi = (np.array([np.frombuffer(r[c], np.float32) for r in table]) for c in ("lo", "hi"))
    size, block = np.array([r["size"] for r in table]), np.array([r["block"] for r in table])
    close = np.array([embeddings._apart(a, b, lo, hi) for a, b in zip(lo, hi, strict=True)]) <= eps * eps + 1e-4
    share = (close * np.outer(size, size)).sum() / size.sum() ** 2
    print(f"pairs of rows in leaves within eps over all: {share:.4f}")
    assert size.sum() == 20_000 and len(set(block.tolist())) >= 5 and share < 0.05
    # what goes to the tasks are the leaves of such pairs, in both directions
    want = {(min(block[i], block[j]), max(block[i], block[j]), block[i], table[i]["leaf"]) for i, j in np.argwhere(close)}
    assert {tuple(r) for r in embeddings.near_leaves(leaves, eps).collect()} == want


def test_axes_of_many_dimensions(spark, monkeypatch):
    """Within a random span the axes are orthonormal and hold nearly the variance of the principal ones."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 20)) @ rng.normal(size=(20, 300)) + 0.1 * rng.normal(size=(800, 300)) + 1.0
    rows = spark.createDataFrame([(k, 1, v.tobytes(), 300) for k, v in enumerate(x)], "rep long, n long, payload binary, dim int").repartition(3)
    axes = embeddings.principal_axes(rows, 300)
    monkeypatch.setattr(embeddings, "WHOLE", 300)
    whole = embeddings.principal_axes(rows, 300)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cov = np.cov(unit.T, bias=True)
    held = [np.trace(a.T @ cov @ a) for a in (axes, whole)]
    assert axes.shape == whole.shape == (300, embeddings.AXES) and np.allclose(axes.T @ axes, np.eye(embeddings.AXES), atol=1e-9) and held[0] > 0.99 * held[1] > 0


def test_outlooks_bound_cosines():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40))
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0][:, : embeddings.AXES]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for y, a in ((x, axes), (x[:, :3], axes), (x, axes[:39])):
        p = embeddings.outlook(y, a).astype(float)
        u = y / np.linalg.norm(y, axis=1, keepdims=True)
        assert (p @ p.T + 1e-6 >= u @ u.T).all() and np.allclose((p * p).sum(axis=1), 1, atol=1e-5)
    p = embeddings.outlook(np.concatenate([unit, unit[:5], np.repeat(unit[:1], 400, axis=0)]), axes)
    leaves = embeddings.arrange(p, 0.3)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(705)) and all(0 < len(x) <= embeddings.LEAF for x in leaves)
