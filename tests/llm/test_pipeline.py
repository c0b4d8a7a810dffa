"""The pipeline's stages on a small corpus with planted cases."""

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from test_dedup import roots, shingles  # noqa: E402
from test_text import brute_battery, brute_counts, brute_spans  # noqa: E402

from tessera.llm import language, quality, secrets  # noqa: E402


def corpus(spark, folder):
    import random

    rng = random.Random(4)
    words = {"en": "the of and to in is that it was for town river story people long road light water".split(), "de": "der die das und nicht ist ein von mit zu Stadt Fluss lange Straße Licht Wasser über".split()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randint(0, 9)) * (rng.random() < 0.3) for _ in range(n)) + "."
    rows = [(k, prose(lang, 80), lang) for k in range(120) for lang in [("en", "de")[k % 2]]]
    rows += [(200, rows[6][1], "en"), (201, rows[6][1] + " tail", "en"), (3, rows[3][1], "de"), (202, rows[8][1][:100] + " token = 0123456789abcdef0123 " + prose("en", 60), "en")]
    rows += [(300, None, "en"), (301, "", "en"), (302, "short text", "en"), (303, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25", "en"), (None, prose("en", 90), None), (304, "$$$ ### *** %%% " * 20, "en")]
    rows += [(90, prose("en", 70), "en"), (90, rows[91][1], "de"), (400, prose("en", 40_000), "en")]
    df = spark.createDataFrame([(i, t, c, "src", None if t is None else len(t)) for i, t, c in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("extra", "__", "__row", "q_kept", "id", "text_key", "stay_id", "a`b")})
    df.write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "secret_scan", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        if name != "packing":
            assert out.columns == docs.columns
        seen[name], docs = out.collect(), out
    ids = {name: sorted((r["doc_id"] for r in x), key=str) for name, x in seen.items()}
    texts = {i: t for i, t, _ in rows}
    assert not {300, 301, 302, 304} & set(ids["quality_rules"]) and set(range(120)) <= set(ids["quality_rules"]) and ids["quality_rules"].count(3) == 2
    assert 303 not in ids["language_id"] and set(range(120)) <= set(ids["language_id"])
    assert ids["near_duplicates"] == sorted([*(k for k in range(120) if k != 91), 90, 90, 202, 400, None], key=str)  # three texts of 90, of which one has a copy in 91
    clean = {r["doc_id"]: r for r in seen["secret_scan"]}
    assert ids["secret_scan"] == ids["near_duplicates"] and "0123456789abcdef" not in clean[202]["text"] and "[secret]" in clean[202]["text"]
    assert all(clean[k]["text"] == texts[k] for k in range(120) if k not in (90, 91)) and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    whole = {}
    for r in seen["packing"]:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] >= r["start"] + r["length"]
    assert set(whole) == set(clean) and all(whole[r["doc_id"]] == r["doc_tokens"] for r in seen["packing"] if r["doc_id"] != 90)


def test_stages_compose_and_leave_others_results(spark, tmp_path):
    """A stage given another's unwritten result, and results read after a later stage began on other rows."""
    rows = corpus(spark, tmp_path)
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    good = corpus_pipeline.quality_rules(spark, docs, sf)
    other = corpus_pipeline.secret_scan(spark, docs.where("doc_id % 2 = 0"), sf)
    named = corpus_pipeline.language_id(spark, good, sf)
    apart = corpus_pipeline.near_duplicates(spark, named, sf)
    packed = corpus_pipeline.pack(spark, corpus_pipeline.secret_scan(spark, apart, sf), sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in apart.select("doc_id").collect()} and named.count() < good.count() < len(rows)
    assert other.where("doc_id = 202").first()["text"].count("[secret]") == 1 and good.count() == len(good.collect())


def test_run_removes_what_stages_store(spark, tmp_path):
    corpus(spark, tmp_path)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*/*"))
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert [p.name.split("-")[:2] for p in set(shared.glob("*/*")) - before] == [["stage", "packing"]]


def test_run_equals_stages_and_takes_an_empty_table(spark, tmp_path):
    corpus(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[0] == "doc_id" and got.count() > 100
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").isEmpty()


def brute_quality(texts):
    """Whether each text is kept, by counts, votes and expectation-maximisation in plain Python."""
    import math

    def votes(t):
        words, chars, symbols, dup, repeated = brute_counts(t)
        lines = sum(bool(x.split()) for x in t.split("\n"))
        tokens = t.split()
        short = [w for w in tokens if len(w) <= 5 and w.isalpha()]
        w1, c1, upper, bangs = max(words, 1), max(chars, 1), sum(c.isupper() for c in t), t.count("!")
        again, stops = len(short) - len(set(short)), len(set(tokens) & set(quality.STOP_WORDS))
        mean = chars / w1
        pick = lambda bad, good: 0 if bad else 1 if good else -1
        return (
            pick(symbols > 0.05 * c1, symbols <= 0.01 * c1), pick(lines >= 3 and dup > 0.3 * lines, lines >= 3 and dup <= 0.1 * lines), pick(repeated > 0.25 * words, words >= 50 and repeated <= 0.05 * words),
            pick(mean < 2.5 or mean > 14, 3.5 <= mean <= 10), pick(c1 >= 40 and upper > 0.4 * c1, c1 >= 40 and upper <= 0.15 * c1), pick(bangs > 0.2 * w1, bangs <= 0.02 * w1),
            pick(words >= 60 and stops < 2 and again < 0.02 * words, words >= 30 and stops >= 3),
        ), words < 20 or 100 * repeated > 30 * words

    rows = [votes(t) for t in texts]
    n = len(quality.RULES)
    prior, good, bad = 0.7, [0.99] * n, [0.25] * n

    def posterior(p):
        odds = math.log(prior / (1 - prior))
        for v, g, b in zip(p, good, bad, strict=True):
            odds += 0 if v < 0 else math.log(g / (1 - b)) if v else math.log((1 - g) / b)
        return 1 / (1 + math.exp(-odds))

    for _ in range(12):
        post = [posterior(p) for p, _ in rows]
        prior = min(max((sum(post) + 8) / (len(post) + 10), 0.02), 0.98)
        for j in range(n):
            w = [(x, p[j]) for x, (p, _) in zip(post, rows, strict=True) if p[j] >= 0]
            good[j] = min(max((sum(x for x, v in w if v) + 19.8) / (sum(x for x, _ in w) + 20), 0.8), 0.999)
            bad[j] = min(max((sum(1 - x for x, v in w if not v) + 5) / (sum(1 - x for x, _ in w) + 20), 2 * (1 - good[j])), 0.98)
    return [not failed and posterior(p) >= 0.75 for p, failed in rows]


def brute_languages(rows):
    """Whether each ``(id, text, lang)`` stays, by a dense kernel regression."""
    import zlib

    import numpy as np

    sets = [set(language.presence(t).tolist()) for _, t, _ in rows]
    learned = [k for k, (i, _, c) in enumerate(rows) if c is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    names = sorted({rows[k][2] for k in learned})
    kernel = np.array([[len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5 for b in learned] for a in range(len(rows))])
    own = [rows[k][2] for k in learned]
    w = np.array([len(own) / (len(names) * own.count(c)) for c in own])
    y = np.array([[1.0 if c == d else -1.0 for d in names] for c in own])
    k, n = kernel[learned], len(own)
    mean, goal = k @ w / n, w @ y / n
    total = w @ mean / n
    alpha = np.linalg.solve(k - mean[:, None] - mean[None, :] + total + 1e-3 * n * np.diag(1 / w), y - goal)
    scores = goal + (kernel - (kernel @ w / n)[:, None] - mean[None, :] + total) @ alpha
    e = np.exp(5 * (scores - scores.max(axis=1, keepdims=True)))
    return [any(c.isalpha() for c in t) and p >= corpus_pipeline.LEAST_LANGUAGE_SCORE for (_, t, _), p in zip(rows, e.max(axis=1) / e.sum(axis=1), strict=True)]


def brute_redaction(texts):
    spans = []
    for t in texts:
        base = [tuple(map(int, x.split(":")[1:])) for x in brute_spans(t).split(",") if x]
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.CANDIDATE, t) if len(m[0].rstrip("=")) >= secrets.MIN_RANDOM]
        spans.append((base, [(b, e, brute_battery(x)) for b, e, x in found if not any(b < e2 and b2 < e for b2, e2 in base)]))
    counted = {}
    for _, some in spans:
        for *_, (name, n, p) in some:
            counted.setdefault((name, sum(n >= b for b in (32, 64, 128))), []).append(p)
    assert all(len(x) < secrets.LEAST for x in counted.values())  # so that the fallback holds
    out = []
    for t, (base, some) in zip(texts, spans, strict=True):
        cuts = sorted(base + [(b, e) for b, e, (_, _, p) in some if p > 0.05])
        merged = []
        for b, e in cuts:
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        for b, e in reversed(merged):
            t = t[:b] + secrets.PLACEHOLDER + t[e:]
        out.append(t)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    import random

    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = {"en": "the of and to in is that it was for town river story people long road light water".split(), "de": "der die das und nicht ist ein von mit zu Stadt Fluss lange Straße Licht Wasser über".split()}
    rows = []
    for k in range(110):
        lang = ("en", "de")[k % 2]
        text = [rng.choice(words[lang]) + str(rng.randint(0, 9)) * (rng.random() < 0.3) for _ in range(rng.randint(15, 120))]
        if k % 7 == 3:  # near copies of what came before
            text = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words[lang])
        if k % 11 == 4:
            text.insert(5, rng.choice(("secret=abcdefghijklmnop", "Qm4ZtY81LwPf0aRcN7XgkD2e", "0123456789abcdef01234", "wordwordwordwordwordwordword")))
        if k % 13 == 5:
            text = [rng.choice(("!!!", "###", "A", "$$", "1")) for _ in range(60)]
        rows.append((k, " ".join(text), None if k % 17 == 6 else lang))
    rows.append((500, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26", "en"))
    docs = spark.createDataFrame([(i, t, c, "s", len(t)) for i, t, c in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def stage(k, now):
        corpus_pipeline.STAGES[k][1](spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/brute{k}")
        now = spark.read.parquet(f"{tmp_path}/brute{k}")
        return now, now.collect()

    docs, got = stage(0, docs)
    rows = [r for r, ok in zip(rows, brute_quality([t for _, t, _ in rows]), strict=True) if ok]
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows] and 60 < len(rows) < 111
    docs, got = stage(1, docs)
    rows = [r for r, ok in zip(rows, brute_languages(rows), strict=True) if ok]
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    docs, got = stage(2, docs)
    sets = {i: shingles(t, 5) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    whole = roots(sets, links)
    assert links
    rows = [r for r in rows if whole[r[0]] == r[0]]
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    docs, got = stage(3, docs)
    clean = dict(zip((r[0] for r in rows), brute_redaction([t for _, t, _ in rows]), strict=True))
    assert {r["doc_id"]: r["text"] for r in got} == clean and any(secrets.PLACEHOLDER in t for t in clean.values())
    _, got = stage(4, docs)
    library = Tokenizer.from_file(corpus_pipeline.vocabulary("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    import zlib

    import numpy as np

    assert set(pieces) == set(clean)
    for i, some in pieces.items():
        ids, at = np.array([*library.encode(clean[i], add_special_tokens=False).ids, 0], "<u4"), 0
        for start, length, crc in sorted(some):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
