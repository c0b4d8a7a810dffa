"""Secret scanning in DataFrame functions only: known shapes, and a randomness test battery for the rest.

Tokens of ``MIN_RANDOM`` or more characters are candidates. Each is read in the smallest
encoding that holds its characters and tested for chi-squared uniformity over that alphabet, runs about its middle and
serial correlation. Fisher's method joins the three p-values of "random". A token is reported where, among tokens of
its encoding and length class, the share of ordinary tokens over its p-value stays under ``fdr``; short tokens, on
which the tests have less power, need larger p-values for that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import as_row, from_row, named, stored

#: Kinds and patterns of the base rules. Runs of a class match whole, so their least lengths are in the
#: pattern; a short assignment still uses up its text and is dropped afterwards.
KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED, MIN_RANDOM = 12, 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings by the class of characters they hold, smallest alphabet first.
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ENCODINGS: tuple[tuple[str, str, str], ...] = (
    ("digits", "[0-9]+", DIGITS),
    ("hex", "[0-9a-f]+", DIGITS + LOWER[:6]),
    ("hex_upper", "[0-9A-F]+", DIGITS + LOWER[:6].upper()),
    ("lower", "[a-z]+", LOWER),
    ("upper", "[A-Z]+", LOWER.upper()),
    ("base32", "[A-Z2-7]+", LOWER.upper() + "234567"),
    ("base36", "[0-9a-z]+", DIGITS + LOWER),
    ("base36_upper", "[0-9A-Z]+", DIGITS + LOWER.upper()),
    ("letters", "[A-Za-z]+", LOWER.upper() + LOWER),
    ("base62", "[0-9A-Za-z]+", LOWER.upper() + LOWER + DIGITS),
    ("base64", ".+", LOWER.upper() + LOWER + DIGITS + "+/"),
)
#: Bins of p-values, and least tokens of a class for its own threshold.
BINS, LEAST = 20, 20
PLACEHOLDER = "[secret]"
_STEP = 256



def _find(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds ``__<name>``: the matches of ``pattern`` in ``__text`` as structs ``(begin, end, hit)``, in code points.

    The pieces between matches and the matches' lengths give the places. Their running sums are taken in two levels
    of ``_STEP``, so a text with many matches costs little more than its length.
    """
    own = df.columns
    hits, lens, base = f"__{name}_hits", f"__{name}_lens", f"__{name}_base"
    some = F.size(hits) > 0
    df = df.withColumn(hits, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    pieces = F.when(some, F.split("__text", pattern, -1))
    # per match: the length of the piece before it, and of both together
    df = df.select(*own, hits, F.when(some, F.zip_with(pieces, F.col(hits), lambda p, h: F.when(h.isNotNull(), F.struct(F.length(p).alias("before"), (F.length(p) + F.length(h)).alias("both"))))).alias(lens))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(hits) - 1) / _STEP).cast("int")), lambda b: F.aggregate(F.slice(lens, b * _STEP + 1, _STEP), F.lit(0), lambda a, x: a + F.coalesce(x["both"], F.lit(0))))
    df = df.select(*own, hits, lens, F.when(some, blocks).alias(f"{base}_b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    running = F.aggregate(f"{base}_b", start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    df = df.select(*own, hits, lens, F.when(some, running).alias(base))

    def span(hit: Column, i: Column) -> Column:
        block = (i / _STEP).cast("int")
        before = F.get(base, block) + F.aggregate(F.slice(lens, block * _STEP + 1, i - block * _STEP), F.lit(0), lambda a, x: a + x["both"])
        begin = before + F.get(lens, i)["before"]
        return F.struct(begin.alias("begin"), (begin + F.length(hit)).alias("end"), hit.alias("hit"))

    return df.select(*own, F.coalesce(F.when(some, F.transform(hits, span)), F.array().cast("array<struct<begin:int,end:int,hit:string>>")).alias(f"__{name}"))


def _upper_tail(z: Column) -> Column:
    """P(standard normal > z), by a logistic approximation (error under 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _with_tests(df: DataFrame) -> DataFrame:
    """Adds to each candidate its encoding, length class and p-value of "random"."""
    tested = F.transform("__random", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), _score(s["hit"]).alias("t")))
    return df.withColumn("__random", tested)


def _encoding(token: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(token, "[_-]", "+")  # the URL form's signs count as the other two
    name, letters = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for code, pattern, alphabet in ENCODINGS[-2::-1]:
        fits = bare.rlike(f"^{pattern}$")
        name, letters = F.when(fits, code).otherwise(name), F.when(fits, alphabet).otherwise(letters)
    return name, letters


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _apart(spans: str, others: str) -> Column:
    """The spans that overlap none of the others; both are disjoint and in order.

    One sort of the spans' ends among the others' begins tells how many others begin before a span ends; only the last of
    these can reach into it.
    """
    ends = lambda v: F.transform(v["s"], lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("other")))
    begins = lambda v: F.transform(v["o"], lambda o: F.struct(o["begin"].alias("at"), F.lit(1).alias("other")))
    places = lambda v: F.filter(F.transform(F.array_sort(F.concat(ends(v), begins(v))), lambda x, j: F.when(x["other"] == 0, j)), lambda j: j.isNotNull())
    last = lambda w, i: F.get(w["v"]["o"], F.get(w["at"], i) - i - 1)
    kept = lambda w: F.filter(w["v"]["s"], lambda s, i: F.coalesce(last(w, i)["end"] <= s["begin"], F.lit(True)))
    return _let(F.struct(F.col(spans).alias("s"), F.col(others).alias("o")), lambda v: _let(F.struct(v.alias("v"), places(v).alias("at")), kept))


def _score(hit: Column) -> Column:
    """``(encoding, size, p)``: the battery on one token, without padding signs.

    Nested one-element transforms name the intermediate values, so that each is computed once.
    """
    token = F.rtrim(hit, F.lit("="))

    def battery(e: Column) -> Column:
        m, n = e["m"].cast("double"), F.size(e["x"]).cast("double")
        squares = F.aggregate(
            F.array_sort(e["x"]), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
            lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1.0).alias("run"), (a["sum"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(1.0)).alias("sum")),
            lambda a: a["sum"],
        )
        chi = m / n * squares - n
        uniform = _upper_tail((chi - (m - 1)) / F.sqrt(2 * (m - 1) * (1 - 1 / n)))
        pairs = F.zip_with(F.slice(e["x"], F.lit(1), F.size(e["x"]) - 1), F.slice(e["x"], F.lit(2), F.size(e["x"]) - 1), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
        middle = (m - 1) / 2
        runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda s, q: s + ((q["a"] > middle) != (q["b"] > middle)).cast("double"))
        above = F.aggregate(e["x"], F.lit(0.0), lambda s, x: s + (x.cast("double") > middle).cast("double"))
        mean = 1 + 2 * above * (n - above) / n
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0))
        turning = F.when(spread > 0, 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(spread))).otherwise(0.0)
        average = F.aggregate(e["x"], F.lit(0.0), lambda s, x: s + x) / n
        variance = F.aggregate(e["x"], F.lit(0.0), lambda s, x: s + (x - average) * (x - average))
        cross = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + (q["a"] - average) * (q["b"] - average))
        serial = F.when(variance > 0, 2 * _upper_tail(F.abs(cross / variance + 1 / n) * F.sqrt(n))).otherwise(0.0)
        log = lambda p: F.log(F.greatest(p, F.lit(1e-300)))
        half = -(log(uniform) + log(turning) + log(serial))
        return F.struct(e["code"].alias("encoding"), F.size(e["x"]).alias("size"), (F.exp(-half) * (1 + half + half * half / 2)).alias("p"))

    def coded(bare: Column) -> Column:
        name, letters = _encoding(bare)
        places = F.transform(F.split(F.translate(bare, "_-", "/+"), ""), lambda ch: F.instr(letters, ch) - 1)
        return F.struct(name.alias("code"), F.length(letters).alias("m"), F.filter(places, lambda x: x >= 0).alias("x"))

    return _let(token, lambda bare: _let(coded(bare), battery))


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns as the struct ``__row``, and the found and tested spans."""
    df = docs.select(as_row(docs.columns if carry is None else carry), F.coalesce(named(text), F.lit("")).alias("__text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE)):
        df = _find(df, name, pattern)
    long_enough = F.filter("__assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= MIN_ASSIGNED)
    plain = lambda a: F.transform(a, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    df = df.select("__row", plain(long_enough).alias("__assign"), plain(F.col("__access")).alias("__access"), plain(F.col("__hex")).alias("__hex"), "__random")
    for name in ("__assign", "__access", "__hex"):
        df = df.withColumn("__random", _apart("__random", name))
    df = df.withColumn("__random", F.filter("__random", lambda s: F.length(F.rtrim(s["hit"], F.lit("="))) >= MIN_RANDOM))
    return _with_tests(df)


@dataclass(frozen=True)
class Thresholds:
    """Least p-value by (encoding, length class), at most ``len(ENCODINGS) * 4`` of them; ``other`` elsewhere."""

    by_class: dict[tuple[str, int], float]
    other: float

    def of(self, encoding: Column, size: Column) -> Column:
        out = F.lit(self.other)
        for (name, length), least in sorted(self.by_class.items()):
            out = F.when((encoding == name) & (_length_class(size) == length), least).otherwise(out)
        return out


def _length_class(size: Column) -> Column:
    return F.when(size < 32, 0).when(size < 64, 1).when(size < 128, 2).otherwise(3)


def control(scanned: DataFrame, fdr: float = 0.1, fallback: float = 0.05) -> Thresholds:
    """Thresholds from all tokens of the corpus, by counts of p-values in ``BINS`` bins.

    Random tokens have uniform p-values: their number is estimated from the upper half. What a class has over a
    threshold beyond its share of these are ordinary tokens; the least threshold at which they stay under ``fdr`` is
    taken. A class of fewer than ``LEAST`` tokens has ``fallback``.
    """
    tokens = scanned.select(F.explode("__random").alias("s")).select(F.col("s.t.encoding").alias("encoding"), _length_class(F.col("s.t.size")).alias("length"), F.least(F.floor(F.col("s.t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[tuple[str, int], list[int]] = {}
    for r in tokens.groupBy("encoding", "length", "bin").count().collect():  # encodings x 4 x BINS at most
        counts.setdefault((r["encoding"], r["length"]), [0] * BINS)[r["bin"]] = r["count"]
    chosen = {}
    for key, n in counts.items():
        if sum(n) < LEAST:
            continue
        random = min(sum(n), 2 * sum(n[BINS // 2 :]))
        first = ceil(fallback * BINS)
        chosen[key] = next((b / BINS for b in range(first, BINS) if sum(n[b:]) and max(0.0, sum(n[b:]) - random * (1 - b / BINS)) <= fdr * sum(n[b:])), 1.0)
    return Thresholds(chosen, fallback)


def find_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None, fdr: float = 0.1) -> DataFrame:
    """The ``carry`` columns (all by default), ``s_base`` and ``s_spans``.

    Both are arrays of ``(begin, kind, end)`` by begin, then kind as listed in ``KINDS`` (by number), in code points,
    end exclusive: the base matches, and these with the random tokens that overlap none of them. A null text counts as
    empty; texts of any length are read whole. Nulls, repeated rows and other columns stay as they are, but one named
    ``s_base`` or ``s_spans`` is replaced; a p-value equal to its threshold is not reported; an empty table gives an
    empty result. Spans are stored once and read for the control and for the result.
    """
    scanned = stored(scan(docs, text, carry), "spans")
    least = control(scanned, fdr)
    tag = lambda a, k: F.transform(a, lambda s: F.struct(s["begin"].alias("begin"), F.lit(k).alias("kind"), s["end"].alias("end")))
    base = F.concat(*(tag(F.col(f"__{name}"), k) for k, name in enumerate(KINDS[:3])))
    more = tag(F.filter("__random", lambda s: s["t"]["p"] > least.of(s["t"]["encoding"], s["t"]["size"])), 3)
    return from_row(scanned, {"s_base": F.array_sort(base), "s_spans": F.array_sort(F.concat(base, more))}, docs.columns if carry is None else carry)


def as_text(spans: str) -> Column:
    """``kind:begin:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["begin"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", fdr: float = 0.1) -> DataFrame:
    """``docs`` with every found span replaced by ``PLACEHOLDER``; overlapping spans are replaced as one.

    A null text stays null and an empty one empty; texts of any length are read whole; repeated rows are all returned,
    alike; columns keep their order, names and, but for ``text``, values; an empty table gives an empty result.
    """
    row = as_row(docs.columns)
    own = F.col("__row").getField(f"_{docs.columns.index(text)}")
    # the text is stored once, within its row
    found = find_secrets(docs.select(row).select("__row", F.coalesce(own, F.lit("")).alias("text")), carry=["__row"], fdr=fdr)
    # the spans' union, as (begin, end) in order: a cut begins where a span begins after all ends before it
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))
    grow = lambda a, s: F.struct(
        F.greatest(a["reach"], s["end"]).alias("reach"),
        F.when(s["begin"] > a["reach"], F.concat(a["out"], F.array(F.struct(s["begin"].alias("begin"), s["end"].alias("end")))))
        .otherwise(F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(F.element_at(a["out"], -1)["begin"].alias("begin"), F.greatest(a["reach"], s["end"]).alias("end"))))).alias("out"),
    )
    cuts = F.when(F.size("s_spans") > 0, F.aggregate("s_spans", start, grow, lambda a: a["out"]))
    merged = found.select("__row", F.coalesce(own, F.lit("")).alias("text"), cuts.alias("s_cuts"))
    after = lambda i: F.coalesce(F.get("s_cuts", i - 1)["end"], F.lit(0))
    parts = F.transform("s_cuts", lambda s, i: F.concat(F.col("text").substr(after(i) + 1, s["begin"] - after(i)), F.lit(PLACEHOLDER)))
    rest = F.col("text").substr(F.element_at("s_cuts", -1)["end"] + 1, F.length("text"))
    clean = F.when(F.col("s_cuts").isNotNull(), F.concat(F.array_join(parts, ""), rest)).otherwise(own)
    return from_row(merged, {text: clean}, docs.columns).select(*map(named, docs.columns))
