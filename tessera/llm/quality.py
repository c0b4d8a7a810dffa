"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote good (1) or bad (0) or abstain (-1) on each document. Expectation-maximisation over the counts of vote
patterns estimates each rule's accuracy on either class and the share of good documents; a document's verdict is its
posterior probability of being good. There are at most ``3 ** len(RULES)`` patterns, whatever the corpus size, so the
iterations read a small table; they run as aggregations all the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import as_row, from_row, named, stored

#: White space between words: space and the characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Words of a window in which repetition counts.
WINDOW = 8
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "a als au avec be by con da das de del den der des die du ein el en er es est et for from go il im in is ist it la las le les "
    "los mit nicht of on or para por pour que se sich sie su sur that the this to un una und une von was with y zu"
).split()

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_bangs", "n_stop", "n_short_again")
#: Longest word that counts as short where a text repeats it.
SHORT = 5


def with_features(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all of ``docs`` by default) as the struct ``__row``, and the counts that the rules read,
    under ``__``-names.

    A null text counts as empty. Equal 8-word windows are found by 64-bit hashes of word hashes; the positions of the
    repeated ones are sorted, and each position covers the words up to the next one, 8 at most.
    """
    own = lambda *cols: ["__row", *cols]
    t = F.coalesce(named(text), F.lit(""))
    df = docs.select(as_row(docs.columns if carry is None else carry), t.alias("__text"))
    df = df.select(*own("__text", F.array_remove(F.split("__text", f"{SPACE}+"), "").alias("__words"), F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines")))
    without = lambda chars: reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), chars, F.col("__text"))
    short = F.filter("__words", lambda w: (F.length(w) <= SHORT) & w.rlike(r"^\p{L}+$"))
    count = lambda chars: (F.length("__text") - F.length(without(chars))).cast("long")
    df = df.select(
        *own(
            F.size("__words").cast("long").alias("__n_words"),
            F.length(without(" \t\n\x0b\f\r")).cast("long").alias("__word_chars"),
            count("#*$%&|<>").alias("__n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
            F.size("__lines").cast("long").alias("__n_lines"),
            (F.length("__text") - F.length(F.regexp_replace("__text", r"\p{Lu}+", ""))).cast("long").alias("__n_upper"),
            count("!").alias("__n_bangs"),
            F.size(F.array_intersect("__words", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("__n_stop"),
            (F.size(short) - F.size(F.array_distinct(short))).cast("long").alias("__n_short_again"),
            F.transform("__words", lambda w: F.xxhash64(w)).alias("__hash"),
        )
    )
    counts = [f"__{c}" for c in (*(f for f in FEATURES if f != "n_repeat_words"), *_MORE)]
    for span in (1, 2, 4):  # hashes of 2, 4 and 8 words: each joins two of half the span
        df = df.select(*own(*counts, F.zip_with("__hash", F.slice("__hash", span + 1, F.size("__hash")), lambda a, b: F.xxhash64(a, b)).alias("__hash")))
    # the last ones lack a full window
    df = df.select(*own(*counts, F.when(F.col("__n_words") > WINDOW, F.slice("__hash", F.lit(1), (F.col("__n_words") - WINDOW + 1).cast("int"))).alias("__grams")))
    placed = F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.select(*own(*counts, placed.alias("__placed")))
    at = lambda k: F.get("__placed", k)["g"]
    again = F.filter("__placed", lambda x, k: F.coalesce(at(k - 1) == x["g"], F.lit(False)) | F.coalesce(at(k + 1) == x["g"], F.lit(False)))
    df = df.select(*own(*counts, F.array_sort(F.transform(again, lambda x: x["i"])).alias("__again")))
    covered = F.aggregate(F.transform("__again", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__again", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(*own(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("__n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def rules() -> list[Rule]:
    c = lambda name: F.col(f"__{name}")
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    mean = c("word_chars") / words
    # texts of any language repeat short words of their own; one that does may be in a language that the list lacks
    own_words = c("n_short_again") >= 0.02 * c("n_words")
    return [
        Rule("symbols", c("n_symbols") > 0.05 * chars, c("n_symbols") <= 0.01 * chars),
        Rule("duplicate_lines", (c("n_lines") >= 3) & (c("n_dup_lines") > 0.3 * c("n_lines")), (c("n_lines") >= 3) & (c("n_dup_lines") <= 0.1 * c("n_lines"))),
        Rule("repetition", c("n_repeat_words") > 0.25 * c("n_words"), (c("n_words") >= 50) & (c("n_repeat_words") <= 0.05 * c("n_words"))),
        Rule("word_length", (mean < 2.5) | (mean > 14), (mean >= 3.5) & (mean <= 10)),
        Rule("capitals", (chars >= 40) & (c("n_upper") > 0.4 * chars), (chars >= 40) & (c("n_upper") <= 0.15 * chars)),
        Rule("exclamation", c("n_bangs") > 0.2 * words, c("n_bangs") <= 0.02 * words),
        Rule("stop_words", (c("n_words") >= 60) & (c("n_stop") < 2) & ~own_words, (c("n_words") >= 30) & (c("n_stop") >= 3)),
    ]


RULES = ("symbols", "duplicate_lines", "repetition", "word_length", "capitals", "exclamation", "stop_words")


@dataclass(frozen=True)
class RuleModel:
    """Share of good documents; per rule P(votes good | good, votes) and P(votes bad | bad, votes)."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def posterior(self) -> Column:
        """Probability of good, from the vote columns ``__v_<rule>``."""
        odds = F.lit(log(self.prior / (1 - self.prior)))
        for r in self.on_good:
            g, b = self.on_good[r], self.on_bad[r]
            v = F.col(f"__v_{r}")
            odds = odds + F.when(v == 1, log(g / (1 - b))).when(v == 0, log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def with_votes(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.when(r.bad, 0).when(r.good, 1).otherwise(-1).alias(f"__v_{r.name}") for r in rules()))


def fit(votes: DataFrame, iterations: int = 12) -> RuleModel:
    """Expectation-maximisation on vote patterns. An empty table gives the starting values.

    Most rules see one kind of junk only, so a rule starts by letting 0.99 of the good documents pass and catching 0.25
    of the bad ones, with a Beta prior worth 20 votes at these values. A rule's catch on bad documents stays at or over
    twice its misses on good ones: rules are assumed better than chance, which keeps the classes from changing places.
    """
    names = [f"__v_{r}" for r in RULES]
    patterns = stored(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = RuleModel(0.7, dict.fromkeys(RULES, 0.99), dict.fromkeys(RULES, 0.25))
    bound = lambda x, lo, hi: min(max(x, lo), hi)
    for _ in range(iterations):
        p = patterns.select("*", model.posterior().alias("p"))
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good")]
        for r in RULES:
            v, g, b = F.col(f"__v_{r}"), F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
            sums += [F.sum(F.when(v == 1, g)).alias(f"gg_{r}"), F.sum(F.when(v >= 0, g)).alias(f"g_{r}"), F.sum(F.when(v == 0, b)).alias(f"bb_{r}"), F.sum(F.when(v >= 0, b)).alias(f"b_{r}")]
        s = p.agg(*sums).first()
        if not s["n"]:
            break
        on_good = {r: bound(((s[f"gg_{r}"] or 0) + 19.8) / ((s[f"g_{r}"] or 0) + 20), 0.8, 0.999) for r in RULES}
        on_bad = {r: bound(((s[f"bb_{r}"] or 0) + 5) / ((s[f"b_{r}"] or 0) + 20), 2 * (1 - on_good[r]), 0.98) for r in RULES}
        model = RuleModel(bound((s["good"] + 8) / (s["n"] + 10), 0.02, 0.98), on_good, on_bad)
    return model


def score_quality(docs: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = 0.75) -> DataFrame:
    """Features, votes, posterior and verdict of every document.

    Returns the ``carry`` columns (all by default), ``q_n_words``, ``q_word_chars``, ``q_n_symbols``,
    ``q_n_dup_lines``, ``q_n_repeat_words`` (long), ``q_posterior`` (double), ``q_base_failed`` and ``q_kept``
    (boolean). Any column may hold nulls; a null or empty text has no words and fails the base rules. Texts of any length
    are read whole. Repeated rows are judged alike and all returned; a posterior equal to ``threshold`` is kept; an empty
    table gives an empty result; other columns are untouched, but one that has the name of a new column is replaced. The
    votes are stored once, with the carried columns, and read for the fit and for the verdict.
    """
    votes = stored(with_votes(with_features(docs, text, carry)), "votes")
    model = fit(votes)
    failed = (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))
    new = {f"q_{f}": F.col(f"__{f}") for f in FEATURES} | {"q_posterior": model.posterior(), "q_base_failed": failed, "q_kept": ~failed & (model.posterior() >= threshold)}
    return from_row(votes, new, docs.columns if carry is None else carry)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` would keep, all columns as they are.

    Only votes are stored, a few bits a row, for the fit; texts are looked at a second time for the verdict, and no row is
    stored. A row is kept if its votes are one of the at most ``3 ** len(RULES)`` patterns with a posterior of
    ``threshold`` or more and the base rules don't fail; so the result can be read while other results are, and by them.
    Nulls, empty and long texts, repeated rows and empty tables are as there.
    """
    names = [f"__v_{r}" for r in RULES]
    votes = stored(with_votes(with_features(docs, text, [])).select(names), "votes")
    patterns = votes.distinct().where(fit(votes).posterior() >= threshold).select(*(F.col(c).alias(f"{c}_") for c in names), F.lit(False).alias("__failed_"))
    failed = F.coalesce((F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words")), F.lit(True))
    rows = with_votes(with_features(docs, text)).select("__row", *names, failed.alias("__failed"))
    meets = reduce(lambda a, c: a & (F.col(c) == F.col(f"{c}_")), [*names, "__failed"], F.lit(True))
    # the broadcast side has a row a pattern
    return from_row(rows.join(F.broadcast(stored(patterns.coalesce(1), "patterns")), meets, "left_semi"), {}, docs.columns)
