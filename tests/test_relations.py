import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import relations as R
from tessera.operators.lines import lines_of

FACTS = """# facts
SADD users alice
SADD users bob
SADD users alice
SADD users carol
SADD admins alice
RADD follows alice bob
RADD follows bob carol
RADD follows carol dana
RADD follows alice bob
RADD blocked bob carol"""


def atoms(df):
    return " ".join(sorted(r["atom"] for r in df.collect()))


def pairs(df):
    return sorted((r["left"], r["right"]) for r in df.collect())


def lines(spark, text):
    return lines_of(spark.createDataFrame([("f", text)], "path string, text string"))


def test_goldens(spark):
    state, bad = R.load_facts(lines(spark, FACTS))
    assert bad is None
    users, admins = R.members(state, "users"), R.members(state, "admins")
    assert atoms(R.union(users, admins)) == "alice bob carol"
    assert atoms(R.intersect(users, admins)) == "alice"
    assert atoms(R.diff(users, admins)) == "bob carol"
    assert R.is_subset(state, "admins", "users") and not R.is_subset(state, "users", "admins")
    assert R.is_subset(state, "nobody", "users") and not R.is_subset(state, "users", "nobody")
    follows, blocked = R.pairs(state, "follows"), R.pairs(state, "blocked")
    assert atoms(R.select(follows, "first", "alice")) == "bob" and atoms(R.select(follows, "second", "carol")) == "bob"
    assert pairs(R.compose(follows, follows)) == [("alice", "carol"), ("bob", "dana")]
    assert atoms(R.domain(follows)) == "alice bob carol" and atoms(R.range_(follows)) == "bob carol dana"
    assert pairs(R.inverse(follows)) == [("bob", "alice"), ("carol", "bob"), ("dana", "carol")]
    assert pairs(R.rdiff(follows, blocked)) == [("alice", "bob"), ("carol", "dana")]
    assert len(pairs(R.runion(follows, blocked))) == 3 and pairs(R.rintersect(follows, blocked)) == [("bob", "carol")]
    assert len(pairs(R.transitive_closure(follows))) == 6
    assert sorted(r["set"] for r in R.sets_containing(state, "alice").collect()) == ["admins", "users"]
    assert sorted(r["name"] for r in R.relation_names(state).collect()) == ["blocked", "follows"]
    assert R.is_member(state, "users", "bob") and not R.is_member(state, "admins", "bob")


def test_round_trip_and_emptied_set(spark):
    state, _ = R.load_facts(lines(spark, FACTS + "\nSREM admins alice\nSREM nothing x"))
    assert R.members(state, "admins").isEmpty()
    assert sorted(r["name"] for r in R.set_names(state).collect()) == ["admins", "users"]
    assert not R.is_subset(state, "admins", "nobody")
    text = "\n".join(r["line"] for r in R.dump_facts(state).collect())
    again, _ = R.load_facts(lines(spark, text))
    assert pairs(R.pairs(again, "follows")) == pairs(R.pairs(state, "follows")) and atoms(R.members(again, "users")) == "alice bob carol"
    assert sorted(r["name"] for r in R.set_names(again).collect()) == ["users"]


def test_bad_line_keeps_what_came_before(spark):
    for wrong in ("NOPE a b", "SADD a", "SADD a b c", "RADD a b", "SADD a!b c"):
        state, bad = R.load_facts(lines(spark, f"SADD s one\n{wrong}\nSADD s two"))
        assert bad == 2 and atoms(R.members(state, "s")) == "one"
    state, bad = R.load_facts(lines(spark, "RADD r a b extra"))
    assert bad is None and pairs(R.pairs(state, "r")) == [("a", "b")]


def test_closure_of_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "a")], '`left` string, `right` string')
    got = pairs(R.transitive_closure(edges))
    assert got == sorted([(p, q) for p in "abc" for q in "abc"] + [("d", "d")] + [("x", q) for q in "abc"])


def reachable(edges):
    out = set()
    for start in {a for a, _ in edges}:
        seen, todo = set(), [b for a, b in edges if a == start]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b in edges if a == n]
        out |= {(start, n) for n in seen}
    return sorted(out)


def test_closure_doubles_paths(spark, tmp_path):
    """Random graphs with cycles against a search, and a long chain in as many rounds as its length has digits."""
    for seed, nodes, n in ((1, 12, 14), (3, 25, 60)):
        rng = random.Random(seed)
        edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(100 + k, 100 + (k + 1) % 23) for k in range(23)]
        assert pairs(R.transitive_closure(spark.createDataFrame(edges + edges[:3], "`left` long, `right` long"))) == reachable(edges)
    chain = spark.range(300).select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    closure = R.transitive_closure(chain, max_rounds=9)
    assert closure.count() == closure.distinct().count() == 300 * 301 // 2
    with pytest.raises(RuntimeError):
        R.transitive_closure(chain, max_rounds=5)
    assert R.transitive_closure(chain.limit(0)).isEmpty()


def test_tags_and_stores(spark):
    ops = R.tag(spark.createDataFrame([("song1.mp3", ["music", "jazz"]), ("song2.mp3", ["music"])], "file string, tags array<string>"))
    state = R.fold_ops(ops)
    assert atoms(R.files_with(state, "music")) == "song1.mp3 song2.mp3" and atoms(R.tags_of(state, "song1.mp3")) == "jazz music"
    more = R.store_domain(ops, R.pairs(state, "has_tag"), "tagged")
    more = R.store_inverse(more, R.pairs(state, "has_tag"), "holds")
    more = R.append_ops(more, R.remove(spark, "tags", "jazz"))
    more = R.append_ops(more, R.unrelate(spark, "has_tag", "song2.mp3", "music"))
    state = R.fold_ops(more)
    assert atoms(R.members(state, "tagged")) == "song1.mp3 song2.mp3" and atoms(R.members(state, "tags")) == "music"
    assert ("music", "song1.mp3") in pairs(R.pairs(state, "holds")) and len(pairs(R.pairs(state, "has_tag"))) == 2
    audit = R.coverage_audit(state, [("untagged", "files", "has_tag", "domain")])
    assert [(r["check"], r["atom"]) for r in audit.collect()] == [("untagged", "song2.mp3")]
    assert more.where(F.col("seq").isNull()).isEmpty()
