"""Gate, strategies, cascade, counters: against plain restatements on random sets."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.operators import cascade, gate, sinks, stats
from kindred.operators.strategies import ALIASES, STRATEGIES, Strategy, canonical, register

SCHEMA = "source_path string, mail_id string, path string, box_format string, repr string, mail_hash string, timestamp double, size long, body_hash string, body_lines array<string>, rejection string, encoding_error boolean"


def rows(spark, data):
    """data: (set, id, time, lines)"""
    out = [("box", str(i), f"box/{i}", "table", f"<{i}>", s, t, sum(map(len, lines)), "|".join(lines), lines, None, False) for s, i, t, lines in data]
    return spark.createDataFrame(out, SCHEMA)


def naive_evict(members, size_threshold, content_threshold):
    members, by_size, edges, memo = sorted(members), False, {}, {}
    for a, b in combinations(members, 2):
        if size_threshold >= 0 and abs(a[1] - b[1]) > size_threshold:
            by_size = bad = True
        else:
            pair = frozenset((a[2], b[2]))
            if pair not in memo:
                memo[pair] = 0 if a[2] == b[2] else gate.diff_length(a[3], b[3])
            bad = content_threshold >= 0 and memo[pair] > content_threshold
        if bad:
            edges.setdefault(a[0], set()).add(b[0])
            edges.setdefault(b[0], set()).add(a[0])
    out = set()
    while any(edges.values()):
        worst = min(edges, key=lambda x: (-len(edges[x]), x))
        for other in edges.pop(worst):
            edges[other].discard(worst)
        out.add(worst)
    return out, ("skipped_size" if by_size else "skipped_content") if out and len(members) - len(out) < 2 else None


def test_eviction_is_greedy_over_pairs():
    r = random.Random(1)
    for _ in range(300):
        bodies = [["x" * r.choice([1, 5, 9, 30, 60])] + [f"l{r.randint(0, 3)}" for _ in range(r.randint(0, 4))] for _ in range(4)]
        members = []
        for i in range(r.randint(2, 9)):
            lines = r.choice(bodies)
            members.append((f"<{i}>", sum(map(len, lines)), "|".join(lines), lines))
        limits = r.choice([-1, 0, 10, 40]), r.choice([-1, 12, 30, 60])
        assert gate.evict(members, *limits) == naive_evict(members, *limits)


def test_diff_length():
    assert gate.diff_length(["aaaa bbbb"], ["cccc dddd"]) == 44 and gate.diff_length(["a"], ["a"]) == 0


def keep(name, pool, pattern):
    ts, sizes = [m["t"] for m in pool], [m["size"] for m in pool]
    if STRATEGIES[name].timed and None in ts:
        return None
    return {
        "select-older": lambda m: m["t"] < max(ts), "select-oldest": lambda m: m["t"] == min(ts),
        "select-newer": lambda m: m["t"] > min(ts), "select-newest": lambda m: m["t"] == max(ts),
        "select-smaller": lambda m: m["size"] < max(sizes), "select-smallest": lambda m: m["size"] == min(sizes),
        "select-bigger": lambda m: m["size"] > min(sizes), "select-biggest": lambda m: m["size"] == max(sizes),
        "select-matching-path": lambda m: pattern in m["path"], "select-non-matching-path": lambda m: pattern not in m["path"],
    }[STRATEGIES[name].name]


def naive(pool, names, pattern):
    failed = "skipped_strategy"
    for name in names:
        k = keep(name, pool, pattern)
        failed = "skipped_timestamp" if k is None else "skipped_strategy"
        if k is not None and 0 < len(kept := {m["id"] for m in pool if k(m)}) < len(pool):
            return name, kept, "deduplicated"
    return None, set(), failed


DETERMINED = [s for s in STRATEGIES if not STRATEGIES[s].name.endswith("one")]


def test_cascades(spark):
    r = random.Random(2)
    data = []
    for s in range(60):
        for _ in range(r.randint(1, 5)):
            data.append((f"s{s}", len(data), r.choice([None, 1.0, 2.0, 2.0, 3.0]) if s % 3 == 0 else float(r.randint(-3, 3)), ["y" * r.randint(1, 4)]))
    df = rows(spark, data).cache()
    for _ in range(14):
        names = canonical(r.sample(DETERMINED, r.randint(1, 3)))
        c = Config(strategies=names, regexp="[13]$", size_threshold=-1, content_threshold=-1)
        got = {}
        for x in cascade.decide(df, c).collect():
            got.setdefault(x.mail_hash, []).append(x)
        for s, members in got.items():
            pool = [{"id": x.mail_id, "t": x.timestamp, "size": x.size, "path": "hit" if x.path[-1] in "13" else "miss"} for x in members]
            if len(pool) == 1:
                assert [(x.decision, x.set_outcome) for x in members] == [("unique", "single")]
                continue
            name, kept, outcome = naive(pool, names, "hit")
            for x in members:
                assert x.set_outcome == outcome and x.strategy == name
                assert x.decision == ("skipped" if name is None else "selected" if x.mail_id in kept else "discarded")
                if x.decision == "discarded":
                    assert tuple(x.link_target) == min((y.path, y.mail_id) for y in members if y.mail_id in kept)


def test_random_choice_is_seeded(spark):
    df = rows(spark, [("s", i, 1.0, ["a"]) for i in range(8)])
    picks = []
    for seed in (0, 0, 1, 2, 3):
        c = Config(strategies=("select-one",), size_threshold=-1, content_threshold=-1, seed=seed)
        got = [x.mail_id for x in cascade.decide(df.repartition(seed + 1), c).filter("decision = 'selected'").collect()]
        assert len(got) == 1
        picks += got
    assert picks[0] == picks[1] and len(set(picks)) > 1
    c = Config(strategies=("discard-one",), size_threshold=-1, content_threshold=-1)
    assert cascade.decide(df, c).filter("decision = 'discarded'").count() == 1


@pytest.mark.parametrize("names", [(), ("select-biggest", "select-one"), ("select-older",)])
def test_whole_decision_obeys_the_laws(spark, names):
    r = random.Random(3)
    data = [(f"s{r.randint(0, 20)}", i, r.choice([None, 1.0, 2.0]), ["z" * r.choice([1, 2, 700, 1500]), "q" * r.choice([1, 900])]) for i in range(90)]
    df = rows(spark, data).withColumn("rejection", F.when(F.col("mail_id") == "5", "why")).withColumn("encoding_error", F.col("mail_id") == "7")
    got = cascade.decide(df, Config(strategies=names)).cache()
    for verb, subset in ((None, "selected"), ("copy", "selected"), ("delete", "discarded"), ("hardlink", "discarded")):
        row = stats.stats(got, verb, subset).first().asDict()
        assert stats.broken_laws(row, verb, subset) == []
    assert row["mail_found"] == 90 and row["mail_rejected"] == 1
    report = stats.report(stats.stats(got)).collect()
    assert len(report) == 22 and report[0].category == "mail"
    members = {}
    for s, i, t, lines in data:
        if i != 5:
            members.setdefault(s, []).append((f"<{i}>", sum(map(len, lines)), "|".join(lines), lines))
    evicted = {x.repr for x in got.filter("evicted").collect()}
    for s, m in members.items():
        coded = any(x[0] == "<7>" for x in m)
        want, skip = naive_evict(m, 512, 768) if len(m) > 1 and not coded else (set(), None)
        assert {x[0] for x in m} & evicted == want
        outcome = {x.set_outcome for x in got.filter(F.col("mail_hash") == s).filter("rejection is null").collect()}
        assert outcome == {"single"} if len(m) == 1 else outcome == {"skipped_encoding"} if coded else skip is None or outcome == {skip}
    assert stats.broken_laws({**row, "mail_unique": 99}) != []


def test_stale_extremes(spark):
    """A size strategy that looks for the size of an evicted record picks nothing."""
    df = rows(spark, [("s", 0, 1.0, ["a" * 2000]), ("s", 1, 1.0, ["a" * 10]), ("s", 2, 1.0, ["a" * 20])])
    for stale, want in ((False, "deduplicated"), (True, "skipped_strategy")):
        c = Config(strategies=("select-biggest",), content_threshold=-1, stale_size_extremes=stale)
        assert {x.set_outcome for x in cascade.decide(df, c).collect()} == {want}


def test_registry_and_aliases():
    assert len(STRATEGIES) == 24 and all(STRATEGIES[a] is STRATEGIES[b] for a, b in ALIASES.items())
    assert canonical(["discard-newest", "select-older", "select-one"]) == ("discard-newest", "select-one")
    with pytest.raises(ValueError):
        canonical(["select-nothing"])
    register(Strategy("select-everything", lambda: F.lit(True), lambda: F.lit(False)))
    assert canonical(["select-everything"])
    del STRATEGIES["select-everything"]


def test_swarm_makes_no_diff(monkeypatch):
    monkeypatch.setattr(gate, "diff_length", lambda a, b: pytest.fail("equal bodies were compared"))
    assert gate.evict([(f"<{i}>", 5, "h", ["same"]) for i in range(40)], 0, 0) == (set(), None)


def test_option_demands():
    with pytest.raises(ValueError):
        Config(strategies=("select-matching-path",)).check(True)
    with pytest.raises(ValueError):
        Config(action="copy-selected").check(True)
    with pytest.raises(ValueError):
        Config(action="delete-discarded", export="x").check(True)
    with pytest.raises(ValueError):
        Config(size_threshold=-2)
    Config().check(False)
    Config(action="delete-discarded").check(True)
    assert sinks.verb("copy-selected") == "copy" and sinks.subset("hardlink-discarded") == "discarded"
