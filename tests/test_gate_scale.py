"""The gate judges classes: sets of many bodies cost what they hold, not their pairs, and verdicts stay those of pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.operators import cascade, gate
from tests.test_sets import naive_evict, rows

LINES = ["", "a", "ok", "Les.", "x" * 20, "y" * 53, "z" * 90, "The same words again and again.", "w" * 150, "v" * 300]


def bodies(r, n):
    """Texts of common lines, near copies of earlier ones, and texts with nothing in common."""
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 and out:
            lines = list(r.choice(out))
            lines[r.randrange(len(lines))] = r.choice([*LINES, f"{i}", f"{i}" * 40])
        elif kind < 0.8:
            lines = [r.choice(LINES) for _ in range(r.randint(1, 14))]
        else:
            lines = [f"{i} {r.random()}" * r.randint(1, 12) for _ in range(r.randint(1, 5))]
        out.append(lines)
    return out


@pytest.mark.parametrize("sizes, contents", [(32, 768), (-1, 768), (100, 300), (200, 40), (-1, 0), (8, -1), (0, 200)])
def test_verdicts_are_those_of_all_pairs(spark, sizes, contents):
    r = random.Random(sizes * 1000 + contents)
    data = [(f"s{s}", 100 * s + i, 1.0, lines) for s in range(6) for i, lines in enumerate(bodies(r, 40))]
    df = rows(spark, data).repartition(5)
    got = cascade.decide(df, Config(strategies=("select-one",), size_threshold=sizes, content_threshold=contents)).collect()
    assert len(got) == len(data)
    for s in range(6):
        # Bodies are told apart by their digests, which the tables make of joined lines.
        members = [(f"<{i}>", sum(map(len, lines)), "|".join(lines), lines) for k, i, _, lines in data if k == f"s{s}"]
        want, skip = naive_evict(members, sizes, contents)
        mine = [x for x in got if x.mail_hash == f"s{s}"]
        assert {x.repr for x in mine if x.evicted} == want
        if skip:
            assert {x.set_outcome for x in mine} == {skip}


def test_contents_are_compared_where_lines_are_shared(spark):
    """gate_content_diff: of 300 long bodies, only the few that share lines are paired."""
    data = [("s", i, 1.0, [f"{i:04d}" * 200, "common"] + (["twin" * 100] * 3 if i < 2 else [f"{i:05d}" * 200])) for i in range(300)]
    classes = rows(spark, data).groupBy("mail_hash", "size", "body_hash").agg(F.count("*").alias("count"), F.min("repr").alias("first"), F.first("body_lines").alias("body_lines"))
    classes = gate.settle(gate.measured(classes).withColumn("id", F.monotonically_increasing_id()), "classes")
    pairs = gate.exceptions(classes, -1, 1700).collect()
    close = [(a, b) for a, b in combinations(data, 2) if gate.diff_length(a[3], b[3]) <= 1700]
    assert len(pairs) == len(close) == 1 and pairs[0].like


def test_sizes_are_judged_by_class(spark):
    """gate_size_pairs: a set comes to its task as its sizes, however many its members and bodies are."""
    data = [("s", i, 1.0, [f"{i:06d}", "x" * (i % 7)]) for i in range(2000)]
    got = gate.judge(rows(spark, data), 2, -1).collect()
    assert [r.mail_hash for r in got] == ["s"] * 7
    members = [(f"<{i}>", sum(map(len, lines)), "|".join(lines), None) for _, i, _, lines in data[:60]]
    assert gate.evict(members, 2, -1) == naive_evict([(*m[:3], []) for m in members], 2, -1)


def test_classes_go_as_a_whole_in_linear_memory():
    """gate_evict_outliers: 20,000 different sizes, where pairs would be 200 million."""
    n = 20_000
    size = np.random.default_rng(1).permutation(n)
    none = np.array([], np.int64)
    out = gate.outcasts(size, np.zeros(n, np.int64), np.ones(n, np.int64), none, none, none.astype(bool), 8, -1)
    assert size[~out].max() - size[~out].min() <= 8 and (~out).sum() == 9


def test_flagship_gate_keeps_every_mail(spark):
    """flagship_dedup: a name that two bodies share doesn't double its rows."""
    df = rows(spark, [("s", i, 1.0, ["x" * (40 * i)]) for i in range(3)]).withColumn("repr", F.lit("<same>"))
    c = Config(strategies=("select-newest", "select-biggest", "select-one"), size_threshold=32, content_threshold=-1)
    assert cascade.decide(df, c).count() == 3
