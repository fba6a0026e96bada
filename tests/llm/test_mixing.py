import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.llm import mixing

from .helpers import docs, empty, rows


def water(sizes, share=1.5, passes=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if passes * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = float(passes * sizes[s])
            left -= target[s]
        free -= full
    return target


def table(spark, n=3000):
    r = random.Random(4)
    names = ["a", "b", "B", "é", "z" * 3, "", None]
    data = [(i, names[0] if r.random() < 0.3 else r.choice(names), r.randint(0, 200)) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, source string, size long")


@pytest.mark.parametrize("bucket", [4096, 16])
def test_targets_and_taken(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    data, df = table(spark)
    out = mixing.mix(df.repartition(5)).collect()
    sizes, taken = Counter(), Counter()
    for _, s, n in data:
        sizes[s] += n
    want = water(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(out) == len(data)
    assert all(abs(taken[s] - want[s]) <= 400 for s in sizes)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_order_is_fair(spark):
    """However far the merged queue has come, every source has its share of it."""
    data, df = table(spark)
    done = defaultdict(int)
    for r in mixing.mix(df).collect():
        done[r.source] += r.taken
    assert sum(done.values()) <= 1.5 * sum(n for _, _, n in data)


def test_awkward_tables(spark):
    sized = docs(spark, extra=True).withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.mix(sized)
    assert out.count() == len(rows())
    assert mixing.mix(empty(spark).withColumn("size", F.lit(1))).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, "s", None), (2, None, 0)], "doc_id long, source string, size long")).collect()
    assert [(r.size, r.taken) for r in nothing] == [(0, 0), (0, 0)]
    alike = mixing.mix(spark.createDataFrame([(1, "s", 10)] * 3 + [(None, "s", 10), (2, "t", 10)], "doc_id long, source string, size long")).collect()
    assert len(alike) == 5 and all(r.taken <= 20 for r in alike)
