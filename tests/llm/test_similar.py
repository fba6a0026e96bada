"""The pipeline's near-duplicate stage against all pairs of true five-word shingle sets."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kindred.llm import similar

from .helpers import docs, prose


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(text, n, r):
    words = text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def brute(data):
    """doc_ids that survive: the least of each component of pairs at 0.8 or more."""
    s = {i: sets(t) for i, t in data}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in s:
        for j in s:
            if i < j and jaccard(s[i], s[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i for i in s if find(i) == i}


def test_planted_copies(spark, monkeypatch):
    r = random.Random(5)
    data = []
    for i in range(100):
        text = prose(1000 + i, 400, 5000)
        # 2 to 10 changed words of 400 leave similarities from about 0.95 to below 0.8.
        data += [(i, text), (1000 + i, changed(text, 2 + i % 9, r))]
    # A crowd of copies of one text, most of which are not similar to each other, and texts of few or no words.
    text = prose(7, 200, 5000)
    data += [(2000 + i, changed(text, 3 + i % 3, r)) for i in range(12)]
    data += [(3000, "a b c"), (3001, "A  b\nc"), (3002, "a b d"), (3003, ""), (3004, None), (3005, " \n")]
    planted = [jaccard(sets(t), sets(data[k + 1][1])) for k, (_, t) in enumerate(data[:200]) if not k % 2]
    assert sum(0.8 <= j < 0.95 for j in planted) >= 50 and min(planted) < 0.8
    table = docs(spark, [(i, t, "en", "s", 1) for i, t in data])
    want = brute(data)
    # Pairs at once, and crowded variants whose members are compared one after another.
    for crowd, most in ((similar.CROWD, similar.PAIRS), (1, 0.01)):
        monkeypatch.setattr(similar, "CROWD", crowd)
        monkeypatch.setattr(similar, "PAIRS", most)
        got = {x.doc_id for x in pipeline.near_dedup(spark, table, "").collect()}
        assert want <= got and len(got - want) <= 2  # one pair in a hundred at 0.8 may be missed


def test_recall_at_the_threshold():
    """Pairs between 0.8 and 0.85 share a variant as often as planned."""
    r = random.Random(8)
    plan = similar.Plan(50_000, 0.8, 0.99)
    met = of = 0
    for i in range(400):
        text = prose(i, 300, 5000)
        a, b = text.encode(), changed(text, r.randrange(4, 8), r).encode()
        ha, hb = (similar.shingle_sets([t], 5)[0] for t in (a, b))
        if not 0.8 <= similar.similarity(ha, hb) < 0.85:
            continue
        x, y = (similar.fingerprints(h, np.array([len(h)]), plan.words)[0] for h in (ha, hb))
        full = (1 << plan.bits) - 1
        block = lambda f, k: int(f[k // plan.each]) >> (k % plan.each * plan.bits) & full
        met += any((block(x, k) ^ block(y, k)).bit_count() <= 2 and (int(x[k // plan.each + 1]) ^ int(y[k // plan.each + 1])).bit_count() <= plan.most for k in range(plan.blocks))
        of += 1
    assert of > 80 and met >= 0.97 * of


def test_texts_that_share_a_doc_id(spark):
    a, b = prose(1, 100, 5000), prose(2, 100, 5000)
    kept = lambda data: sorted((x.doc_id, x.text) for x in pipeline.near_dedup(spark, docs(spark, [(i, t, "en", "s", 1) for i, t in data]), "").collect())
    assert kept([(3, b), (5, a), (5, b)]) == [(3, b), (5, a)]
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(5, a), (5, b), (5, a)]) == sorted([(5, a), (5, b)])


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    """Near copies of one text, most of them not similar to each other: few pairs are made, and every group is found."""
    made = []

    def settle(df, name):
        out = similar_settle(df, name)
        made.extend([out.count()] * (name == "candidates"))
        return out

    similar_settle = similar.settle
    monkeypatch.setattr(similar, "settle", settle)
    r, text = random.Random(3), prose(77, 150, 5000)
    data = [(i, changed(text, r.randrange(1, 9), r)) for i in range(400)]
    got = {x.doc_id for x in pipeline.near_dedup(spark, docs(spark, [(i, t, "en", "s", 1) for i, t in data]), "").collect()}
    want = brute(data)
    assert len(want) > 50 and want <= got and len(got - want) <= 4
    assert sum(made) <= 15 * len(data)


def test_shared_rare_shingles():
    """Shingles of no other text are counted, those of a few are told, whatever batches they come in; others are left out."""
    rows = sorted([(h, i) for h in range(40) for i in range(h % 6 + 1)] + [(99, i) for i in range(50)])
    for size in (1, 3, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + size])], ["h", "id"]) for k in range(0, len(rows), size)]
        out = [x for b in similar._rare(4)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted((h, i) for i, h, _ in out if h is not None) == [(h, i) for h, i in rows if 0 < h % 6 < 4 and h < 40]
        assert sum(n for i, h, n in out if h is None) == sum(h % 6 == 0 for h in range(40)) and {i for i, h, _ in out if h is None} == {0}


def test_rows_that_may_match(spark):
    rows = spark.range(5000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), "id")
    some = rows.filter("id % 9 = 2")
    got = {x.id for x in similar._likely(rows, some, "key").collect()}
    assert {i for i in range(5000) if i % 9 == 2} <= got and len(got) < 1500
    assert similar._likely(rows, some.filter("id < 0"), "key").count() == 0
