import numpy as np
import pytest
import xxhash

from kindred.llm import simhash
from kindred.llm.components import components

from .helpers import docs, empty, prose, rows


def plain_fingerprint(text, width=4):
    words = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for _, t, *_ in rows():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def roots(values, radius=4):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in values:
        for b in values:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius:
                up[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("crowd", [1024, 3])
def test_links_join_what_is_near(spark, crowd):
    r = np.random.default_rng(1)
    values = {int(x) for x in r.integers(-(2**62), 2**62, 60)}
    for center in list(values)[:6]:
        for _ in range(25):
            v = center & (1 << 64) - 1
            for b in r.choice(64, r.integers(1, 7), replace=False):
                v ^= 1 << int(b)
            values.add(v - (1 << 64) if v >= 1 << 63 else v)
    values |= {0, -1, 1, 3, 7, 15, 31, 1 << 62, -(1 << 63)}
    want = roots(sorted(values))
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), crowd=crowd)
    got = {x.node: x.root for x in components(links).collect()}
    for a in values:
        for b in values:
            assert (got.get(a, a) == got.get(b, b)) == (want[a] == want[b])


def test_documents(spark):
    data = rows() + [(400 + i, prose(1, 120) + f" tail{i}", None, None, None) for i in range(30)]
    got = simhash.near_duplicates(docs(spark, data)).collect()
    assert len(got) == len(data)
    fps = {i: simhash.fingerprint(t) for i, t, *_ in data}
    want = roots(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[want[f]] = min(i, least.get(want[f], i))
    for x in got:
        assert x.fp % (1 << 64) == fps[x.doc_id] and x.component_id == least[want[fps[x.doc_id]]]


@pytest.mark.parametrize("one_task", [1_000_000, 3])
def test_components_of_a_chain_and_a_star(spark, one_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


@pytest.mark.parametrize("one_task", [1_000_000, 50])
def test_components_of_random_links(spark, one_task):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(-200, 200, (330, 2))]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), one_task=one_task).collect()
    assert {x.node: x.root for x in got} == {x: find(x) for x in up} and len(got) == len(up)


def test_extra_columns_and_empty(spark):
    assert simhash.near_duplicates(docs(spark, extra=True)).count() == len(rows())
    assert simhash.near_duplicates(empty(spark)).count() == 0
