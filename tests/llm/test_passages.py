import random
from collections import Counter

import numpy as np
import pytest

from kindred.llm import passages
from kindred.llm.suffixes import suffix_array

from .helpers import docs, empty, prose, rows


def test_suffix_array():
    r = random.Random(1)
    for _ in range(3000):
        s = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def covered(data, length):
    count = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        m = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        out.append(np.cumsum(m)[:-1] > 0)
    return out


def test_repeated_windows():
    r = random.Random(2)
    for _ in range(200):
        length = r.choice([8, 11, 20, 40])
        base = [bytes(r.choice(b"abc \n") for _ in range(r.randint(0, 150))) for _ in range(4)]
        texts = [b"".join(b[r.randint(0, 30) : r.randint(30, 150)] for b in r.sample(base, 2)) for _ in range(r.randint(1, 8))]
        copies = np.array([r.choice([1, 1, 2]) for _ in texts])
        count = Counter()
        for x, m in zip(texts, copies):
            for i in range(len(x) - length + 1):
                count[x[i : i + length]] += m
        want = [[count[x[i : i + length]] >= 2 for i in range(len(x) - length + 1)] for x in texts]
        assert [h.tolist() for h in passages.repeated_windows(texts, copies, length)] == want


@pytest.mark.parametrize("crowd", [2000, 2])
def test_same_as_brute_force(spark, crowd):
    shared = prose(9, 120)
    data = rows() + [(100 + i, f"{prose(50 + i, 25)} {shared} {prose(80 + i, 25)}", None, None, None) for i in range(8)]
    got = passages.dedup(docs(spark, data), crowd=crowd).collect()
    texts = [(r[0], (r[1] or "").encode()) for r in data]
    want = Counter()
    for (i, x), m in zip(texts, covered([x for _, x in texts], 200)):
        want[(i, len(x), int(m.sum()), len(passages.runs(m)), np.frombuffer(x, np.uint8)[~m].tobytes())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    parts = list(passages.chunks(iter([]), 199))
    assert parts == []
    big = " ".join(f"u{i}" for i in range(260_000))
    data = [(1, big, None, None, None), (2, "head " + big[1_000_000:1_000_900] + " tail", None, None, None)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in passages.dedup(docs(spark, data)).collect()}
    assert got == {1: (900, 1), 2: (900, 1)} or all(v[0] in (900, 901, 902) and v[1] == 1 for v in got.values())


def test_extra_columns_and_empty(spark):
    assert passages.dedup(docs(spark, extra=True)).count() == len(rows())
    assert passages.dedup(empty(spark)).count() == 0
