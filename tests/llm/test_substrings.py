import re

import pytest

from kindred.llm import substrings

from .helpers import docs, empty, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(data, length):
    table = [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t in data]
    first = {}
    for i, w in table:
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in table:
        cover = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                cover |= set(range(p, p + length))
        out.append((i, len(w), len(cover), " ".join(x for k, x in enumerate(w) if k not in cover)))
    return sorted(out)


def result(df):
    return sorted((float("inf") if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 4])
def test_same_as_brute_force(spark, batches):
    data = [(r[0], r[1]) for r in rows()]
    shared = prose(9, 40)
    data += [(100 + i, f"{prose(50 + i, 20, 30)} {shared} {prose(70 + i, 20, 30)} {shared}") for i in range(12)]
    # A passage that is partly known, twice in one document.
    data += [(200, f"{shared[:120]} q {shared[40:]} r {shared[:120]} q {shared[40:]}"), (3, prose(2, 200))]
    df = docs(spark, [(i, t, None, None, None) for i, t in data])
    assert result(substrings.dedup(df, batches=batches)) == brute(data, 13)


def test_small_windows(spark):
    data = [(i, prose(i, 60, 3)) for i in range(20)]
    df = docs(spark, [(i, t, None, None, None) for i, t in data])
    assert result(substrings.dedup(df, length=6, piece=2)) == brute(data, 6)


def test_extra_columns_and_empty(spark):
    assert substrings.dedup(docs(spark, extra=True)).count() == len(rows())
    assert substrings.dedup(empty(spark)).count() == 0


def outcome(spark, data, **options):
    return result(substrings.dedup(docs(spark, [(i, t, None, None, None) for i, t in data]), **options))


def test_words_whose_letters_cancel_in_powers_of_a_base(spark):
    """The parity sequence and its complement differ by a product that vanishes modulo 2**64."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = prose(3, 12)
    for n in (48, 2048):
        data = [(1, f"{a[:n]} {tail}"), (2, f"{b[:n]} {tail}")]
        assert outcome(spark, data) == brute(data, 13)


def test_rows_that_share_a_document(spark):
    s, q, other = prose(1, 20, 9000), prose(2, 5, 9000), prose(3, 25, 9000)
    # Rows without doc_id, rows of one doc_id with other texts, and a passage that a document holds in two rows.
    for i in (None, 5):
        data = [(1, s), (i, f"{s} {q}"), (i, other), (i, f"{other} {s}"), (i, f"{s} {q}")]
        assert outcome(spark, data) == brute(data, 13)
    part = prose(4, 16, 9000)
    data = [(1, f"{prose(5, 9)} {part[:-6]}"), (2, f"{part} {q} {part}"), (2, f"{other} {part}"), (3, f"{part} {other}"), (None, part), (None, part)]
    assert outcome(spark, data, piece=3) == brute(data, 13)


def test_runs_are_merged(spark):
    index = substrings.RunIndex(spark, 4)
    columns = "a long, z long, y long, doc long, sub long, at long, m long, again boolean"
    for lo in (0, 10, 20):
        # Each batch is added by an index that is opened anew.
        index = substrings.RunIndex(spark, 4, index.manifest)
        index.append(spark.createDataFrame([(k, k, 0, lo, 0, 1, 1, False) for k in range(lo, lo + 15)], columns))
    table = spark.table(index.compact())
    assert {(r.a, r.doc) for r in table.collect()} == {(k, 0 if k < 15 else 10 if k < 25 else 20) for k in range(35)}
    assert len(index.runs) == 1
    index.drop()
