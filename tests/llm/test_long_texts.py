"""Texts beyond one part of op 1."""

import pyarrow as pa

from kindred.llm import rolling, substrings

from .helpers import docs, prose
from .test_substrings import brute, result


def test_small_parts_change_nothing(spark, monkeypatch):
    passage = prose(1, 40, 5000)
    texts = [prose(4, 30, 5000), f"{prose(2, 100, 5000)} {passage} {prose(3, 300, 5000)} {passage} {'y' * 700} {prose(5, 30, 5000)}", f"{passage} {prose(9, 200, 5000)}"]
    data = list(enumerate(texts))
    whole = result(substrings.dedup(docs(spark, [(i, t, None, None, None) for i, t in data])))
    assert whole == brute(data, 13)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([7, 8, 9]), pa.array([t.encode() for t in texts])], ["doc", "sub", "text"])
    zones = lambda: sorted(tuple(r.values()) for b in substrings._zones(13, 5)(iter([batch])) for r in b.to_pylist())
    # Every zone's digest and place, however small the parts; zones are cut where parts meet.
    at_once = {z[3:5] + (p,) for z in zones() for p in range(z[5] >> 7, (z[5] >> 7) + (z[5] & substrings.WINDOWS))}
    for name, module in (("MOST_WORDS", substrings), ("CHUNK", substrings), ("PART", rolling)):
        monkeypatch.setattr(module, name, 200)
    parts = zones()
    assert {z[3:5] + (p,) for z in parts for p in range(z[5] >> 7, (z[5] >> 7) + (z[5] & substrings.WINDOWS))} == at_once
    ranges = pa.array([[(10 << 7) | 3, (400 << 7) | 1]], pa.list_(pa.int64()))
    row = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([texts[1].encode()]), ranges], ["doc_id", "text", "ranges"])
    (out,) = [r for b in substrings._remove(13)(iter([row])) for r in b.to_pylist()]
    words = texts[1].split()
    assert out["kept"].decode() == " ".join(words[:10] + words[25:400] + words[413:]) and out["n_words"] == len(words)
