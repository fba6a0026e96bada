"""Each stage against a plain restatement of what it decides, on what the stage before it kept."""

from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kindred.llm import bpe, mixing, quality, secrets
from kindred.llm.store import settle
from kindred.settle import shared_dir

from .helpers import COLUMNS, docs, empty, prose
from .test_quality import base
from .test_similar import jaccard, sets

NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def corpus():
    data = [(i, prose(i, 80 + i), "en", f"s{i % 3}", 1) for i in range(40)]
    data += [(100 + i, prose(0, 80) + (f" t{i}" if i % 2 else ""), "en", "s0", 1) for i in range(8)]
    data += [(200, prose(7, 60) + " token = abcdef0123456789", "en", "s1", 1), (201, "short", "en", "s1", 1), (202, None, None, None, None)]
    # No doc_id, with a text of its own and with one that others have; one doc_id with two texts; a row that is there three times; a long text.
    data += [(None, prose(300, 90), "en", None, 1), (None, prose(3, 83), "en", "s0", 1), (None, prose(301, 90), "en", None, 1)]
    data += [(210, prose(302, 70), "en", "s1", 1), (210, prose(303, 70), "en", "s1", 1)] + [(211, prose(304, 75), "en", "s2", 1)] * 3
    data += [(212, prose(305, 40_000, 5000), "en", "s2", 1)]
    return data


def survivors(before):
    """One row of each component of texts: least doc_id, null last."""
    s = [sets(r.text) for r in before]
    up = list(range(len(before)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if jaccard(s[i], s[j]) >= 0.8:
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(before):
        least.setdefault(find(i), set()).add((r.doc_id is None, r.doc_id))
    return Counter(min(ids) for ids in least.values())


def test_stages(spark):
    clash = ["_row", "quality", "base", "added", "_n", "_key", "times", "root", "words", "id"]
    at = docs(spark, corpus()).select("*", *[F.lit("clash").alias(c) for c in clash])
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scan", "mix_sources", "byte_bpe"]
    seen = {}
    for name, stage in pipeline.STAGES:
        before = at.collect()
        at = settle(stage(spark, at, ""), name)
        seen[name] = (before, at.collect())
        if name != "byte_bpe":
            assert at.columns == [*NAMES, *clash] and all(r[c] == "clash" for r in seen[name][1] for c in clash)
    before, after = seen["quality_rules"]
    assert not any(base(r.text)[5] for r in after) and {201, 202} & {r.doc_id for r in before} and not {201, 202} & {r.doc_id for r in after}
    before, after = seen["simhash_near_dedup"]
    assert Counter((r.doc_id is None, r.doc_id) for r in after) == survivors(before)
    assert Counter(r.doc_id for r in after)[210] == 2 and Counter(r.doc_id for r in after)[None] == 2
    before, after = seen["secret_scan"]
    assert len(before) == len(after) and [r.text for r in after if r.doc_id == 200][0].endswith("[SECRET]")
    assert all(a.n_chars == len(a.text) or a.n_chars == 1 for a in after)
    before, after = seen["mix_sources"]
    taken = Counter()
    for r in mixing.mix(spark.createDataFrame([(r.doc_id, r.source, len(r.text.split())) for r in before], "doc_id long, source string, size long")).collect():
        taken[r.doc_id, r.source, r.size] += r.taken // r.size
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in after) == +taken
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    before, after = seen["byte_bpe"]
    library = tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})
    assert Counter((r.doc_id, r.source, tuple(library.encode_ordinary(r.text))) for r in before) == Counter((r.doc_id, r.source, tuple(r.ids)) for r in after)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_rows_that_are_alike_share_what_is_taken(spark):
    data = [(1, prose(1, 60), "en", "s", 1)] * 3 + [(1, prose(2, 60), "en", "s", 1), (2, prose(3, 60), "en", None, 1)]
    out = pipeline.mix_sources(spark, docs(spark, data), "").collect()
    assert all(n <= 2 * data.count(tuple(r)) for r, n in Counter(out).items())
    sizes = [(r[0], r[3], len(r[1].split())) for r in data]
    want = sum(r.taken // r.size for r in mixing.mix(spark.createDataFrame(sizes, "doc_id long, source string, size long")).collect())
    assert len(out) == want


def test_quality_rules_leave_no_copy_of_the_texts(spark):
    folder = Path(urlparse(shared_dir(spark)).path)
    before = set(folder.iterdir())
    rows = docs(spark, corpus())
    kept = pipeline.quality_rules(spark, rows, "").collect()
    assert kept and set(folder.iterdir()) == before
    assert Counter(map(tuple, kept)) == Counter(tuple(x)[:5] for x in quality.judge(rows).filter("quality.kept").collect())


def test_empty(spark):
    at = empty(spark)
    for _, stage in pipeline.STAGES:
        at = settle(stage(spark, at, ""), "stage")
        assert at.count() == 0


def test_registered(spark, tmp_path):
    """run() is the stages one after the other."""
    docs(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "source", "n_tokens", "round_trip", "ids"] and got.filter("not round_trip").count() == 0 and got.count() > 40
    assert secrets.KINDS[0] == "assign"
