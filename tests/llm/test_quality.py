import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.llm import quality

from .helpers import docs, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), failed


def test_base_columns(spark):
    data = rows() + [(300, "a b c a b c\n\na b\n a b\na b\n#*$ %&|<> x", "en", "s", 1), (301, "the of and to " * 40, "en", "s", 1)]
    got = quality.judge(docs(spark, data)).select("text", "quality.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.base_failed and r.kept)


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    row = spark.range(1).select(quality.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"), quality.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, p))).alias("z"), quality.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("o")).first()
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert row.d == pytest.approx(math.sqrt(part(p) / 2 + part(q) / 2))
    assert row.z == 0 and row.o == pytest.approx(1)


def test_junk_is_rejected_and_prose_kept(spark):
    import random

    r = random.Random(1)
    words = quality.COMMON["en"] + ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(4, 9))) for _ in range(400)]
    clean = [(i, " ".join(r.choice(words[:16]) if r.random() < 0.4 else r.choice(words) for _ in range(200)).capitalize() + ".", "en", "s", 1) for i in range(40)]
    junk = [(100 + i, " ".join("".join(r.choice("#*$%&|0123456789QXZ") for _ in range(6)) for _ in range(200)), "en", "s", 1) for i in range(4)]
    got = {x.doc_id: x.kept for x in quality.judge(docs(spark, clean + junk)).select("doc_id", "quality.kept").collect()}
    assert all(got[i] for i in range(40)) and not any(got[100 + i] for i in range(4))


def test_extra_columns_and_empty(spark):
    out = quality.judge(docs(spark, extra=True))
    assert out.count() == len(rows()) and dict(out.dtypes)["quality"].startswith("struct") and "q_lang" in out.columns
    assert quality.judge(empty(spark)).count() == 0
