import random

import pytest
from pyspark.sql import functions as F

from kindred.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    return host.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), path


def rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


CASES = [None, "", "no scheme", "http://", "http://WWW.Example.COM/en/7?x#y", "https://a.example.com/en/8", "x://net/de/", "http://notnet/de/1", "http://a.net/de/8", "http://b.example.net/de/81", "http://example.net/de/9", "http://q.org/es/", "http://É.org/es/1", "a://b://c/d", "http://h?en/7", "http://h#/x", "http://com/en/\n7"]


def test_hosts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)], "page_id long, url string")
    host, path = urls.host_path(F.col("url"))
    for r in df.select("url", host.alias("h"), path.alias("p")).withColumn("r", urls.rule(F.col("h"), F.col("p"))).collect():
        assert (r.h, r.p) == split(r.url)
        assert (None if r.r is None else tuple(r.r)) == rule(r.h, r.p)


def make(n, seed, good):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou" if k % 2 else "klmnprst") for k in range(r.randint(4, 8)))
    if good:
        return [f"https://www.{word()}.net/de/{word()}/{r.randint(1, 99)}" for _ in range(n)]
    return [f"http://{''.join(r.choice('xzqj0123456789-') for _ in range(12))}.com/en/{r.randint(1, 10**6)}?ref={r.randint(1, 99)}" for _ in range(n)]


def test_held_out_accuracy(spark):
    train = [(i, u) for i, u in enumerate(make(300, 1, True) + make(300, 2, False))]
    # The same kinds of urls where no rule reaches them.
    held = [(1000 + i, u.replace("/de/", "/fr/")) for i, u in enumerate(make(100, 3, True))] + [(2000 + i, u.replace("/en/", "/fr/")) for i, u in enumerate(make(100, 4, False))]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(train + held, "page_id long, url string").repartition(3)).collect()}
    assert all(got[i].verdict == "allow" and got[i].rule == "net/de/" for i in range(300))
    right = sum(got[1000 + i].verdict == "allow" for i in range(100)) + sum(got[2000 + i].verdict == "block" for i in range(100))
    assert right >= 190 and got[1000].rule is None


def test_probabilities_add_up():
    import numpy as np

    counts = np.zeros((urls.ORDERS + 1) * urls.SLOTS * urls.SYMBOLS, np.int64)
    flat, owner = urls._codes(["abcab", "abd"])
    for k, slot in enumerate(urls._slots(flat)):
        np.add.at(counts, (k * urls.SLOTS + slot[owner >= 0]) * urls.SYMBOLS + flat[owner >= 0], 1)
    m = urls.Models([counts, counts])
    slots = [np.full(urls.SYMBOLS, s[6]) for s in urls._slots(flat)]
    assert np.exp(m._log(m.logs[0], slots, np.arange(urls.SYMBOLS))).sum() == pytest.approx(1)


def test_awkward_tables(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES + CASES)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("_rule", F.lit(1))
    out = urls.judge(df)
    assert out.count() == 2 * len(CASES) and "_rule" in out.columns
    assert {r.verdict for r in out.collect()} <= {"allow", "block"}
    one = urls.judge(spark.createDataFrame([(1, None), (2, "http://a.b/c")], "page_id long, url string"))
    assert [r.verdict for r in one.collect()] == ["allow", "allow"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
