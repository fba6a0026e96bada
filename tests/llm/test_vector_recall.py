"""Recall of the embedding passes where rows are few or crowded."""

import numpy as np
import pytest

from kindred.llm import vectors


def pairs(r, base):
    """Each vector of ``base`` and a near copy of it: cosine about 0.93."""
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    noise = r.standard_normal(unit.shape)
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return np.concatenate([unit, 0.93 * unit + np.sqrt(1 - 0.93**2) * noise])


def lost(spark, x, **options):
    """(links that brute force has and the passes don't, links of brute force)"""
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    x = np.array([np.float32(v).astype(float) for v in x])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table, **options).collect()}
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    return int(want.sum()) - sum(got.values()), int(want.sum())


def test_more_partitions_than_rows(spark):
    r = np.random.default_rng(1)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        # Every row is within the window of every other, so no link may be lost.
        assert lost(spark, pairs(r, r.standard_normal((15, 64)))) == (0, 30)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize("mean", [0.0, 0.6, 0.8])
def test_vectors_that_share_a_direction(spark, mean):
    """6,000 vectors of one mean cosine, at the defaults: planted pairs at 0.905 are found."""
    r = np.random.default_rng(4)
    way = np.ones(64) / 8
    base = np.sqrt(mean) * way + np.sqrt(1 - mean) * r.standard_normal((5_000, 64)) / 8
    unit = base[:1000] / np.linalg.norm(base[:1000], axis=1, keepdims=True)
    noise = np.sqrt(mean) * way + np.sqrt(1 - mean) * r.standard_normal((1000, 64)) / 8
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    gone, of = lost(spark, np.concatenate([base, 0.905 * unit + np.sqrt(1 - 0.905**2) * noise]))
    assert of >= 2000 and gone <= 0.05 * of


def test_topics(spark):
    r = np.random.default_rng(2)
    topics = r.standard_normal((3, 64))
    topics /= np.linalg.norm(topics, axis=1, keepdims=True)
    base = topics[r.integers(0, 3, 1500)] + 0.5 * r.standard_normal((1500, 64)) / 8
    gone, of = lost(spark, pairs(r, base), window=8)
    assert of >= 3000 and gone <= 0.02 * of
