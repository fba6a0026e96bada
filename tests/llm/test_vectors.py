import numpy as np

from kindred.llm import vectors


def table(spark, data, extra=""):
    return spark.createDataFrame(data, f"vec_id long, embedding array<float>{extra}").repartition(3)


def brute(data, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in good]
    n, up = {}, {i: i for i, _ in data}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for j, (i, v) in enumerate(unit):
        links = [k for m, (k, w) in enumerate(unit) if m != j and len(v) == len(w) and v @ w >= threshold]
        n[i] = len(links)
        for k in links:
            a, b = sorted((find(i), find(k)))
            up[b] = a
    return {i: (n.get(i, 0), find(i)) for i, _ in data}


def test_same_as_brute_force(spark):
    r = np.random.default_rng(3)
    data = [(i, r.standard_normal(16).round(3).tolist()) for i in range(300)]
    center = r.standard_normal(16)
    data += [(1000 + i, (center + 0.05 * r.standard_normal(16)).round(3).tolist()) for i in range(150)]
    chain = [np.array([np.cos(t), np.sin(t)] + [0.0] * 14) for t in np.arange(8) * 0.4]
    data += [(2000 + i, c.round(4).tolist()) for i, c in enumerate(chain)]
    data += [(3000, data[0][1]), (3001, [2 * x for x in data[0][1]]), (3002, None), (3003, []), (3004, [0.0] * 16), (3005, [float("nan")] * 16), (3006, [1.0, None]), (3007, [1.0, 2.0]), (3008, [2.0, 4.0]), (3009, [float("inf")] * 16)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.near_duplicates(table(spark, data), window=8, recall=0.999, tile=32).collect()}
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data])


def test_repeated_rows_null_ids_extra_columns_and_empty(spark):
    data = [(1, [1.0, 0.0], "c", 1), (1, [1.0, 0.0], "c", 2), (None, [1.0, 0.0], "c", 3), (2, [0.0, 1.0], None, 4)]
    got = vectors.near_duplicates(table(spark, data, ", root string, id int")).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in got) == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert vectors.near_duplicates(table(spark, [])).count() == 0
