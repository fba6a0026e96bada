"""Connected components of a link table, without gathering an unbounded number of links anywhere.

Every task first reduces the links that it reads to a spanning forest ("filtering", Lattanzi et al., SPAA 2011),
without a shuffle. Where no more than ``one_task`` links are left, one task ends the work in the same way: a step
of the star algorithm costs several jobs, which small tables would mostly wait for. Where more are left,
alternating large-star and small-star steps follow (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014), each an aggregate and a join, so a hub with very many links is pre-aggregated before its exchange
and its join can be split by Spark. Both ways give the same components, down to the roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.store import discard, settle

#: Links that one task ends, or holds at once: some 100 MB in its Python worker.
ONE_TASK = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) of all nodes but the least ones."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        # Roots are hung below lesser ones, then every node right below its root.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _forests(most: int):
    """Links (u, v) -> links of the same components, a forest for every ``most`` links held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, np.int64)
        fresh = 0
        for b in batches:
            u, v = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate((u, v)))
            fresh += b.num_rows
            if fresh > most:
                (u, v), fresh = forest(u, v), 0
                if len(u) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u = v = np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    return run


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    mark = None
    for _ in range(max_rounds):
        step = settle(_small_star(_large_star(edges)), "links")
        discard(edges)
        edges = step
        # Each step only lowers targets, so equal sums over equally many links mean a fixed point.
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges
        mark = now
    raise RuntimeError("components did not settle")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Rows (node, root) for every node that a link touches; root is the least node it can reach.

    Ends are whole numbers and come back as longs. Null ends are ignored; self links and repeated links change
    nothing. No links give no rows.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null and u != v")
    edges = settle(edges.mapInArrow(_forests(one_task), "u long, v long"), "links")
    if edges.count() <= one_task:
        ended = settle(edges.coalesce(1).mapInArrow(_forests(one_task), "u long, v long"), "links")
        discard(edges)
    else:
        ended = _stars(edges, max_rounds)
    return ended.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ended.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
