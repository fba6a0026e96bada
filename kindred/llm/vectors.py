"""Embedding near-duplicates by sorted projection passes.

In each pass all vectors, less the table's mean, are ordered by the concatenated signs of random projections, and
each is compared to the ``window`` vectors that follow it. What is sorted are keys, ids and a sketch of 256 signs;
neighbours whose sketches are as near as a pair at the threshold may be are candidates, of which only those that
join something are kept, and a pair counts once its cosine is worked out from the vectors in double precision.
Passes come in rounds. How many a round has follows from the table's size and from how far apart a pair at the
threshold is once the mean is gone; after each round recall is measured, a sample of vectors against
all others, and rounds of fresh projections go on until it is reached.
Verified pairs of all rounds are united to components. A window would cut off the links of crowded places,
so within each component every pair is then counted, in tiles of bounded size: no link inside a component
is lost, and no list of pairs is made. Equal vectors are collapsed before and count as often as they are there.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from kindred.llm.components import components
from kindred.llm.store import discard, settle

#: Vectors in a tile of a component, and rows of it that are multiplied at a time.
TILE, STRIP = 2048, 256
#: Words of 64 signs in a sketch.
SKETCH = 4
#: Passes of one round, and rounds, at most.
ROUND, ROUNDS = 48, 40
#: Vectors whose links are counted in full to measure recall.
SAMPLE = 1024


def passes_for(n: int, angle: float, window: int, recall: float) -> int:
    """Passes after which a pair at ``angle`` has met with probability ``recall``, among ``n`` vectors."""
    bits = max(1.0, math.log2(max(2.0, n / window)))
    meet = (1 - angle / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision), one for each dimension that occurs."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)  # very large and very small vectors have norms too
        out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def _signs(x: np.ndarray, seed: list[int], words: int) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], 64 * words))
    return np.packbits(x @ planes > 0, axis=1, bitorder="big").view(">u8").astype(np.uint64).view(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec) -> (dim, n, sum of unit vectors) of the task."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for rows, x in _matrix(b.column(0)):
            n, s = total.get(x.shape[1], (0, 0.0))
            total[x.shape[1]] = (n + len(rows), s + x.sum(0))
    dims = list(total)
    lists = pa.array([total[d][1].tolist() for d in dims], pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([total[d][0] for d in dims], pa.int64()), lists], ["dim", "n", "s"])


def means(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Mean unit vector of each dimension: one row a dimension reaches the driver."""
    sums = distinct.select("vec").mapInArrow(_sums, "dim int, n long, s array<double>")
    at = sums.select("dim", "n", F.posexplode("s").alias("i", "x")).groupBy("dim", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    rows = at.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).collect()
    return {r.dim: np.array([p.x for p in r.s]) for r in rows}


def _keys(passes: range, seed: int, middle: dict[int, np.ndarray]):
    """(id, root, vec) -> one row for each of the passes: 64 signs as the sort key, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                n = b.num_rows
                parts = [(rows, x - middle[x.shape[1]]) for rows, x in _matrix(b.column(2))]
                sketch, dim = np.zeros((n, SKETCH), np.int64), np.zeros(n, np.int32)
                for rows, x in parts:
                    sketch[rows] = _signs(x, [seed, x.shape[1], passes.start + 1, SKETCH], SKETCH)
                    dim[rows] = x.shape[1]
                for turn in passes:
                    key = np.zeros(n, np.int64)
                    for rows, x in parts:
                        key[rows] = _signs(x, [seed, x.shape[1], turn + 1], 1)[:, 0]
                    columns = [pa.array(np.full(n, turn, np.int32)), pa.array(dim), pa.array(key), b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH)]]
                    yield pa.RecordBatch.from_arrays(columns, NAMES)

    return run


NAMES = ["turn", "dim", "key", "id", "root", *[f"s{k}" for k in range(SKETCH)]]
KEYED = "turn int, dim int, key long, id long, root long, " + ", ".join(f"s{k} long" for k in range(SKETCH))


class _Forest:
    """Which ids are joined so far, to pass on only the pairs that join something."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


def _pairs(rows: np.ndarray, window: int, most: int, sure: int, fresh: int, forest: _Forest) -> list[tuple[int, int]]:
    """Joining candidates among rows (group, id, root, sketch) at most ``window`` apart, one at ``fresh`` or after.

    Sketches that differ in at most ``most`` bits are candidates; only those that differ in at most ``sure``,
    as chance does not bring about, stand in for the candidates that they make needless.
    """
    out, (group, ids, root), sketch = [], rows[:3], rows[3:].view(np.uint64)
    for off in range(1, min(window, rows.shape[1] - 1) + 1):
        lo = max(0, fresh - off)
        same = np.flatnonzero((group[lo:-off] == group[lo + off :]) & (root[lo:-off] != root[lo + off :])) + lo
        if len(same):
            apart = np.bitwise_count(sketch[:, same] ^ sketch[:, same + off]).sum(0, dtype=np.int64)
            for i, d in zip(same[apart <= most].tolist(), apart[apart <= most].tolist()):
                a, b = forest.find(int(root[i])), forest.find(int(root[i + off]))
                if a != b:
                    out.append((int(ids[i]), int(ids[i + off])))
                    if d <= sure:
                        forest.join(a, b)
    return out


EDGES = "a long, b long, border int, place int, grp long, root long, " + ", ".join(f"s{k} long" for k in range(SKETCH))
_EDGES = [c.split()[0] for c in EDGES.split(", ")]


def _edge(rows: np.ndarray, border: int, place: np.ndarray) -> pa.RecordBatch:
    n = rows.shape[1]
    columns = [pa.array(rows[1]), pa.nulls(n, pa.int64()), pa.array(np.full(n, border, np.int32)), pa.array(place.astype(np.int32)), pa.array(rows[0]), pa.array(rows[2])]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(r)) for r in rows[3:]]], _EDGES)


def _windows(window: int, most: int, sure: int):
    """Sorted rows -> joining candidates, and the first and last rows of the partition, for its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail, seen, turn, forest = np.empty((3 + SKETCH, 0), np.int64), 0, None, _Forest()
        for b in batches:
            c = [x.to_numpy().astype(np.int64) for x in b.columns]
            if not len(c[0]):
                continue
            rows = np.stack([c[0] << 32 | c[1], *c[3:]])
            if c[0][-1] != turn:
                forest, turn = _Forest(), c[0][-1]
            if seen < window:
                head = rows[:, : window - seen]
                yield _edge(head, part - 1, window + seen + np.arange(head.shape[1]))
            block = np.concatenate([tail, rows], axis=1)
            found = _pairs(block, window, most, sure, tail.shape[1], forest)
            if found:
                ends = [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ends, *[pa.nulls(len(found), t) for t in (pa.int32(), pa.int32(), *[pa.int64()] * (2 + SKETCH))]], _EDGES)
            seen += rows.shape[1]
            tail = block[:, -window:]
        if seen:
            yield _edge(tail, part, np.arange(tail.shape[1]))

    return run


def _borders(window: int, most: int, sure: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        rows = np.stack([pdf[c].to_numpy().astype(np.int64) for c in ("grp", "a", "root", *[f"s{k}" for k in range(SKETCH)])])
        return pd.DataFrame(_pairs(rows, window, most, sure, int((pdf.place < window).sum()), _Forest()), columns=["a", "b"], dtype="int64")

    return run


def _cosines(threshold: float):
    """(a, b, vector of a, vector of b) -> the pairs at ``threshold`` or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.zeros(b.num_rows, bool)
            left, right = _matrix(b.column(2)), _matrix(b.column(3))
            for (rows, x), (_, y) in zip(left, right):
                near[rows] = np.einsum("ij,ij->i", x, y) >= threshold
            yield b.select([0, 1]).filter(pa.array(near))

    return run


def _shares(ids: np.ndarray, roots: np.ndarray, sample: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """(id, root, vec) -> (links of the sample, those inside one component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = inside = 0
        for b in batches:
            own, root = b.column(0).to_numpy(), b.column(1).to_numpy()
            for rows, x in _matrix(b.column(2)):
                if x.shape[1] not in sample:
                    continue
                at, y = sample[x.shape[1]]
                for lo in range(0, len(rows), STRIP):
                    r = rows[lo : lo + STRIP]
                    near = (x[lo : lo + STRIP] @ y.T >= threshold) & (own[r][:, None] != ids[at][None, :])
                    links += int(near.sum())
                    inside += int((near & (root[r][:, None] == roots[at][None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([inside])], ["links", "inside"])

    return run


def measure(rows: DataFrame, threshold: float) -> float:
    """Share of the links of SAMPLE vectors, found among all ``rows`` (id, root, vec), that are inside a component.

    The sample, one bounded block of vectors, is compared with every row.
    """
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    if not picked.num_rows:
        return 1.0
    (b,) = picked.to_batches()
    sample = {x.shape[1]: (at, x) for at, x in _matrix(b.column(2))}
    counted = rows.mapInArrow(_shares(b.column(0).to_numpy(), b.column(1).to_numpy(), sample, threshold), "links long, inside long")
    links, inside = counted.agg(F.sum("links"), F.sum("inside")).first()
    return inside / links if links else 1.0


def _tiles(threshold: float):
    """Rows of one tile together -> (id, links): links of the tile's left rows to its right ones."""

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        out = np.zeros(len(left), np.int64)
        for dim in left.dim.unique():
            r = right[right.dim == dim]
            if not len(r):
                continue
            at = np.flatnonzero(left.dim.to_numpy() == dim)
            y, m = _unit(r.vec).T, r.m.to_numpy().astype(np.int64)
            x = _unit(left.vec.iloc[at])
            for lo in range(0, len(at), STRIP):
                out[at[lo : lo + STRIP]] = (x[lo : lo + STRIP] @ y >= threshold) @ m
        return pd.DataFrame({"id": left.id.to_numpy(), "links": out})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf])
            new = (pdf[["root", "i", "j"]].to_numpy()[1:] != pdf[["root", "i", "j"]].to_numpy()[:-1]).any(1)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(pdf)]
            done = [close(pdf.iloc[lo:hi]) for lo, hi in zip(cuts[:-2], cuts[1:-1])]
            held = pdf.iloc[cuts[-2] :]
            if done:
                yield pd.concat(done)
        if held is not None:
            yield close(held)

    return run


def _unit(vec: pd.Series) -> np.ndarray:
    x = np.stack(vec.to_list()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(table: DataFrame, threshold: float = 0.9, window: int = 32, recall: float = 0.98, seed: int = 11, tile: int = TILE) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of ``table`` (vec_id, embedding).

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without vec_id, link
    with nothing; vectors of different dimensions don't link. Rows that repeat a vector link with each other, those that repeat
    a vec_id too; a cosine of exactly ``threshold`` links. Other columns are ignored. An empty table gives an empty result.
    """
    spark = table.sparkSession
    kind = table.schema["embedding"].dataType
    kind = kind if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else ArrayType(DoubleType())
    vec = F.col("embedding").cast(kind)
    sound = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, vec).alias("vec"))
    distinct = settle(rows.filter("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")).select("id", "m", "vec"), "distinct")
    n = distinct.count()
    middle = means(distinct) if n else {}
    # A pair at the threshold once the mean is gone: of the dimension where that is hardest.
    shared = max((float(v @ v) for v in middle.values()), default=0.0)
    angle = math.acos(max(0.2, (threshold - shared) / max(1e-9, 1 - shared)))
    share, bits = angle / math.pi, 64 * SKETCH
    most, sure = math.ceil(bits * share + 2.5 * math.sqrt(bits * share * (1 - share))), math.floor(bits * share)
    wanted = passes_for(n, angle, window, recall)

    def rooted(roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return distinct.select("id", F.col("id").alias("root"), "vec")
        return distinct.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "vec")

    links: list[DataFrame] = []
    roots, done = None, 0
    for _ in range(ROUNDS):
        turns = max(2, min(ROUND, wanted - done)) if done < wanted else min(ROUND, max(4, wanted // 2))
        # A border joins two partitions only: each has to hold the window, whatever the session deals out.
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * turns // (4 * window)))
        keyed = rooted(roots).mapInArrow(_keys(range(done, done + turns), seed, middle), KEYED)
        ordered = keyed.repartitionByRange(parts, "turn", "dim", "key", "id").sortWithinPartitions("turn", "dim", "key", "id")
        met = settle(ordered.mapInArrow(_windows(window, most, sure), EDGES), "met")
        across = met.filter("b is null and border >= 0").groupBy("border").applyInPandas(_borders(window, most, sure), "a long, b long")
        pairs = met.filter("b is not null").select("a", "b").unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ends = [distinct.select(F.col("id").alias(c), F.col("vec").alias(f"vec_{c}")) for c in ("a", "b")]
        fresh = settle(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "vec_a", "vec_b").mapInArrow(_cosines(threshold), "a long, b long"), "pairs")
        discard(met)
        done += turns
        if fresh.limit(1).count():
            links.append(fresh)
            every = links[0]
            for more in links[1:]:
                every = every.unionByName(more)
            roots = settle(components(every), "roots")
        if done >= wanted:
            measured = measure(rooted(roots), threshold)
            logging.getLogger(__name__).info("%d passes, measured recall %.4f", done, measured)
            if measured >= recall:
                break
    if roots is None:
        roots = settle(components(fresh), "roots")
    members = settle(distinct.join(roots, distinct.id == roots.node).select("id", "m", "vec", "root"), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    placed = members.join(sizes, "root").withColumn("c", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("dim", F.size("vec"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = placed.select("root", F.col("c").alias("i"), every.alias("j"), F.lit(0).alias("side"), "id", "m", "dim", "vec")
    right = placed.select("root", every.alias("i"), F.col("c").alias("j"), F.lit(1).alias("side"), "id", "m", "dim", "vec")
    tiles = left.unionByName(right).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    counted = tiles.mapInPandas(_tiles(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    facts = settle(distinct.join(counted, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.col("vec").alias("_v"), "id", F.coalesce("links", "m").alias("links"), F.coalesce("root", "id").alias("root")), "facts")
    discard(members)
    out = rows.join(facts, rows.vec == facts._v, "left")
    # A vector's links count its equals, itself among them.
    return out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"))
