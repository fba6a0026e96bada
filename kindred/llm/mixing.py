"""Mixing sources to target weights by weighted fair queueing.

Each source is an endless queue of its shuffled documents, pass after pass. A document's virtual
finish time is the number of its source's words up to and including it, divided by the source's
target. All queues are merged by a range sort on finish time and cut off at the total budget.
Running sums over a source of any size are taken in two levels: within buckets of bounded size,
and over the sums of the buckets, so no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.store import settle
from kindred.llm.words import words

#: Rows that a bucket of a running sum has on average.
BUCKET = 4096


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2) -> DataFrame:
    """One row (source, source_size, n, weight, target) a source.

    Sources in order of code point, null last, weigh ``weights``, repeating. The budget is ``share``
    of all words; no target is above ``passes`` times its source's size, and what that leaves over
    is shared again by weight. The level where all targets add up to the budget is found by one
    running sum over the sources in order of (cap / weight).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    cap = passes * F.col("source_size").cast("double")
    per = per.withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
    every = Window.partitionBy()
    below = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("budget", share * F.sum("source_size").over(every)).withColumn("all", F.sum("weight").over(every))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.col("all") - F.coalesce(F.sum("weight").over(below), F.lit(0)))
    per = per.withColumn("level", level)
    # The first source, in that order, that its cap doesn't hold back sets the level for all.
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return per.select("source", "source_size", "n", "weight", F.least("cap", F.coalesce(free * F.col("weight"), F.col("cap"))).alias("target"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str, most: float | None = None) -> DataFrame:
    """``value`` summed up to each row within ``group``: buckets first, then rows within a bucket.

    Rows of buckets that begin beyond ``most`` are left out before any row is sorted.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    if most is not None:
        sums = sums.filter(F.col("_before") <= most)
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = [df[g].eqNullSafe(sums[g]) for g in group] + [df[bucket] == sums[bucket]]
    on = keys[0]
    for k in keys[1:]:
        on &= k
    joined = df.join(sums, on).select(df["*"], sums["_before"])
    return joined.withColumn(name, F.sum(value).over(within) + F.col("_before")).drop("_before")


def mix(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: int = 17) -> DataFrame:
    """``sizes`` (doc_id, source, size) with source_size, target and taken more.

    ``taken`` is the number of the document's words in the mix, repeats counted: a multiple of its
    size, at most ``passes``. Equal input gives equal output, whatever its partitioning: the shuffle
    is an MD5 of seed, pass, doc_id and size, with ties broken by doc_id and size, and equal finish times of
    two sources go in order of the sources. A null source is a
    source; null sizes count as 0; documents without words finish at once and take nothing. Rows
    that repeat a doc_id are documents of their own. An empty table gives an empty result.
    """
    sizes = sizes.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    goal = settle(targets(sizes, weights, share, passes), "targets")
    total = goal.agg(F.sum("source_size").alias("all"), F.sum("n").alias("n")).first()
    budget = share * (total["all"] or 0)
    tagged = sizes.join(goal.select(F.col("source").alias("_s"), "source_size", "n", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    turn = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("turn")
    queue = tagged.select("doc_id", "source", "size", "n", "target", turn).filter("size > 0")
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("turn").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    queue = queue.withColumn("draw", F.conv(F.substring(drawn, 1, 10), 16, 10).cast("long"))
    slots = F.ceil(F.col("n") / BUCKET)
    queue = queue.withColumn("slot", F.col("turn") * slots + F.floor(F.col("draw") * slots / F.lit(1 << 40)))
    queue = _running(queue, ["source"], "slot", ["turn", "draw", "doc_id", "size"], "size", "done")
    queue = settle(queue.select("doc_id", "source", "size", (F.col("done") / F.col("target")).alias("finish"), "turn", "draw"), "queue")
    # The budget ends near time 1; later times, which have no bound, share bins that grow with them.
    bins = max(1, (total["n"] or 0) * passes // BUCKET)
    queue = queue.withColumn("bin", F.floor(F.col("finish") / (F.col("finish") + 1) * 4 * bins).cast("long"))
    merged = _running(queue.withColumn("_all", F.lit(0)), ["_all"], "bin", ["finish", "source", "turn", "draw", "doc_id", "size"], "size", "total", most=budget)
    taken = merged.filter(F.col("total") <= budget).groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    # Rows that are alike in all three columns share what was taken of them: passes for each at most.
    alike = tagged.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.count("*").alias("alike"))
    same = (alike["doc_id"].eqNullSafe(taken["doc_id"])) & (alike["source"].eqNullSafe(taken["source"])) & (alike["size"] == taken["size"])
    out = alike.join(taken, same, "left").select(alike["*"], F.coalesce("times", F.lit(0)).alias("times"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int"))))
    times = F.floor(F.col("times") / F.col("alike")) + F.when(F.col("copy") <= F.col("times") % F.col("alike"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), (times * F.col("size")).cast("long").alias("taken"))
