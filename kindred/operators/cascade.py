"""From keyed records to decisions: sets, gate, and an ordered cascade of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.config import Config
from kindred.operators import gate
from kindred.operators.strategies import STRATEGIES


def path_matches(path: Column, pattern: str) -> Column:
    """Does the pattern occur in the path? Plain patterns run in the JVM, others as Python reads them."""
    plain = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-/. ^$*+?|()[]@,:%=~")
    if set(pattern) <= plain and "(?" not in pattern and "$" not in pattern[:-1]:
        return path.rlike(pattern)

    import re

    import pandas as pd

    search = re.compile(pattern).search

    @F.pandas_udf("boolean")
    def found(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: search(p) is not None)

    return found(path)


def decide(keyed: DataFrame, config: Config, bodies: DataFrame | None = None) -> DataFrame:
    """``keyed`` with set_size, evicted, strategy, decision, set_outcome and link_target.

    ``keyed`` needs source_path, mail_id, path, repr, mail_hash, timestamp, size, body_hash, rejection and
    encoding_error. ``bodies`` (repr, body_lines) is read for contested sets only; without it
    body_lines must be a column of ``keyed`` where the content gate is on. All facts of a set come from one
    exchange on mail_hash; a second one serves contested sets.
    """
    retained = keyed.filter("rejection is null")
    sized = gate.contested(retained, config.size_threshold, config.content_threshold)
    if config.size_threshold >= 0 or config.content_threshold >= 0:
        asked = sized.filter("contested")
        if config.content_threshold < 0:
            asked = asked.withColumn("body_lines", F.lit(None).cast("array<string>"))
        elif bodies is not None:
            asked = asked.drop("body_lines").join(bodies.select("repr", "body_lines"), "repr", "left")
        verdicts = gate.judge(asked, config.size_threshold, config.content_threshold)
        judged = sized.join(verdicts, gate.class_keys(config.content_threshold), "left").withColumn("evicted", F.coalesce("evicted", F.lit(False)))
    else:
        judged = sized.withColumn("evicted", F.lit(False)).withColumn("gate_skip", F.lit(None).cast("string"))
    out = choose(judged.drop("contested", "body_lines"), config)
    rejected = keyed.filter("rejection is not null").drop("body_lines")
    for name, kind in (("set_size", "bigint"), ("evicted", "boolean"), ("strategy", "string"), ("set_outcome", "string"), ("link_target", "struct<path:string,mail_id:string>")):
        rejected = rejected.withColumn(name, F.lit(None).cast(kind))
    return out.unionByName(rejected.withColumn("decision", F.lit("rejected")).select(*out.columns))


def choose(judged: DataFrame, config: Config) -> DataFrame:
    """The cascade, over records with ``evicted`` and ``gate_skip``."""
    w = Window.partitionBy("mail_hash")
    pool = ~F.col("evicted")
    of_pool = lambda c: F.when(pool, c)
    of_sizes = (lambda c: c) if config.stale_size_extremes else of_pool
    matches = path_matches(F.col("path"), config.regexp) if config.regexp is not None else F.lit(False)
    # One seeded draw a set, the same however the set is laid out.
    draw = F.struct(F.md5(F.concat_ws("|", F.lit(str(config.seed)), "mail_hash", "repr")).alias("draw"), F.col("repr").alias("repr"))
    rows = judged.withColumn("matches", matches)
    facts = {
        "set_size": F.count("*").over(w),
        "p_n": F.count(of_pool(F.lit(1))).over(w),
        "p_dated": F.count(of_pool(F.col("timestamp"))).over(w),
        "p_ts_min": F.min(of_pool(F.col("timestamp"))).over(w),
        "p_ts_max": F.max(of_pool(F.col("timestamp"))).over(w),
        "p_size_min": F.min(of_sizes(F.col("size"))).over(w),
        "p_size_max": F.max(of_sizes(F.col("size"))).over(w),
        "p_match": F.count(of_pool(F.when(F.col("matches"), 1))).over(w),
        "p_pick": F.min(of_pool(draw)).over(w),
        "g_encoding": F.max("encoding_error").over(w),
        "g_skip": F.max("gate_skip").over(w),
    }
    rows = rows.select("*", *[c.alias(n) for n, c in facts.items()])
    dated = F.col("p_dated") == F.col("p_n")
    chosen, kept = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name in reversed(config.strategies):
        s = STRATEGIES[name]
        decides = s.decides()
        if config.stale_size_extremes and s.name.split("-")[1].startswith(("small", "big")):
            n_kept = F.count(of_pool(F.when(s.keep(), 1))).over(w)
            decides = (n_kept > 0) & (n_kept < F.col("p_n"))
        ok = F.coalesce((dated & decides) if s.timed else decides, F.lit(False))
        chosen = F.when(ok, F.lit(name)).otherwise(chosen)
        kept = F.when(ok, s.keep()).otherwise(kept)
    failed = F.lit("skipped_strategy")
    if config.strategies and STRATEGIES[config.strategies[-1]].timed:
        failed = F.when(dated, "skipped_strategy").otherwise("skipped_timestamp")
    outcome = F.when(F.col("set_size") == 1, "single").when(F.col("g_encoding"), "skipped_encoding").when(F.col("g_skip").isNotNull(), F.col("g_skip"))
    outcome = outcome.when(F.col("_chosen").isNotNull(), "deduplicated").otherwise(failed)
    rows = rows.withColumn("_chosen", chosen).withColumn("_kept", kept).withColumn("set_outcome", outcome)
    done = F.col("set_outcome") == "deduplicated"
    decision = F.when(F.col("set_outcome") == "single", "unique").when(~done & F.col("evicted"), "skipped").when(F.col("evicted"), "set_aside").when(~done, "skipped").when(F.col("_kept"), "selected").otherwise("discarded")
    rows = rows.withColumn("decision", decision).withColumn("strategy", F.when(done, F.col("_chosen")))
    target = F.min(F.when(F.col("decision") == "selected", F.struct("path", "mail_id"))).over(w)
    rows = rows.withColumn("link_target", F.when(F.col("decision") == "discarded", target))
    return rows.drop(*facts.keys() - {"set_size"}, "matches", "_chosen", "_kept", "gate_skip")


def sets(decided: DataFrame) -> DataFrame:
    """One row a set: size, extremes, different bodies, outcome."""
    return (
        decided.filter("rejection is null")
        .groupBy("mail_hash")
        .agg(
            F.count("*").alias("n"),
            F.when(F.count("*") == F.count("timestamp"), F.min("timestamp")).alias("oldest"),
            F.when(F.count("*") == F.count("timestamp"), F.max("timestamp")).alias("newest"),
            F.min("size").alias("smallest"),
            F.max("size").alias("biggest"),
            F.count_distinct("body_hash").alias("bodies"),
            F.first("set_outcome").alias("set_outcome"),
        )
    )
