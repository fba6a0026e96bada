"""URL filters: rules first, then the ratio of two character language models.

Urls that a rule decides are the training rows of two smoothed variable-order Markov models, one of
accepted and one of rejected urls. A model backs off from the longest context to shorter ones
(Witten-Bell weights). Counts are kept in tables of fixed size by hashing each context, so what
is sent to the executors has a bound that no input changes, while all training rows are counted. Each
url's log-likelihood difference is divided by its length; the threshold is the value that gives both
kinds of training rows the same error rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules (verdict, host, path prefix).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
ORDERS, SLOTS, SYMBOLS = 4, 4096, 128
#: Bins of the score histogram that the threshold is read from.
BINS, RANGE = 2000, 4.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end."""
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", 1)
    rest = F.when(F.instr(F.coalesce(url, F.lit("")), "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDERS zeros and before one zero, and the text that each belongs to."""
    raw = [np.frombuffer(t.encode("utf-8"), np.uint8) for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    flat = np.zeros(int(size.sum()) + ORDERS * len(raw), np.int64)
    start = np.cumsum(size + ORDERS) - (size + ORDERS)
    for s, r in zip(start, raw):
        flat[s + ORDERS : s + ORDERS + len(r)] = np.where(r < 128, r, 1)  # all bytes beyond ASCII are one symbol
    owner = np.repeat(np.arange(len(raw)), size + ORDERS)
    place = np.arange(len(flat)) - np.repeat(start, size + ORDERS)
    keep = place >= ORDERS
    return flat, np.where(keep, owner, -1)


def _slots(flat: np.ndarray) -> list[np.ndarray]:
    """For each order, the slot of the context of each symbol (order 0 has one)."""
    out, h = [np.zeros(len(flat), np.int64)], np.zeros(len(flat), np.uint64)
    for k in range(1, ORDERS + 1):
        before = np.zeros(len(flat), np.uint64)
        before[k:] = flat[:-k].astype(np.uint64)
        h = (h ^ before) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append((h % np.uint64(SLOTS)).astype(np.int64))
    return out


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, cell, n): symbols counted by context slot, summed within the task."""
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for label, part in pdf.groupby("label"):
            flat, owner = _codes(part.url.tolist())
            t = total.setdefault(int(label), np.zeros((ORDERS + 1) * SLOTS * SYMBOLS, np.int32))
            for k, slot in enumerate(_slots(flat)):
                np.add.at(t, (k * SLOTS + slot[owner >= 0]) * SYMBOLS + flat[owner >= 0], 1)
    for label, t in total.items():
        cell = np.flatnonzero(t)
        yield pd.DataFrame({"label": label, "cell": cell, "n": t[cell].astype(np.int64)})


class Models:
    """The two models, as tables of log-probabilities by context slot and symbol."""

    def __init__(self, counts: list[np.ndarray]):
        self.logs = [self._smooth(c) for c in counts]

    @staticmethod
    def _smooth(counts: np.ndarray) -> np.ndarray:
        return counts.reshape(ORDERS + 1, SLOTS, SYMBOLS).astype(np.float32)

    def _log(self, table: np.ndarray, slots: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
        p = np.full(len(flat), 1.0 / SYMBOLS)
        for k, slot in enumerate(slots):
            total, kinds = self.sums(table, k)
            weight = total[slot] / np.maximum(1e-9, total[slot] + kinds[slot])
            p = np.where(total[slot] > 0, weight * table[k, slot, flat] / np.maximum(1, total[slot]) + (1 - weight) * p, p)
        return np.log(p)

    def sums(self, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        key = (id(table), k)
        memo = self.__dict__.setdefault("memo", {})
        if key not in memo:
            memo[key] = (table[k].sum(1, dtype=np.float64), (table[k] > 0).sum(1))
        return memo[key]

    def score(self, texts: list[str]) -> np.ndarray:
        """Mean log-likelihood difference for each symbol: above 0 is more like accepted urls."""
        if not texts:
            return np.empty(0)
        flat, owner = _codes(texts)
        slots = _slots(flat)
        difference = self._log(self.logs[1], slots, flat) - self._log(self.logs[0], slots, flat)
        keep = owner >= 0
        return np.bincount(owner[keep], difference[keep], len(texts)) / np.bincount(owner[keep], minlength=len(texts))


def train(labelled: DataFrame) -> Models:
    """Models from all rows (url, label) with label 1 accepted, 0 rejected.

    At most 2 * (ORDERS + 1) * SLOTS * SYMBOLS cells reach the driver, whatever the input.
    """
    cells = labelled.select("url", "label").mapInPandas(_tally, "label int, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = []
    for label in (0, 1):
        t, part = np.zeros((ORDERS + 1) * SLOTS * SYMBOLS, np.int64), cells[cells.label == label]
        t[part.cell.to_numpy()] = part.n.to_numpy()
        counts.append(t)
    return Models(counts)


def calibrate(scored: DataFrame) -> float:
    """The threshold at which accepted and rejected rows (score, label) have equal error rates.

    Read from a histogram of BINS bins over all rows; 0 where one kind has no rows.
    """
    bin_ = F.floor((F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("score"))) + RANGE) / (2 * RANGE) * (BINS - 1)).cast("int")
    rows = scored.groupBy("label", bin_.alias("bin")).count().collect()
    h = np.zeros((2, BINS))
    for label, b, n in rows:
        h[label, b] += n
    if not h.sum(1).all():
        return 0.0
    accepted_below, rejected_above = np.cumsum(h[1]) / h[1].sum(), 1 - np.cumsum(h[0]) / h[0].sum()
    best = np.flatnonzero(np.abs(accepted_below - rejected_above) == np.abs(accepted_below - rejected_above).min())
    return float((best[len(best) // 2] + 1) / (BINS - 1) * 2 * RANGE - RANGE)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (columns of these names are replaced).

    A url without ``://``, or null, has an empty host and path; the models read it as it is (null: empty).
    Where no rule decides any url, or all are decided one way, the models can't differ by training and
    scores near 0 mean allow. Repeated rows are judged alike; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    base = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("__kindred_host"), path.alias("__kindred_path"))
    base = base.withColumn("__kindred_rule", rule(F.col("__kindred_host"), F.col("__kindred_path"), rules))
    labelled = base.filter("__kindred_rule is not null").select(F.coalesce("url", F.lit("")).alias("url"), (F.col("__kindred_rule.verdict") == "allow").cast("int").alias("label"))
    models = spark.sparkContext.broadcast(train(labelled))  # fixed size: see train()

    @F.pandas_udf("double")
    def score(url: pd.Series) -> pd.Series:
        return pd.Series(models.value.score(url.fillna("").tolist()))

    threshold = calibrate(labelled.select(score("url").alias("score"), "label"))
    judged = base.withColumn("score", score("url"))
    verdict = F.coalesce(F.col("__kindred_rule.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select(*[F.col(f"`{c}`") for c in kept], F.col("__kindred_host").alias("host"), F.col("__kindred_path").alias("path"), F.col("__kindred_rule.rule").alias("rule"), "score", verdict.alias("verdict"))
