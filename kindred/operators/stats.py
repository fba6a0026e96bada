"""Counters of a run, and the laws that they obey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.schema import STATS

EXIT_INCONSISTENT = 115


def stats(decided: DataFrame, verb: str | None = None, subset: str = "selected", hardlink_skipped: int = 0, done: int | None = None) -> DataFrame:
    """One row with a BIGINT for each counter; ``verb`` and ``subset`` name the action that was taken."""
    some = lambda c: F.count(F.when(c, 1))
    kept, d = F.col("rejection").isNull(), F.col("decision")
    # One row a set first, so that sets are counted without a distinct; rejected mails make one row.
    per = decided.groupBy("mail_hash", kept.alias("kept")).agg(
        F.count("*").alias("n"),
        F.max("set_outcome").alias("outcome"),
        some(d == "unique").alias("unique"),
        some(d.isin("skipped", "set_aside")).alias("skipped"),
        some(d == "discarded").alias("discarded"),
        some(d == "selected").alias("selected"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = per.agg(
        total("n").alias("mail_found"),
        total(F.when(~F.col("kept"), F.col("n"))).alias("mail_rejected"),
        total(F.when(F.col("kept"), F.col("n"))).alias("mail_retained"),
        some(F.col("kept")).alias("mail_hashes"),
        total("unique").alias("mail_unique"),
        total(F.when(F.col("kept") & (F.col("n") > 1), F.col("n"))).alias("mail_duplicates"),
        total("skipped").alias("mail_skipped"),
        total("discarded").alias("mail_discarded"),
        total("selected").alias("mail_selected"),
        *[some(F.col("outcome") == k).alias(f"set_{k}") for k in ("single", "skipped_encoding", "skipped_size", "skipped_content", "skipped_timestamp", "skipped_strategy", "deduplicated")],
    )
    count = {"copied": "copy", "moved": "move", "deleted": "delete", "hardlinked": "hardlink"}
    acted = F.col("mail_discarded") if subset == "discarded" else F.col("mail_selected") + F.col("mail_unique")
    if done is not None:
        acted = F.lit(done)
    for name, v in count.items():
        row = row.withColumn(f"mail_{name}", (acted - hardlink_skipped if v == "hardlink" else acted).cast("long") if v == verb else F.lit(0).cast("long"))
    row = row.withColumn("mail_hardlink_skipped", F.lit(hardlink_skipped).cast("long")).withColumn("set_total", F.col("mail_hashes"))
    return row.select(*STATS)


def report(row: DataFrame) -> DataFrame:
    """(category, metric, value, description), mails before sets."""
    items = F.array(*[F.struct(F.lit(k.split("_")[0]).alias("category"), F.lit(k.split("_", 1)[1]).alias("metric"), F.col(k).alias("value"), F.lit(v).alias("description")) for k, v in STATS.items()])
    return row.select(F.explode(items).alias("r")).select("r.*")


def broken_laws(s: dict[str, int], verb: str | None = None, subset: str = "selected") -> list[str]:
    """Which conservation laws do not hold for the counters ``s``."""
    skipped = sum(s[f"set_skipped_{k}"] for k in ("encoding", "size", "content", "timestamp", "strategy"))
    laws = {
        "found >= rejected": s["mail_found"] >= s["mail_rejected"],
        "found >= retained": s["mail_found"] >= s["mail_retained"],
        "found = rejected + retained": s["mail_found"] == s["mail_rejected"] + s["mail_retained"],
        "retained = unique + duplicates": s["mail_retained"] == s["mail_unique"] + s["mail_duplicates"],
        "retained = unique + skipped + discarded + selected": s["mail_retained"] == s["mail_unique"] + s["mail_skipped"] + s["mail_discarded"] + s["mail_selected"],
        "sets = hashes": s["set_total"] == s["mail_hashes"],
        "single sets = unique": s["set_single"] == s["mail_unique"],
        "sets = single + skipped + deduplicated": s["set_total"] == s["set_single"] + skipped + s["set_deduplicated"],
    }
    for k in ("unique", "duplicates", "skipped", "discarded", "selected"):
        laws[f"retained >= {k}"] = s["mail_retained"] >= s[f"mail_{k}"]
    done = {"copy": "copied", "move": "moved", "delete": "deleted", "hardlink": "hardlinked"}
    if verb == "hardlink":
        laws["discarded = hardlinked + passed over"] = s["mail_discarded"] == s["mail_hardlinked"] + s["mail_hardlink_skipped"]
    elif verb:
        want = s["mail_discarded"] if subset == "discarded" else s["mail_selected"] + s["mail_unique"]
        laws[f"{verb} = {subset}"] = want == s[f"mail_{done[verb]}"]
    return [k for k, ok in laws.items() if not ok]
