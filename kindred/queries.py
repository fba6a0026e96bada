"""Registered queries of the duplicate-set engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import ACTIONS, BOX_FORMATS, Config
from kindred.functions import hashing, normalize
from kindred.operators import cascade, gate, memo, sinks, stats
from kindred.operators.strategies import ALIASES, STRATEGIES
from kindred.plans.dedup import keyed
from kindred.sources import mail
from kindred.sources.tables import boxes_from_table, mails_from_table

HEADERS = ("from", "to", "subject", "message-id")
OFF = {"size_threshold": -1, "content_threshold": -1}
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Values that look like headers, made of the columns of documents.
def _from() -> Column:
    return F.concat(F.lit('"'), F.upper("lang"), F.lit('  Desk"  <'), "lang", F.lit("@"), "source", F.lit(".org>"))


def _to() -> Column:
    return F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("<"), "source", F.lit("@list.org>")))


def _subject() -> Column:
    return F.concat(F.lit("Re: [list-1]  FW: "), F.col("text"))


def _message_id() -> Column:
    return F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("<"), (F.col("doc_id") % 97).cast("string"), F.lit("@x>")))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mails."""
    docs = table(spark, sf_dir, "documents")
    headers = {"From": _from(), "To": _to(), "Subject": _subject(), "Message-ID": _message_id()}
    return mails_from_table(docs, F.col("source"), F.col("doc_id"), headers, body=F.col("text"), path=F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def by_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mails whose headers tell language and size class: exact copies share a set."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("xx"))
    headers = {
        "From": F.concat(F.lit('"'), F.upper(lang), F.lit('  Desk"  <'), lang, F.lit("@list.org>")),
        "To": F.concat(F.lit("<"), lang, F.lit("@list.org>")),
        "Subject": F.concat(F.lit("Re: [list-1]  FW: "), lang),
        "Message-ID": F.concat(F.lit("<"), F.floor(F.length(text) / 64).cast("string"), F.lit("@x>")),
    }
    where = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    docs = mails_from_table(table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"), headers, body=text, path=where, size=F.length(text))
    return keyed(docs, Config(hash_headers=HEADERS), bits=256).drop("canonical_headers", "n_headers", "header_hash")


def by_user(spark: SparkSession, sf_dir: str, nulls: int = 0) -> DataFrame:
    """Events keyed by user and kind; with ``nulls``, every so many have no time."""
    time = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6")
    where = F.concat_ws("/", F.lit("events"), "event_type", F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("source_path"),
        F.col("event_id").cast("string").alias("mail_id"),
        where.alias("path"),
        F.lit("table").alias("box_format"),
        F.concat(F.lit("<table "), where, F.lit(">")).alias("repr"),
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("mail_hash"),
        (F.when(F.col("event_id") % nulls != 0, time) if nulls else time).alias("timestamp"),
        F.floor("value").cast("long").alias("size"),
        F.lit("").alias("body_hash"),
        F.lit(None).cast("array<string>").alias("body_lines"),
        F.lit(None).cast("string").alias("rejection"),
        F.lit(False).alias("encoding_error"),
    )


def decided(spark: SparkSession, sf_dir: str, *strategies: str, front: Callable = by_headers, regexp: str | None = None, **options: object) -> DataFrame:
    c = Config(strategies=strategies, regexp=regexp, **(OFF | options))
    return cascade.decide(front(spark, sf_dir), c)


def _doc_columns(value: Callable[[], Column]) -> Query:
    return lambda s, d: table(s, d, "documents").select("doc_id", value().alias("v"))


def _keyed(*columns: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = keyed(mails(s, d), Config(hash_headers=HEADERS), bits=256)
        return rows.select(F.col("mail_id").cast("long").alias("doc_id"), *columns)

    return run


def _strategy(name: str) -> Query:
    kind = STRATEGIES[name].name
    front = by_user if STRATEGIES[name].timed else by_headers
    regexp = "src1/(en|fr)" if kind.endswith("path") else None
    return lambda s, d: decided(s, d, name, front=front, regexp=regexp).select("mail_id", "decision")


def _cascade(*strategies: str, nulls: int = 0) -> Query:
    front = lambda s, d: by_user(s, d, nulls)
    return lambda s, d: decided(s, d, *strategies, front=front).select("mail_id", "decision", "strategy", "set_outcome")


def _flagship(s: SparkSession, d: str) -> DataFrame:
    return decided(s, d, "select-newest", "select-biggest", "select-one", front=by_headers, size_threshold=32)


def _memo(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(listing now, what was remembered): some mails changed, some came, some went, some boxes weren't opened."""
    docs = table(s, d, "documents").select(F.col("source").alias("source_path"), F.col("doc_id").cast("string").alias("mail_id"), "doc_id", F.length("text").cast("long").alias("file_size"))
    now = docs.filter("doc_id % 7 != 0 and source_path not in ('src1', 'src2')").select("source_path", "mail_id", "file_size", F.col("doc_id").alias("mtime_ns"))
    old = docs.filter("doc_id % 3 != 0").select("source_path", "mail_id", "file_size", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime_ns"), F.md5("mail_id").alias("mail_hash"), F.lit(None).cast("double").alias("timestamp"), F.col("file_size").alias("size"), F.lit("").alias("body_hash"))
    return now, old


def _memo_query(which: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        now, old = _memo(s, d)
        if which == "hits":
            return memo.hits(now, old).select("source_path", "mail_id", "mail_hash")
        if which == "misses":
            return memo.misses(now, old).select("source_path", "mail_id")
        if which == "prune_mails":
            return memo.vanished(old, now).select("source_path", "mail_id")
        existing = s.createDataFrame([(f"src{i}",) for i in (0, 1, 3)], "source_path string")
        fresh = memo.misses(now, old).select("*", F.md5("mail_id").alias("mail_hash"), F.lit(None).cast("double").alias("timestamp"), F.col("file_size").alias("size"), F.lit("").alias("body_hash"))
        return memo.merged(old, now, fresh, existing).select("source_path", "mail_id", "file_size", "mtime_ns", "mail_hash")

    return run


def _action(action: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = sinks.targets(decided(s, d, "select-biggest", "select-one"), action)
        return rows.select("source_path", "mail_id", F.lit(sinks.verb(action)).alias("verb"), F.col("link_target.path").alias("target") if action.startswith("hardlink") else F.lit("").alias("target"))

    return run


def _scan(box_format: str) -> Query:
    """Documents written as mail boxes, one a source, then listed, opened and parsed as any mail is."""

    def run(s: SparkSession, d: str) -> DataFrame:
        docs = table(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("box"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        root = boxes_from_table(docs, box_format)
        rows = keyed(mail.parse(mail.list_mails(s, sorted(root), box_format)), Config(hash_headers=("date", "from", "subject", "message-id"), hash_body="normalized"), bits=256)
        headers = F.element_at(F.filter("canonical_headers", lambda h: h["id"] == "message-id"), 1)["value"]
        return rows.select(F.element_at(F.split("source_path", "/"), -1).alias("box"), F.regexp_extract(headers, "^[0-9]+", 0).cast("long").alias("doc_id"), F.col("timestamp").cast("long").alias("sent"), "n_headers", "size", F.substring("mail_hash", 65, 64).alias("body_hash"), "rejection")

    return run


QUERIES: dict[str, Query] = {
    "flagship_dedup": lambda s, d: _flagship(s, d).select("mail_id", "decision", "set_outcome", "evicted"),
    "scan_counts_by_source": lambda s, d: table(s, d, "documents").groupBy(F.col("source").alias("source_path")).agg(F.count("*").alias("found")),
    "norm_whitespace": _doc_columns(lambda: normalize.collapse(F.col("text"))),
    "norm_subject": _doc_columns(lambda: normalize.normalize("subject", _subject())),
    "norm_content_type": _doc_columns(lambda: normalize.normalize("content-type", F.concat(F.lit("text/plain ; charset="), "lang"))),
    "norm_address": _doc_columns(lambda: normalize.normalize("from", _from())),
    "norm_message_id": _doc_columns(lambda: normalize.normalize("message-id", _message_id())),
    "norm_date": lambda s, d: table(s, d, "orders").select("o_orderkey", normalize.day(F.lit("?"), F.expr("datediff(cast(o_orderdate as date), date'1970-01-01') * 86400.0D + 3600")).alias("v")),
    "canonical_header_string": lambda s, d: keyed(mails(s, d), Config(hash_headers=HEADERS)).select(F.col("mail_id").cast("long").alias("doc_id"), normalize.serialize(F.col("canonical_headers")).alias("v")),
    "hash_key_sha256": _keyed("header_hash", "n_headers"),
    "hash_key_sha224": lambda s, d: keyed(mails(s, d), Config(hash_headers=HEADERS)).select(F.col("mail_id").cast("long").alias("doc_id"), "mail_hash"),
    "hash_composite_raw": lambda s, d: keyed(mails(s, d), Config(hash_headers=HEADERS, hash_body="raw"), bits=256).select(F.col("mail_id").cast("long").alias("doc_id"), "mail_hash"),
    "body_hash_raw": _keyed("body_hash", "size"),
    "body_hash_normalized": lambda s, d: mails(s, d).select(F.col("mail_id").cast("long").alias("doc_id"), hashing.normalized_body(F.col("body_lines"), 256).alias("body_hash")),
    "reject_min_headers": _keyed("rejection"),
    "group_duplicates": lambda s, d: by_headers(s, d).groupBy("mail_hash").agg(F.count("*").alias("n")).filter("n > 1"),
    "unique_rows": lambda s, d: decided(s, d).filter("decision = 'unique'").select("mail_id"),
    "set_aggregates": lambda s, d: cascade.sets(decided(s, d, "select-oldest", front=by_user)).select("mail_hash", "n", "oldest", "newest", "smallest", "biggest", "bodies"),
    "distinct_bodies": lambda s, d: cascade.sets(decided(s, d)).select("mail_hash", "n", "bodies"),
    "cascade_time_then_one": _cascade("select-newest", "select-one"),
    "cascade_exhausted": _cascade("select-smaller", "select-bigger"),
    "cascade_null_timestamp": _cascade("select-older", "select-oldest", nulls=9),
    "cascade_null_then_size": _cascade("select-older", "select-biggest", nulls=9),
    "gate_fast_path": lambda s, d: gate.contested(by_headers(s, d), 32, 768).select("mail_id", "contested"),
    "gate_size_pairs": lambda s, d: decided(s, d, "select-one", size_threshold=16).select("mail_id", "evicted", "set_outcome"),
    "gate_evict_outliers": lambda s, d: decided(s, d, "select-biggest", "select-one", size_threshold=8).select("mail_id", "evicted", "decision"),
    "gate_content_diff": lambda s, d: decided(s, d, "select-one", size_threshold=32, content_threshold=768).select("mail_id", "evicted", "set_outcome"),
    "cache_hits": _memo_query("hits"),
    "cache_misses": _memo_query("misses"),
    "cache_prune_mails": _memo_query("prune_mails"),
    "cache_next_version": _memo_query("next"),
    "link_targets": lambda s, d: decided(s, d, "select-biggest", "select-one").filter("decision = 'discarded'").select("mail_id", F.col("link_target.path").alias("target")),
    "stats_report": lambda s, d: stats.report(stats.stats(decided(s, d, "select-biggest", "select-one"), "copy")).select("category", "metric", "value"),
} | {s.replace("-", "_"): _strategy(s) for s in STRATEGIES} | {f"action_{a.replace('-', '_')}": _action(a) for a in ACTIONS} | {f"scan_{f}": _scan(f) for f in BOX_FORMATS}

# SQL of the same, for DuckDB.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PREFIXES = r"(?i)^(?:(?:re|fwd?):\x20+|\[[\p{L}\p{N}_][\p{L}\p{N}_-]*[\p{L}\p{N}_]?\]\x20+)+"
_FROM = """('"' || upper(lang) || '  Desk"  <' || lang || '@' || source || '.org>')"""
_TO = "(CASE WHEN doc_id % 5 <> 0 THEN '<' || source || '@list.org>' END)"
_SUBJECT = "('Re: [list-1]  FW: ' || text)"
_ID = "(CASE WHEN doc_id % 7 <> 0 THEN '<' || CAST(doc_id % 97 AS VARCHAR) || '@x>' END)"
_STRIP = "regexp_replace({0}, '^<([^<>,]+)>$', '\\1')"


def _C(v: str) -> str:
    return f"trim(regexp_replace({v}, '{_WS}+', ' ', 'g'))"


_N_FROM = _STRIP.format(_C(f"replace({_C(_FROM)}, '\"', '')"))
_N_TO = _STRIP.format(_C(f"replace({_C(_TO)}, '\"', '')"))
_N_SUBJECT = f"regexp_replace({_C(_SUBJECT)}, '{_PREFIXES}', '')"
_N_ID = _STRIP.format(_C(_ID))
_LINES = f"""concat_ws(chr(10), 'from: ' || {_N_FROM}, 'to: ' || {_N_TO}, 'subject: ' || {_N_SUBJECT}, 'message-id: ' || {_N_ID})"""
_N = f"(CASE WHEN {_TO} IS NULL THEN 0 ELSE 1 END + CASE WHEN {_ID} IS NULL THEN 0 ELSE 1 END + 2)"
_LANG = "coalesce(lang, 'xx')"
_SET_FROM = f"""('"' || upper({_LANG}) || '  Desk"  <' || {_LANG} || '@list.org>')"""
_SET_LINES = f"""concat_ws(chr(10), 'from: ' || {_STRIP.format(_C(f"replace({_C(_SET_FROM)}, '" + '"' + "', '')"))}, 'to: ' || {_LANG} || '@list.org', 'subject: ' || {_LANG}, 'message-id: ' || CAST(length(coalesce(text, '')) // 64 AS VARCHAR) || '@x')"""
_DOCS = f"SELECT CAST(doc_id AS VARCHAR) AS mail_id, source AS source_path, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, sha256({_SET_LINES}) AS mail_hash, CAST(NULL AS DOUBLE) AS ts, length(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS body FROM documents"


def _events(nulls: int = 0) -> str:
    time = f"CASE WHEN event_id % {nulls} <> 0 THEN epoch(ts) END" if nulls else "epoch(ts)"
    return f"SELECT CAST(event_id AS VARCHAR) AS mail_id, 'events' AS source_path, 'events/' || event_type || '/' || CAST(event_id AS VARCHAR) AS path, CAST(user_id AS VARCHAR) || '|' || event_type AS mail_hash, {time} AS ts, CAST(floor(value) AS BIGINT) AS size, '' AS body FROM events"


# What each choice keeps, and when it decides.
_SQL_KEEP = {
    "select-older": ("ts < ts_max", "dated AND ts_min < ts_max"),
    "select-oldest": ("ts = ts_min", "dated AND ts_min < ts_max"),
    "select-newer": ("ts > ts_min", "dated AND ts_min < ts_max"),
    "select-newest": ("ts = ts_max", "dated AND ts_min < ts_max"),
    "select-smaller": ("size < size_max", "size_min < size_max"),
    "select-smallest": ("size = size_min", "size_min < size_max"),
    "select-bigger": ("size > size_min", "size_min < size_max"),
    "select-biggest": ("size = size_max", "size_min < size_max"),
    "select-matching-path": ("hit", "hits > 0 AND hits < n"),
    "select-non-matching-path": ("NOT hit", "hits > 0 AND hits < n"),
    "select-one": ("pick = 1", "n > 1"),
    "select-all-but-one": ("pick > 1", "n > 1"),
}


def _decide(rows: str, *names: str) -> str:
    """A query of mail_id, path, decision, strategy and set_outcome, with both gates off."""
    case = lambda f: "CASE " + " ".join(f"WHEN {_SQL_KEEP[STRATEGIES[s].name][1]} THEN {f(s)}" for s in names) + " END" if names else "NULL"
    failed = "CASE WHEN dated THEN 'skipped_strategy' ELSE 'skipped_timestamp' END" if names and STRATEGIES[names[-1]].timed else "'skipped_strategy'"
    return f"""WITH m AS ({rows}), f AS (
SELECT *, regexp_matches(path, 'src1/(en|fr)') AS hit, count(*) OVER w AS n, count(ts) OVER w = count(*) OVER w AS dated,
 min(ts) OVER w AS ts_min, max(ts) OVER w AS ts_max, min(size) OVER w AS size_min, max(size) OVER w AS size_max,
 sum(CASE WHEN regexp_matches(path, 'src1/(en|fr)') THEN 1 ELSE 0 END) OVER w AS hits,
 row_number() OVER (PARTITION BY mail_hash ORDER BY md5('0|' || mail_hash || '|<table ' || path || '>'), '<table ' || path || '>') AS pick
FROM m WINDOW w AS (PARTITION BY mail_hash)),
c AS (SELECT *, CASE WHEN n > 1 THEN {case(lambda s: f"'{s}'")} END AS strategy, CASE WHEN n > 1 THEN {case(lambda s: _SQL_KEEP[STRATEGIES[s].name][0])} END AS kept FROM f),
decided AS (SELECT mail_id, source_path, mail_hash, path, n, strategy, CASE WHEN n = 1 THEN 'unique' WHEN strategy IS NULL THEN 'skipped' WHEN kept THEN 'selected' ELSE 'discarded' END AS decision,
 CASE WHEN n = 1 THEN 'single' WHEN strategy IS NOT NULL THEN 'deduplicated' ELSE {failed} END AS set_outcome FROM c)"""


_BIGGEST = _decide(_DOCS, "select-biggest", "select-one")
_TARGET = "SELECT mail_hash, arg_min(path, (path, mail_id)) AS target FROM decided WHERE decision = 'selected' GROUP BY mail_hash"
_NOW = "now AS (SELECT source AS source_path, CAST(doc_id AS VARCHAR) AS mail_id, length(text) AS file_size, doc_id AS mtime_ns FROM documents WHERE doc_id % 7 <> 0 AND source NOT IN ('src1', 'src2'))"
_OLD = "old AS (SELECT source AS source_path, CAST(doc_id AS VARCHAR) AS mail_id, length(text) AS file_size, CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 ELSE doc_id END AS mtime_ns, md5(CAST(doc_id AS VARCHAR)) AS mail_hash FROM documents WHERE doc_id % 3 <> 0)"
_MISSES = "SELECT n.* FROM now n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source_path = n.source_path AND o.mail_id = n.mail_id AND o.file_size = n.file_size AND o.mtime_ns = n.mtime_ns)"


def _action_sql(action: str) -> str:
    wanted = "('discarded')" if action.endswith("discarded") else "('selected', 'unique')"
    if action.startswith("hardlink"):
        return f"{_BIGGEST}, t AS ({_TARGET}) SELECT source_path, mail_id, 'hardlink' AS verb, target FROM decided JOIN t USING (mail_hash) WHERE decision IN {wanted}"
    return f"{_BIGGEST} SELECT source_path, mail_id, '{action.split('-')[0]}' AS verb, '' AS target FROM decided WHERE decision IN {wanted}"


def _report_sql() -> str:
    mails_ = {
        "found": "count(*)", "rejected": "0 * count(*)", "retained": "count(*)", "hashes": "count(DISTINCT mail_hash)",
        "unique": "count(*) FILTER (decision = 'unique')", "duplicates": "count(*) FILTER (n > 1)", "skipped": "count(*) FILTER (decision = 'skipped')",
        "discarded": "count(*) FILTER (decision = 'discarded')", "selected": "count(*) FILTER (decision = 'selected')",
        "copied": "count(*) FILTER (decision IN ('selected', 'unique'))", "moved": "0 * count(*)", "deleted": "0 * count(*)", "hardlinked": "0 * count(*)", "hardlink_skipped": "0 * count(*)",
    }
    sets_ = {"total": "count(DISTINCT mail_hash)"} | {k: f"count(DISTINCT mail_hash) FILTER (set_outcome = '{k}')" for k in ("single", "skipped_encoding", "skipped_size", "skipped_content", "skipped_timestamp", "skipped_strategy", "deduplicated")}
    parts = [f"SELECT '{c}' AS category, '{k}' AS metric, CAST({v} AS BIGINT) AS value FROM decided" for c, d in (("mail", mails_), ("set", sets_)) for k, v in d.items()]
    return f"{_BIGGEST} {' UNION ALL '.join(parts)}"


SQL: dict[str, str] = {
    "scan_counts_by_source": "SELECT source AS source_path, count(*) AS found FROM documents GROUP BY source",
    "norm_whitespace": f"SELECT doc_id, {_C('text')} AS v FROM documents",
    "norm_subject": f"SELECT doc_id, {_N_SUBJECT} AS v FROM documents",
    "norm_content_type": "SELECT doc_id, 'text/plain ' AS v FROM documents",
    "norm_address": f"SELECT doc_id, {_N_FROM} AS v FROM documents",
    "norm_message_id": f"SELECT doc_id, {_N_ID} AS v FROM documents",
    "norm_date": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders",
    "canonical_header_string": f"SELECT doc_id, {_LINES} AS v FROM documents",
    "hash_key_sha256": f"SELECT doc_id, sha256({_LINES}) AS header_hash, CAST({_N} AS INTEGER) AS n_headers FROM documents",
    "hash_composite_raw": f"SELECT doc_id, CASE WHEN {_N} >= 4 THEN sha256({_LINES}) || sha256(text) END AS mail_hash FROM documents",
    "body_hash_raw": "SELECT doc_id, sha256(text) AS body_hash, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS size FROM documents",
    "body_hash_normalized": f"SELECT doc_id, sha256(regexp_replace(text, '{_WS}', '', 'g')) AS body_hash FROM documents",
    "reject_min_headers": f"SELECT doc_id, CASE WHEN {_N} < 4 THEN CAST({_N} AS VARCHAR) || ' headers found out of 4.' END AS rejection FROM documents",
    "group_duplicates": f"SELECT mail_hash, count(*) AS n FROM ({_DOCS}) GROUP BY 1 HAVING count(*) > 1",
    "unique_rows": f"{_decide(_DOCS)} SELECT mail_id FROM decided WHERE decision = 'unique'",
    "set_aggregates": f"SELECT mail_hash, count(*) AS n, min(ts) AS oldest, max(ts) AS newest, min(size) AS smallest, max(size) AS biggest, count(DISTINCT body) AS bodies FROM ({_events()}) GROUP BY mail_hash",
    "distinct_bodies": f"SELECT mail_hash, count(*) AS n, count(DISTINCT body) AS bodies FROM ({_DOCS}) GROUP BY mail_hash",
    "cascade_time_then_one": f"{_decide(_events(), 'select-newest', 'select-one')} SELECT mail_id, decision, strategy, set_outcome FROM decided",
    "cascade_exhausted": f"{_decide(_events(), 'select-smaller', 'select-bigger')} SELECT mail_id, decision, strategy, set_outcome FROM decided",
    "cascade_null_timestamp": f"{_decide(_events(9), 'select-older', 'select-oldest')} SELECT mail_id, decision, strategy, set_outcome FROM decided",
    "cascade_null_then_size": f"{_decide(_events(9), 'select-older', 'select-biggest')} SELECT mail_id, decision, strategy, set_outcome FROM decided",
    "gate_fast_path": f"SELECT mail_id, count(*) OVER w > 1 AND NOT (max(size) OVER w - min(size) OVER w <= 32 AND min(body) OVER w = max(body) OVER w) AS contested FROM ({_DOCS}) WINDOW w AS (PARTITION BY mail_hash)",
    "cache_hits": f"WITH {_NOW}, {_OLD} SELECT source_path, mail_id, mail_hash FROM now JOIN old USING (source_path, mail_id, file_size, mtime_ns)",
    "cache_misses": f"WITH {_NOW}, {_OLD} SELECT source_path, mail_id FROM ({_MISSES})",
    "cache_prune_mails": f"WITH {_NOW}, {_OLD} SELECT source_path, mail_id FROM old WHERE source_path IN (SELECT source_path FROM now) AND (source_path, mail_id) NOT IN (SELECT (source_path, mail_id) FROM now)",
    "cache_next_version": f"WITH {_NOW}, {_OLD} SELECT source_path, mail_id, file_size, mtime_ns, mail_hash FROM now JOIN old USING (source_path, mail_id, file_size, mtime_ns) UNION ALL SELECT source_path, mail_id, file_size, mtime_ns, mail_hash FROM old WHERE source_path NOT IN (SELECT source_path FROM now) AND source_path IN ('src0', 'src1', 'src3') UNION ALL SELECT source_path, mail_id, file_size, mtime_ns, md5(mail_id) FROM ({_MISSES})",
    "link_targets": f"{_BIGGEST}, t AS ({_TARGET}) SELECT mail_id, target FROM decided JOIN t USING (mail_hash) WHERE decision = 'discarded'",
    "stats_report": _report_sql(),
} | {s.replace("-", "_"): f"{_decide(_events() if STRATEGIES[s].timed else _DOCS, s)} SELECT mail_id, decision FROM decided" for s in [*_SQL_KEEP, *ALIASES]} | {f"action_{a.replace('-', '_')}": _action_sql(a) for a in ACTIONS}


def _scan_sql(box_format: str) -> str:
    text = "coalesce(text, '')"
    if box_format in ("mbox", "mmdf"):  # lines that look like a new mail are quoted in such boxes
        text = f"substr(replace(chr(10) || {text}, chr(10) || 'From ', chr(10) || '>From '), 2)"
    return f"SELECT coalesce(source, 'none') AS box, doc_id, 1000000000 + 3600 * doc_id AS sent, CAST(4 AS INTEGER) AS n_headers, CAST(length(replace({text}, chr(10), '')) AS BIGINT) AS size, sha256(regexp_replace({text}, '{_WS}', '', 'g')) AS body_hash, CAST(NULL AS VARCHAR) AS rejection FROM documents"


SQL |= {f"scan_{f}": _scan_sql(f) for f in BOX_FORMATS}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship(spark, sf_dir)
