"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

from kindred.llm.quality import CLASSES, COMMON, PUNCTUATION

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
r AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM x JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT k.doc_id, string_agg(k.w[k.i], ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k ANTI JOIN r ON k.doc_id = r.doc_id AND k.i = r.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)"""

_QUOTED = PUNCTUATION.replace("'", "''").replace("-", "\\-")
_TAKEN = {
    "lower": "[a-z]",
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "space": r"[\x20\x09-\x0D]",
    "mark": f"[{_QUOTED}]",
    "symbol": "[#*$%&|<>]",
}


def _bytes(pattern: str) -> str:
    return f"CAST(strlen(t) - strlen(regexp_replace(t, '{pattern}', '', 'g')) AS DOUBLE)"


def _op2(min_words: int = 50, class_limit: tuple[float, float] = (0.18, 0.8), word_limit: tuple[float, float] = (0.1, 1.6)) -> str:
    counts = [_bytes(p) for p in _TAKEN.values()]
    wide = "CAST(strlen(t) - length(t) AS DOUBLE)"
    every = "[" + ", ".join([*counts, wide, f"strlen(t) - {wide} - " + " - ".join(counts)]) + "]"
    assert list(_TAKEN) + ["wide", "rest"] == CLASSES
    listed = "CASE lang " + " ".join(f"WHEN '{x}' THEN [{', '.join(repr(w) for w in words)}]" for x, words in COMMON.items()) + " ELSE []::VARCHAR[] END"
    found = ", ".join(f"CAST(len(list_filter(w, lambda x: x = c[{k}])) AS DOUBLE)" for k in range(1, 17))
    mean = lambda name, n: "[" + ", ".join(f"avg({name}[{i}])" for i in range(1, n + 1)) + "]"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
    distance = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part('z[1]', 'z[2]')}) / 2 + ({part('z[2]', 'z[1]')}) / 2))))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(map(repr, COMMON))}) THEN lang ELSE 'other' END AS lang, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, a, b, c FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT g.doc_id, g.i + unnest([0, 1, 2]) AS i FROM g JOIN twice USING (doc_id, a, b, c)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
f AS (SELECT doc_id, lang, len(w) AS n, length(array_to_string(w, '')) AS word_chars, {every} AS classes, {listed} AS c, w FROM d),
m AS (SELECT * EXCLUDE (w, c), list_transform(classes, lambda v: v / greatest(1, list_sum(classes))) AS cs, [{found}] AS hits FROM f),
s AS (SELECT *, list_transform(list_append(hits, n - list_sum(hits)), lambda v: v / greatest(1.0, n)) AS ms FROM m),
q AS (SELECT lang, {mean('cs', 8)} AS qc, {mean('ms', 17)} AS qm FROM s WHERE n >= {min_words} GROUP BY lang),
j AS (SELECT s.*, coalesce({distance('cs', 'qc')}, 0) AS dc, coalesce({distance('ms', 'qm')}, 0) AS dm, coalesce(rep.n, 0) AS n_rep, len(l.l) - len(list_distinct(l.l)) AS n_dup
 FROM s LEFT JOIN q USING (lang) LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(classes[6] AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words,
 n < {min_words} OR 100 * n_rep > 50 * n AS base_failed,
 NOT (n < {min_words} OR 100 * n_rep > 50 * n) AND dc <= {class_limit[0]} + {class_limit[1]} / sqrt(greatest(n, 1)) AND dm <= {word_limit[0]} + {word_limit[1]} / sqrt(greatest(n, 1)) AS kept
FROM j"""


OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

OP5 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200),
x AS (SELECT doc_id, i, sha256(b[i:i + 199]) AS h FROM p),
f AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM x SEMI JOIN f USING (h)),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
s AS (SELECT doc_id, g, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, max(hi) AS last FROM s GROUP BY doc_id),
k AS (SELECT doc_id, lo AS o, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS z FROM s
 UNION ALL SELECT doc_id, octet_length(b) + 1, coalesce(last, 0) + 1, octet_length(b) FROM d LEFT JOIN t USING (doc_id)),
o AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY o))) AS kept_sha256 FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d LEFT JOIN t USING (doc_id) JOIN o USING (doc_id)"""

_COD = lambda v: f"replace(replace(replace({v}, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '#', chr(92) || 'h')"
_HOT = lambda v: f"(contains({v}, '</turn>' || chr(10)) OR regexp_matches({v}, '\\\\[blhw]'))"
OP10 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, {_HOT('text')} OR {_HOT('role')} OR contains(role, chr(10)) AS coded FROM r),
f AS (SELECT *, CASE WHEN coded THEN length({_COD('text')}) + length(replace({_COD('role')}, chr(10), chr(92) || 'w')) ELSE length(text) + length(role) END + 13 AS size FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

OP8 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, 2 * CAST(source_size AS DOUBLE) AS cap, 2 * CAST(source_size AS DOUBLE) / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / CAST(weights - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level FROM c
 WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, budget, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) * weight, cap)) AS target FROM l),
q AS (SELECT d.*, g.target, g.budget, turn, CAST('0x' || substring(md5('17|' || turn || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), 1, 10) AS BIGINT) AS draw
 FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (SELECT unnest([0, 1]) AS turn) WHERE size > 0),
f AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY turn, draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish FROM q),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, turn, draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS total FROM f),
t AS (SELECT doc_id, source, size, count(*) AS times FROM m WHERE total <= budget GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy, count(*) OVER (PARTITION BY doc_id, source, size) AS alike FROM d)
SELECT a.doc_id, a.source, a.size, g.source_size, g.target, CAST(a.size * (coalesce(t.times, 0) // alike + CASE WHEN copy <= coalesce(t.times, 0) % alike THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM a JOIN g ON a.source IS NOT DISTINCT FROM g.source LEFT JOIN t ON a.doc_id IS NOT DISTINCT FROM t.doc_id AND a.source IS NOT DISTINCT FROM t.source AND a.size = t.size"""

SQL = {"op8_mix_sources": OP8, "op1_substring_dedup": OP1, "op2_quality_rules": _op2(), "op3_embedding_near_dedup": OP3, "op5_suffix_array_dedup": OP5, "op10_chat_format": OP10}
