"""The registered queries, as they are: those with SQL against DuckDB, the others against brute force."""

import glob
import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    out = db.sql(entry.oracle_sql()[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)


def documents(db):
    return dict(db.sql("select doc_id, coalesce(text, '') from documents").fetchall())


def test_byte_bpe(spark, db):
    import tiktoken

    from kindred.llm import bpe

    library = tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in documents(db).items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op4_byte_bpe"](spark, DATA).collect()} == want


def test_secret_scan(spark, db):
    import regex

    assign = regex.compile(r"""(?:password|passwd|secret|token|api_?key)(?-i:["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", regex.I | regex.A)
    texts = documents(db)
    for r in entry.queries()["op6_secret_scan"](spark, DATA).collect():
        t = texts[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        base += [(m.start(), 1, m.end()) for m in regex.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in regex.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_simhash(spark, db):
    from .test_simhash import plain_fingerprint, roots

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op9_simhash_near_dedup"](spark, DATA).collect()}
    fps = {i: plain_fingerprint(t) for i, t in documents(db).items()}
    group = roots(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[group[f]] = min(i, least.get(group[f], i))
    assert got == {i: (f"{f:016x}", least[group[f]]) for i, f in fps.items()}


def test_the_rest_runs(spark):
    for name in ("op7_url_filter", "pipeline"):
        assert entry.queries()[name](spark, DATA).limit(1).count() == 1
