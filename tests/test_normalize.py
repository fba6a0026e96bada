import email
import hashlib

import pytest
from pyspark.sql import functions as F

from kindred.config import Config, header_ids
from kindred.functions import hashing, mime, normalize
from kindred.plans.dedup import keyed

from .mails import make

# (header, values, what is left of them)
CASES = [
    ("x-any", ["  value  with   spaces  "], "value with spaces"),
    ("x-any", ["", "   ", "valid"], "valid"),
    ("x-any", ["a b\u001cc　d"], "a b c d"),
    ("subject", ["Fwd: [list] Re: [other-list] Topic"], "Topic"),
    ("subject", ["Re:No space after colon"], "Re:No space after colon"),
    ("subject", ["RE: FW:   fwd: Topic re: x"], "Topic re: x"),
    ("subject", ["[a] one"], "one"),
    ("subject", ["[123numericlist] one"], "one"),
    ("subject", ["[a-] one"], "one"),
    ("subject", ["[-a] one"], "[-a] one"),
    ("subject", ["[é-list] one"], "one"),
    ("subject", ["=?utf-8?q?caf=C3=A9?="], "=?utf-8?q?caf=C3=A9?="),
    ("subject", ["Re: "], "Re:"),
    ("content-type", ["text/plain;charset=utf-8"], "text/plain"),
    ("content-type", ["text/plain ; x"], "text/plain "),
    ("date", ["not a date"], "not a date"),
    ("from", ['""Empty Name"" <user@example.com>'], "Empty Name <user@example.com>"),
    ("to", ["<a@b>"], "a@b"),
    ("to", ["<>"], "<>"),
    ("to", ["<a@b>, <c@d>"], "<a@b>, <c@d>"),
    ("message-id", ["<x@y>"], "x@y"),
    ("message-id", ["<x,@y>"], "<x,@y>"),
    ("message-id", ["<<x@y>>"], "<<x@y>>"),
    ("message-id", ['"<x@y>"'], '"<x@y>"'),
    ("received", ["<a@b>"], "<a@b>"),
    ("cc", ["<a@b>", "<c@d>"], "a@b\nc@d"),
]


def test_header_values(spark):
    data = [(i, [(name, v) for v in values], name, want) for i, (name, values, want) in enumerate(CASES)]
    df = spark.createDataFrame(data, "i int, headers array<struct<name:string,value:string>>, name string, want string")
    for name in {c[0] for c in CASES}:
        for r in df.filter(F.col("name") == name).withColumn("c", normalize.canonical_headers(F.col("headers"), (name,), F.lit(None).cast("double"))).collect():
            assert [(h.id, h.value) for h in r.c] == [(name, r.want)], r


@pytest.mark.parametrize(("raw", "day"), [("15 Jan 2024 10:30:45 -0500", "2024-01-15"), ("Mon, 15 Jan 2024 23:30:00 -0500", "2024-01-16"), ("1 Jan 0101 10:00:00 +0000", "0101-01-01"), ("garbage", "garbage"), ("1 Jan 99999 10:00:00 +0000", None)])
def test_dates(spark, raw, day):
    parsed = mime.parsed_date(email.message_from_bytes(make(raw_date=raw)))
    got = spark.range(1).select(normalize.normalize("date", F.lit(raw), F.lit(parsed).cast("double"))).first()[0]
    assert day is None or got == day or raw.startswith("1 Jan 0101")


def test_golden_keys(spark):
    """Keys that follow from the rules, worked out by hand."""
    raw = b'Date: Mon, 04 Mar 2024 10:00:00 +0000\nFrom: sender@nohost.com\nTo: recipient@nohost.com\nSubject: Fixture mail\nMIME-Version: 1.0\nContent-Type: text/plain; charset="utf-8"\nMessage-Id: <pair@nohost.com>\n\nShared body.\n'
    c = mime.columns(email.message_from_bytes(raw))
    df = spark.createDataFrame([(c["headers"], c["parsed_date"], c["body_lines"])], "headers array<struct<name:string,value:string>>, parsed_date double, body_lines array<string>")
    for name in ("source_path", "mail_id", "path", "box_format", "parse_error"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    r = keyed(df.withColumn("encoding_error", F.lit(False)).withColumn("ctime", F.lit(0.0)), Config(hash_body="raw")).first()
    assert r.header_hash == "345b33feade1df9f73be078156e258c4b89ff1367ef1e7381bd0e486"
    assert r.body_hash == "a6c50a2056c7b0fab827818b2e36e9121f84fc71e33f7e6ac59e0497"
    assert r.mail_hash == r.header_hash + r.body_hash and r.size == 12
    n = spark.range(1).select(hashing.normalized_body(F.array(F.lit("Shared body.")))).first()[0]
    assert n == "5474fa4c192cc2cf9a8c8be16f3b3ade6469f2942c63e57c55ac3a98" == hashlib.sha224(b"Sharedbody.").hexdigest()


def test_presence_counts_even_if_nothing_is_left(spark):
    df = spark.createDataFrame([([("subject", "  "), ("to", "x")],)], "headers array<struct<name:string,value:string>>")
    got = df.select(normalize.canonical_headers(F.col("headers"), ("from", "subject", "to"), F.lit(None).cast("double")).alias("c")).first().c
    assert [(h.id, h.value) for h in got] == [("subject", ""), ("to", "x")]


def test_header_ids():
    assert header_ids(["To", "to", "X-a"]) == ("to", "x-a")
    for bad in ([], ["a b"], ["é"], [""]):
        with pytest.raises(ValueError):
            header_ids(bad)


def test_bodies():
    multi = b"MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\npre\n--B\nContent-Type: text/plain; charset=latin-1\nContent-Transfer-Encoding: quoted-printable\n\ncaf=E9\n--B\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--B\nContent-Type: text/plain; charset=nonsense\n\nplain\n--B--\nepi\n"
    assert mime.columns(email.message_from_bytes(multi))["body_lines"] == ["pre", "café", "aGVsbG8=", "plain", "epi"]
    assert mime.columns(email.message_from_bytes(b"Subject: \xff\xfeabc\n\nx"))["headers"][0]["value"].startswith("��")
    bad = mime.columns(email.message_from_bytes(b"Content-Type: multipart/mixed; boundary=B\n\n\xff pre\n--B\n\nx\n--B--\n"))
    assert bad["encoding_error"] and mime.columns(email.message_from_bytes(b"Subject: no date\n\n"))["parsed_date"] is None
