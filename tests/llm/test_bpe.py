import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from kindred.llm import bpe

from .helpers import docs, empty, rows


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(7)
    near = "aaabbbcdeth in  \n\t'sé日本語🙂 0123 ####__--==ing"
    out = ["".join(r.choice(near) for _ in range(r.randint(0, 80))) for _ in range(400)]
    out += ["".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x24F), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(40)) for _ in range(200)]
    return [*out, "a" * 3000, " " * 500, "=" * 777, "th" * 2000 + "e", "<|endoftext|>", "\x00\x01", *[t or "" for _, t, *_ in rows()]]


@pytest.mark.parametrize("steps", [120_000, 50])
def test_encoder_is_exact(ranks, library, monkeypatch, steps):
    monkeypatch.setattr(bpe, "MOST_STEPS", steps)
    machine, back = bpe.Transducer(ranks), bpe.Decoder(ranks)
    for t in texts():
        ids = machine.encode(t)
        assert list(ids) == library.encode_ordinary(t)
        assert back.decode(ids) == t


def test_transducer_emits_before_the_end(ranks):
    """A token comes out after bounded lookahead, not only when the piece is over."""
    machine = bpe.Transducer(ranks)
    state, late, most = 0, 0, 0
    for byte in b"internationalization" * 20:
        state, out = machine.step(state, byte)
        late = late + 1 - sum(len(machine.bytes_of[t]) for t in out)
        most = max(most, late)
    assert most <= machine.longest


def test_decoder_streams_and_replaces(ranks):
    back = bpe.Decoder(ranks)
    byte = {b: i for b, i in ranks.items() if len(b) == 1}
    for data in (b"\xf0\x9f\x99\x82ok", b"\xe6\x97", b"\xff\xc0a", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", "é".encode()):
        assert "".join(back.stream([byte[bytes([b])] for b in data])) == data.decode(errors="replace")
    assert list(back.stream([byte[b"\xc3"], byte[b"\xa9"]])) == ["", "é"]


def test_frames(spark, library):
    out = bpe.encode(docs(spark), decoded="decoded")
    for r in out.collect():
        assert list(r.ids) == library.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    again = bpe.decode(out.drop("decoded").withColumn("ids", F.when(F.col("doc_id") != 0, F.col("ids"))))
    assert {(r.doc_id, r.decoded) for r in again.collect() if r.doc_id == 0} == {(0, "")}
    wide = bpe.encode(docs(spark, extra=True), decoded="decoded")
    assert wide.count() == len(rows()) and dict(wide.dtypes)["ids"] == "array<int>" and "key" in wide.columns
    assert bpe.encode(empty(spark)).count() == 0
