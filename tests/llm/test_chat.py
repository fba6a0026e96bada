import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def round_trip(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    out = chat.format_chats(df).select("*", chat.parse(F.col("formatted")).alias("p"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    want = {}
    for c, turn, role, text in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        assert [tuple(t) for t in r.p] == want[r.conv_id]
        assert list(r.l) == [t for role, t in want[r.conv_id] if role == "assistant"]
    return out


PIECES = ["</turn>\n", "</turn>", "### ", "\\", "\\b", "\\l", "\\h", "\\w", "<", "#", "\n", "a", "é🙂", " ", "### assistant\n", "b", "</tur", "n>\n"]


def test_hostile_texts_come_back(spark):
    r = random.Random(3)
    text = lambda: "".join(r.choice(PIECES) for _ in range(r.randint(0, 8)))
    data = [(c, t, r.choice(["user", "assistant", text()]), text()) for c in range(150) for t in range(r.randint(1, 5))]
    said = "\\### Assistant: </turn> ok"
    data += [(-7, 0, "user", said), (-7, 1, "assistant", said), (900, 0, None, None), (900, None, "assistant", "x" * 200_000), (900, 0, None, None), (None, 1, "user", "no id")]
    out = round_trip(spark, data, formatted="clash", turns=1, t=2)
    assert {x.conv_id: x.n_escaped for x in out}[-7] == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system\n"]), st.text(alphabet="\\<#/turn> \nbé", max_size=30)), min_size=1, max_size=6))
def test_any_text(spark, turns):
    round_trip(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])


def test_plain_texts_are_not_escaped(spark):
    out = round_trip(spark, [(1, 0, "user", "1 < 2 # \\ ok"), (1, 1, "assistant", "yes")])
    assert out[0].formatted == "### user\n1 < 2 # \\ ok</turn>\n### assistant\nyes</turn>\n" and out[0].n_escaped == 0


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
