r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role``, a line end, the text, ``</turn>`` and a line end. The parser
splits at turn ends and decodes ``\b \l \h \w`` as ``\ < #`` and a line end, always. A turn is first
rendered as it is; where the parser does not give it back (its text holds a turn end or something that
decodes, its role a line end), it is rendered with these four codes instead. Then the whole conversation
is parsed; if any turn differs after all, every turn is rendered in codes, in which nothing can conflict.
Everything is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import let

OPEN, CLOSE = "### ", "</turn>\n"
#: The order matters: the backslash is escaped first and decoded last.
CODES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), ("\n", "\\w")]
TURNS = "array<struct<role:string,text:string>>"


def escape(value: Column, line_ends: bool = False) -> Column:
    for plain, code in CODES if line_ends else CODES[:3]:
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def unescape(value: Column) -> Column:
    for plain, code in reversed(CODES):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, at + 1, F.length(piece))).alias("text"))

    # What follows the last turn end is empty.
    return let(F.split(formatted, CLOSE, -1), lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row (conv_id, formatted, loss_spans, n_escaped) for each conversation in ``rows``.

    Rows (conv_id, turn, role, text) are ordered by turn, then role, then text; null turns come
    first. Null roles and texts are empty ones, null conv_ids are one conversation. Repeated rows are turns
    of their own; other columns are ignored. ``loss_spans`` are the places (start, stop, in code points,
    stop exclusive) of the texts of ``loss_role`` in ``formatted``. A conversation has to fit in
    one row; its rows meet by conv_id in a partial aggregate. An empty table gives an empty result.
    """
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return _written(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), loss_role)


def _written(chats: DataFrame, loss_role: str) -> DataFrame:
    def attempt(t: Column) -> Column:
        same = let(parse(render(t["role"], t["text"])), lambda p: (F.size(p) == 1) & (F.get(p, 0)["role"] == t["role"]) & (F.get(p, 0)["text"] == t["text"]))
        return F.when(F.coalesce(same, F.lit(False)), plain(t)).otherwise(coded(t))

    def plain(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == loss_role).alias("loss"), F.lit(0).alias("coded"))

    def coded(t: Column) -> Column:
        return F.struct(escape(t["role"], True).alias("role"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss"), F.lit(1).alias("coded"))

    def join(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda t: render(t["role"], t["text"])), "")

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = chats.select("conv_id", "turns", F.transform("turns", attempt).alias("parts"))
    parts = F.when(parse(join(F.col("parts"))) == source, F.col("parts")).otherwise(F.transform("turns", coded))
    done = first.select("conv_id", parts.alias("parts"))
    step = lambda acc, t: let(
        acc["at"] + len(OPEN) + F.length(t["role"]) + 1,
        lambda a: F.struct((a + F.length(t["text"]) + len(CLOSE)).alias("at"), F.when(t["loss"], F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + F.length(t["text"])).alias("stop"))))).otherwise(acc["out"]).alias("out")),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    return done.select("conv_id", join(F.col("parts")).alias("formatted"), F.aggregate("parts", empty, step)["out"].alias("loss_spans"), F.aggregate("parts", F.lit(0), lambda n, t: n + t["coded"]).alias("n_escaped"))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, decoded, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"])))
