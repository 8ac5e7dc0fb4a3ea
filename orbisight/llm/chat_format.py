"""Conversations as one text each with a loss mask, by Spark expressions only, and read back from that text.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one block, and blocks are
joined: ``<turn role>text<next>text</turn>`` and a line break.  In texts a backslash is put after the ``<`` of whatever
looks like a mark, escaped ones included, so every text comes back as it was and no other text changes; in roles the four
characters that matter are replaced.  The loss mask lists where the texts of the roles to learn lie, as they are escaped.

Edge cases: null text is empty, null role too; turns sort by (turn, role, text), null first, so ties have one order; repeated
rows are turns of their own; rows without a conv_id are one conversation; an empty table gives no conversation; other
columns are ignored, also if their names clash.  Arrays are bound once by a lambda, so nothing is sorted or copied again for
each element, and a conversation takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ._common import by_place, place
from .pii import running

#: The characters of a role that would end or hide a mark, and what stands for them.
ROLE_MARKS = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n"))
_ANY = r"<(\\*+)(/?turn|next)"
_HIDDEN = r"<\\(\\*+)(/?turn|next)"
_SPAN = "struct<start:int,end:int>"


def escaped(text: Column) -> Column:
    """The text without anything that looks like a mark."""
    return F.regexp_replace(text, F.lit(_ANY), F.lit(r"<\\$1$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_HIDDEN), F.lit("<$1$2"))


def escaped_role(role: Column) -> Column:
    for plain, told in ROLE_MARKS:
        role = F.replace(role, F.lit(plain), F.lit(told))
    return role


def unescaped_role(role: Column) -> Column:
    for plain, told in reversed(ROLE_MARKS):
        role = F.replace(role, F.lit(told), F.lit(plain))
    return role


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed one time."""
    return F.transform(F.array(value), use)[0]


def blocks(turns: Column) -> Column:
    """Sorted turns as (role, texts): adjacent turns of one role are one."""

    def made(turns: Column) -> Column:
        opens = lambda k: (k == 0) | (turns[k]["role"] != turns[F.greatest(k - 1, F.lit(0))]["role"])
        starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), opens)
        return once(F.struct(starts.alias("starts"), F.array_append(F.slice(starts, 2, F.size(turns)), F.size(turns)).alias("ends")), ranges(turns))

    def ranges(turns: Column) -> Callable[[Column], Column]:
        one = lambda x: F.struct(turns[x["starts"]]["role"].alias("role"), F.transform(F.slice(turns, x["starts"] + 1, x["ends"] - x["starts"]), lambda t: t["text"]).alias("texts"))
        return lambda both: F.transform(F.arrays_zip(both["starts"], both["ends"]), one)

    return once(turns, made)


def pieces(block: Column, learned: tuple[str, ...]) -> Column:
    """A block as its marks and texts in order, each with whether the loss sees it."""
    mark = lambda t: F.struct(t.alias("text"), F.lit(False).alias("loss"))
    said = F.transform(block["texts"], lambda t: F.struct(escaped(t).alias("text"), block["role"].isin(*learned).alias("loss")))
    told = F.flatten(F.transform(said, lambda s: F.array(mark(F.lit("<next>")), s)))
    head = mark(F.concat(F.lit("<turn "), escaped_role(block["role"]), F.lit(">")))
    return F.concat(F.array(head), F.slice(told, F.lit(2), F.size(told)), F.array(mark(F.lit("</turn>\n"))))


def _spans(parts: Column) -> Column:
    def step(at: Column, part: Column) -> tuple[Column, Column]:
        end = at + F.length(part["text"])
        return end, F.when(part["loss"], F.struct(at.alias("start"), end.alias("end")))

    return running(parts, _SPAN, step)


def format_conversations(rows: DataFrame, learned: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and loss (start, end in code points, end exclusive) of every conversation."""
    of = lambda name: F.col(place(rows, name))
    said = lambda name: F.coalesce(of(name).cast("string"), F.lit(""))
    each = by_place(rows).select(of(conv_id).alias("conv_id"), F.struct(of(turn).alias("turn"), said(role).alias("role"), said(text).alias("text")).alias("t"))
    sorted_ = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.flatten(F.transform(blocks(F.col("turns")), lambda b: pieces(b, learned)))
    made = once(parts, lambda parts: F.struct(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("formatted"), _spans(parts).alias("loss")))
    return sorted_.select("conv_id", made.alias("made")).select("conv_id", "made.*")


def turns_of(formatted: Column) -> Column:
    """(role, text) of every turn, read from the formatted text alone."""
    blocks = F.filter(F.split(formatted, F.lit(r"</turn>\n"), -1), lambda b: b != "")

    def one(block: Column) -> Column:
        end = F.instr(block, F.lit(">"))
        role = unescaped_role(F.substring(block, F.lit(len("<turn ") + 1), end - F.lit(len("<turn ") + 1)))
        texts = F.split(F.substring(block, end + 1, F.length(block)), F.lit("<next>"), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, one))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """What lies under the mask, piece by piece and unescaped; cut from UTF-32, where a place needs no search."""
    cut = lambda wide: F.transform(loss, lambda s: unescaped(F.decode(F.substring(wide, s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32")))
    return once(F.encode(formatted, "UTF-32"), cut)
