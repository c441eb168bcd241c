"""Conversations as marked text with a loss mask, by a declarative template; SQL expressions only.

The template gives each role its marks and says whether its text carries loss; the machine's table says which role may
follow which. A control string met inside a text is broken by a backslash after its first character, and a backslash is
doubled, so marks in the output are only the template's and every text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``roles``: marks by role; other roles are written out between ``other`` and ``text_mark``.

    The first character of a mark, spaces aside, must not be met again inside any mark. ``steps`` is the machine: state
    and role to the next state; a conversation is valid if it never leaves the table and ends in ``ends``.
    """

    roles: dict[str, Turn]
    other: Turn
    text_mark: str
    steps: dict[tuple[str, str], str]
    ends: tuple[str, ...]

    def controls(self) -> list[str]:
        turns = [*self.roles.values(), self.other]
        return sorted({m.strip() for t in turns for m in (t.before, t.after)} | {self.text_mark})


BRACKETS = Template(
    roles={"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    other=Turn("[TURN]", "[/TURN]"),
    text_mark="[TEXT]",
    steps={("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    ends=("answered",),
)


def escape(text: Column, template: Template) -> Column:
    heads = "|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(text, rf"(\\|{heads})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """(conv_id, segments, formatted, valid): one row per conversation, turns in order.

    ``segments`` are (text, loss) pieces and ``formatted`` is their texts joined. ``valid`` is the machine's verdict; an
    invalid conversation is formatted like any other. Turns are ordered by turn (null first), then role and text, so
    ties and repeated rows have a fixed place. Null texts and roles are empty; a null conv_id is a conversation of its
    own. Other columns are ignored, an empty table gives an empty result. One conversation is one row of output.
    """
    empty = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    chats = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (state, role), to in template.steps.items() for x in (f"{state}>{role}", to)])
    final = F.aggregate("turns", F.lit("start"), lambda state, t: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit(">"), t.role)), F.lit("lost")))

    def pieces(t: Column) -> Column:
        def three(head: Column, tail: str, loss: bool) -> Column:
            part = lambda text, flag: F.struct(text.alias("text"), F.lit(flag).alias("loss"))
            return F.array(part(head, False), part(escape(t.text, template), loss), part(F.lit(tail), False))

        other = F.concat(F.lit(template.other.before), escape(t.role, template), F.lit(template.text_mark))
        chosen = F
        for role, marks in template.roles.items():
            chosen = chosen.when(t.role == role, three(F.lit(marks.before), marks.after, marks.loss))
        return chosen.otherwise(three(other, template.other.after, template.other.loss))

    segmented = chats.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), final.isin(*template.ends).alias("valid"))
    return segmented.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "valid")


def read_chat(formatted: Column, template: Template = BRACKETS) -> Column:
    """array<struct<role, text>>: the turns that ``formatted`` says, unescaped."""
    kinds = [*template.roles.values(), template.other]
    marked = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"{re.escape(t.before)}.*?{re.escape(t.after)}" for t in kinds)), F.lit(0))

    def turn(m: Column) -> Column:
        body = lambda t: F.substring(m, F.lit(len(t.before) + 1), F.char_length(m) - len(t.before) - len(t.after))
        said = lambda role, text: F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        inside, mark = body(template.other), template.text_mark
        read = F
        for role, t in template.roles.items():
            read = read.when(F.startswith(m, F.lit(t.before)), said(F.lit(role), body(t)))
        return read.otherwise(said(F.substring_index(inside, mark, 1), F.substring(inside, F.instr(inside, mark) + len(mark), F.char_length(inside))))

    return F.transform(marked, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
