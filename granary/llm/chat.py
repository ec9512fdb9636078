"""Chat formatting: a declarative template, a role automaton and loss flags per segment.

Everything is built-in functions over one aggregation by conversation; a conversation is the unit of
output, so its turns meet in one row. Turns are taken by (turn, role, text) with nulls first, so ties and
repeated rows have a fixed order. Null roles and texts count as empty; a null conv_id is a conversation
of its own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let

#: States by the last role seen: which roles may follow.
TURNS = {
    "start": ("system", "user"),
    "system": ("user",),
    "user": ("assistant",),
    "assistant": ("user",),
}


@dataclass(frozen=True)
class ChatTemplate:
    """open + role + after_role + text + close for each turn; texts of the loss roles carry loss."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    guard: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict = field(default_factory=lambda: TURNS)
    may_end: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        r"""No guard string is left in the result. Each \ of it is followed by b, n or |, so that unescape is exact."""
        text = F.replace(text, F.lit("\\"), F.lit("\\b"))
        return F.replace(text, F.lit(self.guard), F.lit(self.guard[0] + "\\" + self.guard[1:]))

    def unescape(self, text: Column) -> Column:
        text = F.replace(text, F.lit(self.guard[0] + "\\" + self.guard[1:]), F.lit(self.guard))
        return F.replace(text, F.lit("\\b"), F.lit("\\"))

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\n"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def first_bad_turn(turns: Column, template: ChatTemplate) -> Column:
    """Runs the automaton: 0-based place of the first turn whose role may not come there, the number of turns if only the end is wrong, null if valid."""
    state = F.struct(F.lit("start").alias("last"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("i"))

    def step(s: Column, t: Column) -> Column:
        allowed = F.lit(False)
        for last, roles in template.turns.items():
            allowed = allowed | ((s["last"] == last) & t["role"].isin(*roles))
        return F.struct(t["role"].alias("last"), F.when(s["bad"].isNull() & ~allowed, s["i"]).otherwise(s["bad"]).alias("bad"), (s["i"] + 1).alias("i"))

    return let(F.aggregate(turns, state, step), lambda s: F.when(s["bad"].isNotNull(), s["bad"]).when(~s["last"].isin(*template.may_end), s["i"]))


def format_chats(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted, valid, first_bad_turn."""
    template = template or ChatTemplate()
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            F.col("turns"),
            lambda t: F.array(
                seg(F.concat(F.lit(template.open), template.escape_role(t["role"]), F.lit(template.after_role)), F.lit(False)),
                seg(template.escape(t["text"]), t["role"].isin(*template.loss_roles)),
                seg(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    return convs.select("conv_id", segments.alias("segments"), first_bad_turn(F.col("turns"), template).alias("first_bad_turn")).select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("first_bad_turn").isNull().alias("valid"),
        "first_bad_turn",
    )


def parse_chats(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    template = template or ChatTemplate()
    quoted = "\\Q" + template.open + "\\E"
    parts = F.slice(F.split(formatted, quoted, -1), 2, 2**31 - 1 - 2)

    def one(p: Column) -> Column:
        at = F.instr(p, template.after_role)
        body = F.substr(p, at + len(template.after_role), F.length(p) - at - len(template.after_role) - len(template.close) + 1)
        return F.struct(template.unescape_role(F.substr(p, F.lit(1), at - 1)).alias("role"), template.unescape(body).alias("text"))

    return F.transform(parts, one)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    template = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
