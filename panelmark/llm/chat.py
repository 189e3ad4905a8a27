"""Chat formatting with a finite-state machine over roles and a loss mask.

A template is data: which roles may follow which state, the strings around a
turn, and the roles whose text counts for the loss. Formatting emits segments
(text, loss); their texts joined are the formatted conversation. Inside texts
and role names the escape character and the first characters of the control
strings are replaced by two-character codes, so no control string can occur
there and reading back is exact.

All of it is SQL functions. A conversation is one record by nature: its turns
meet in one row.

Defined cases: a null text is empty, a null role is the empty role. Turns that
tie are ordered by role, then text; a null turn comes first; rows that repeat
are turns of their own. A null conv_id is a conversation. Conversations that
break the order of turns are formatted too and say so: ``valid`` is false and
``error_turn`` the number of the first wrong turn, or that after the last one
if the conversation ends too early. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``opening`` and ``closing`` surround a turn, ``head`` ends its role.

    ``moves``: state -> role -> next state; ``final``: states that may end a
    conversation. ``codes``: character -> the letter that stands for it after
    the escape character; it must list the escape character itself, the first
    character of ``opening`` and ``closing``, and that of ``head``.
    """

    opening: str = "<turn "
    head: str = ">\n"
    closing: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    codes: dict[str, str] = field(default_factory=lambda: {"\\": "b", "<": "l", ">": "g"})
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "asked", "user": "user"},
        "asked": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        firsts = {self.escape, self.opening[0], self.closing[0], self.head[0]}
        if not firsts <= set(self.codes) or len(set(self.codes.values())) < len(self.codes):
            raise ValueError("each control string needs a code of its own for its first character")
        if set(self.codes.values()) & set(self.codes):
            raise ValueError("a code must not be a character that has a code")

    def hide(self, text: Column) -> Column:
        order = [self.escape, *[c for c in self.codes if c != self.escape]]
        for c in order:
            text = F.replace(text, F.lit(c), F.lit(self.escape + self.codes[c]))
        return text

    def show(self, text: Column) -> Column:
        order = [*[c for c in self.codes if c != self.escape], self.escape]
        for c in order:
            text = F.replace(text, F.lit(self.escape + self.codes[c]), F.lit(c))
        return text


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid, error_turn."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def segments(t: Column) -> Column:
        wrap = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            wrap(F.concat(F.lit(template.opening), template.hide(t["role"]), F.lit(template.head)), no),
            wrap(template.hide(t["text"]), t["role"].isin(list(template.loss_roles))),
            wrap(F.lit(template.closing), no))

    moves = F.create_map(*[
        F.lit(x) for state, to in template.moves.items() for role, then in to.items() for x in (f"{state}\n{role}", then)])
    # the state, and the number of the first turn that the machine refuses
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("wrong"))

    def step(at: Column, role: Column) -> Column:
        then = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), role))
        return F.struct(
            F.coalesce(then, at["state"]).alias("state"), (at["n"] + 1).alias("n"),
            F.coalesce(at["wrong"], F.when(then.isNull(), at["n"])).alias("wrong"))

    ended = F.aggregate(F.transform("turns", lambda t: t["role"]), start, step)
    return (
        chats.withColumn("segments", F.flatten(F.transform("turns", segments))).withColumn("_end", ended)
        .withColumn("error_turn", F.coalesce(F.col("_end.wrong"), F.when(~F.col("_end.state").isin(list(template.final)), F.col("_end.n"))))
        .select(
            "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
            F.col("error_turn").isNull().alias("valid"), "error_turn")
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, "\\Q" + template.opening + "\\E")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.head, 1)
        start = F.char_length(role) + len(template.head) + 1
        body = F.substr(part, start, F.char_length(part) - start + 1 - len(template.closing))
        return F.struct(template.show(role).alias("role"), template.show(body).alias("text"))

    return F.transform(inner, turn)


def read_loss(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.show(s["text"])), "")
