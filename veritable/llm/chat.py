"""Chat formatting: a finite-state machine over roles and a declarative template.

`TEMPLATE` names, per role, the marks around a turn's text and whether the text counts for the loss;
`NEXT` is the machine: which role may follow which. `format_turns` gives one row per turn with its
segments (text, loss flag). `conversations` joins the turns of a conversation and runs the machine.

Control strings inside a text get a backslash after their first character, one more if such already
follow it, so no mark can occur within a text and `read_back` restores every text exactly.

Turns are put together in two levels: first spans of `SPAN` turn numbers, whose effect on the
machine is a state-to-state table, then the spans. So the turns of a long conversation are ordered
and checked in many tasks; the last level holds one short row per span. (A digest of a whole
conversation, which the query asks for, still needs its text in one row.)

Defined results: a null text is empty; a null role is the empty role; roles out of the template get
the marks of `OTHER` with the role's name inside and no loss; rows of one turn number go by role and
formatted text; a null turn comes first; equal rows stay; null conversation ids form one conversation; turns
that break the order are formatted like others and the conversation is marked as not valid.
Only DataFrame operations are used. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (mark before, mark after, counts for the loss)
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role: mark, the role's name, mark, text, mark.
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", *OTHER)

#: state -> role -> state. Every state but START and BROKEN is the role that came last.
NEXT = {
    "START": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
    "BROKEN": {},
}
STATES = list(NEXT)
SPAN = 64


#: First character -> pattern of what follows it in a control string.
_ESCAPE = [(first, "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first)) for first in sorted({c[0] for c in CONTROL})]


def escape(text: Column) -> Column:
    for first, rests in _ESCAPE:
        text = F.regexp_replace(text, rf"({re.escape(first)}\\*)(?=(?:{rests}))", "$1\\\\")
    return text


def unescape(text: Column) -> Column:
    for first, rests in _ESCAPE:
        text = F.regexp_replace(text, rf"({re.escape(first)}\\*)\\(?=(?:{rests}))", "$1")
    return text


def _by_role(role: Column, known, other: Column) -> Column:
    value = F
    for name in TEMPLATE:
        value = value.when(role == name, known(name))
    return value.otherwise(other)


def segments(role: Column, text: Column) -> Column:
    """array<struct<text, loss>> of one turn."""

    def known(name: str) -> Column:
        before, after, loss = TEMPLATE[name]
        return F.array(
            F.struct(F.lit(before).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(text).alias("text"), F.lit(loss).alias("loss")),
            F.struct(F.lit(after).alias("text"), F.lit(False).alias("loss")),
        )

    other = F.array(
        F.struct(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(text).alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(OTHER[2]).alias("text"), F.lit(False).alias("loss")),
    )
    return _by_role(role, known, other)


def format_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per row: conv_id, turn, role and `segments`."""
    plain = turns.select(
        turns[conversation].alias("conv_id"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text].cast("string"), F.lit("")).alias("body"),
    )
    return plain.select("conv_id", "turn", "role", segments(F.col("role"), F.col("body")).alias("segments"))


def _step(states: Column, role: Column) -> Column:
    """States that `role` leads to, for an array of states."""
    broken = STATES.index("BROKEN")

    def row(name: str) -> Column:
        return F.array(*[F.lit(STATES.index(NEXT[s].get(name, "BROKEN"))) for s in STATES])

    table = _by_role(role, row, F.array(*[F.lit(broken)] * len(STATES)))
    return F.transform(states, lambda s: F.get(table, s))


def conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation: n_turns, `formatted`, the machine's last `state`, and `valid`."""
    piece = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    span = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62))).cast("long")
    start = F.array(*[F.lit(i) for i in range(len(STATES))])
    spans = (
        formatted.select("conv_id", span.alias("span"), F.struct("turn", "role", piece.alias("piece")).alias("row"))
        .groupBy("conv_id", "span")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select(
            "conv_id",
            F.struct(
                "span",
                F.size("rows").cast("long").alias("n"),
                F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("text"),
                F.aggregate("rows", start, lambda states, r: _step(states, r["role"])).alias("leads"),
            ).alias("part"),
        )
    )
    state = F.aggregate("parts", F.lit(0), lambda s, p: F.get(p["leads"], s))
    name = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("at") + 1)
    return (
        spans.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select(
            "conv_id",
            F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
            state.alias("at"),
        )
        .select("conv_id", "n_turns", "formatted", name.alias("state"), (name != "BROKEN").alias("valid"))
    )


def _pattern() -> str:
    parts = [rf"{re.escape(a)}(.*?){re.escape(b)}" for a, b, _ in TEMPLATE.values()]
    other = "(.*?)".join(map(re.escape, OTHER))
    return "(?s)" + "|".join([*parts, other])


def read_back(formatted: Column) -> Column:
    """array<struct<role, text, loss>> of the turns that a formatted conversation holds."""

    def turn(piece: Column) -> Column:
        value = F
        for name, (before, after, loss) in TEMPLATE.items():
            inner = F.substring(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))
            found = F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"), F.lit(loss).alias("loss"))
            value = value.when(F.startswith(piece, F.lit(before)), found)
        parts = F.split(F.substring(piece, F.lit(len(OTHER[0]) + 1), F.length(piece) - len(OTHER[0]) - len(OTHER[2])), re.escape(OTHER[1]), 2)
        return value.otherwise(
            F.struct(
                unescape(F.get(parts, F.lit(0))).alias("role"),
                unescape(F.get(parts, F.lit(1))).alias("text"),
                F.lit(False).alias("loss"),
            )
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_pattern()), 0), turn)
