r"""Operator 9: chat formatting with a role automaton and a declarative template.

Method. A finite-state machine over the roles of a conversation, compiled into
one CASE expression, validates the order of turns. A template (marks around each
turn, the roles whose text carries loss) is compiled into an array of text
segments with a loss flag each; their concatenation is the formatted text.
Built-in functions only.

Control strings inside texts are escaped reversibly: ``\`` -> ``\0``, ``<`` ->
``\1``, ``#`` -> ``\2`` (and ``:`` -> ``\3`` in roles), so no mark of the template
can occur in an escaped text, and reading back is a plain split.

Defined cases: null texts and roles count as empty; turns are ordered by (turn,
role, text), so ties have one order, and repeated rows stay; a null conv_id is a
conversation of its own; an unknown role is formatted, without loss, and makes
the order invalid; other columns are not read. A conversation's text is one value
and so is put together in one task.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("#", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"))


class Template(NamedTuple):
    """open + role + mid + text + close for each turn; loss on the texts of loss_roles."""

    open: str = "### "
    mid: str = ": "
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)


#: state, role -> state; every other role in a state is an error. Accepting: ACCEPT.
TRANSITIONS = {
    ("start", "system"): "ready",
    ("start", "user"): "asked",
    ("ready", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
ACCEPT = ("answered",)


def _replace(text: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _replace(text, pairs)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return _replace(text, [(b, a) for a, b in reversed(pairs)])


def valid_order(roles: Column) -> Column:
    """Whether the automaton accepts an array of roles."""

    def step(state: Column, role: Column) -> Column:
        to = F.lit("error")
        for (a, r), b in TRANSITIONS.items():
            to = F.when((state == a) & (role == r), F.lit(b)).otherwise(to)
        return to

    return F.aggregate(roles, F.lit("start"), step).isin(*ACCEPT)


def segments(turns: Column, template: Template) -> Column:
    """array<struct<text, loss>> of an array of (turn, role, text)."""

    def of_turn(x: Column) -> Column:
        mark = F.concat(F.lit(template.open), escape(x["role"], ROLE_ESCAPES), F.lit(template.mid))
        parts = [(mark, F.lit(False)), (escape(x["text"]), x["role"].isin(*template.loss_roles)), (F.lit(template.close), F.lit(False))]
        return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts])

    return F.flatten(F.transform(turns, of_turn))


def format_chats(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row per conversation: (conv_col, valid, segments, formatted)."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    got = df.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    got = got.select(conv_col, valid_order(F.col("turns")["role"]).alias("valid"), segments(F.col("turns"), template).alias("segments"))
    return got.withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """array<struct<role, text>> read back from a formatted text."""
    pieces = F.split(formatted, template.close)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def of_piece(x: Column) -> Column:
        body = F.substr(x, F.lit(len(template.open) + 1))
        at = F.instr(body, template.mid)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(template.mid))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, of_piece)


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(parts, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
