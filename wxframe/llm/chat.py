"""Chat formatting with a declarative template and a finite-state machine over roles.

All work is DataFrame expressions.  A conversation is formatted in parts of at most
``part_turns`` consecutive turn numbers, so a very long one is spread over many tasks;
part strings joined in order are the formatted conversation.  The machine's state is
the last role seen, so a part is summed up by its first and last role and whether all
steps inside it are allowed; parts are then chained (:func:`validate`).

Control strings inside texts are escaped by one backslash behind their first sign
(``[INST]`` becomes ``[\\INST]``, ``[\\INST]`` becomes ``[\\\\INST]``), which
:func:`unescape` takes back exactly.  Every control string holds ``[`` or ``<`` at its
start only, so none can arise where a text meets a marker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256


@dataclass(frozen=True)
class Turn:
    """How one role is written: control string before and after the text, and whether the text is trained on."""
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, how a role that is not listed is written (its name, then its text), and the machine's steps.

    ``steps`` maps a role to the roles that may follow it; the key ``None`` is the start, and ``ends`` are the
    roles a conversation may end with."""
    turns: dict = field(default_factory=lambda: {
        "system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True), "tool": Turn("[TOOL]", "[/TOOL]")})
    other: tuple = ("[ROLE]", "[SEP]", "[/ROLE]")
    steps: dict = field(default_factory=lambda: {
        None: ["system", "user"], "system": ["user"], "user": ["assistant"],
        "assistant": ["user", "tool"], "tool": ["assistant"]})
    ends: tuple = ("assistant",)

    def controls(self) -> list[str]:
        out = [c for t in self.turns.values() for c in (t.before, t.after)] + list(self.other)
        if any(not re.fullmatch(r"[\[<][^\[<\\]+", c) for c in out) or len(set(out)) < len(out):
            raise ValueError("control strings start with [ or <, hold neither again nor a backslash, and differ")
        return out

    def tails(self) -> str:
        return "|".join(re.escape(c[1:]) for c in self.controls())


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)({template.tails()})", r"$1\\$2$3")


def unescape(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({template.tails()})", "$1$2$3")


def _segments(role: Column, text: Column, template: Template) -> Column:
    """The segments of one turn: marker, text, marker, each with its loss flag."""
    piece = lambda s, loss=False: F.struct((F.lit(s) if isinstance(s, str) else s).alias("text"),
                                           F.lit(loss).alias("loss"))
    out = F.array(piece(template.other[0]), piece(escape(role, template)), piece(template.other[1]),
                  piece(escape(text, template)), piece(template.other[2]))
    for name, t in template.turns.items():
        out = F.when(role == name, F.array(piece(t.before), piece(escape(text, template), t.loss), piece(t.after))) \
            .otherwise(out)
    return out


def _allowed(last: Column, role: Column, template: Template) -> Column:
    """Whether the machine may step from role ``last`` (null: the start) to ``role``."""
    ok = F.lit(False)
    for state, after in template.steps.items():
        here = last.isNull() if state is None else last.eqNullSafe(F.lit(state))
        ok = ok | (here & role.isin(after))
    return ok


def format_chats(chats: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation and part: conv_id, part, n_turns, segments (text, loss), formatted,
    first_role, last_role, steps_ok (every step inside the part is allowed).

    Turns are ordered by number (null first), then role, then text; repeated rows are repeated turns.  A null role
    is the empty role, a null text the empty text, a null conversation id a conversation of its own.  An empty table
    gives no rows; columns not named here are not read.
    """
    rows = chats.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.floor(F.col("turn") / F.lit(part_turns)).cast("long")
    turns = rows.groupBy("conv_id", part.alias("part")) \
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    inside = F.forall(F.sequence(F.lit(1), F.size("turns")), lambda k: (k == 1) | _allowed(
        F.get("roles", k - 2), F.get("roles", k - 1), template))
    return turns.withColumn("roles", roles).select(
        "conv_id", "part", F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template))).alias("segments"),
        F.get("roles", F.lit(0)).alias("first_role"), F.element_at("roles", -1).alias("last_role"),
        inside.alias("steps_ok")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def validate(parts: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation: conv_id, n_turns, valid (from the start through allowed steps to an allowed end)."""
    chain = parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("part", "first_role", "last_role", "steps_ok"))).alias("p"))
    joints = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda k: _allowed(
        F.when(k > 0, F.get("p", k - 1)["last_role"]), F.get("p", k)["first_role"], template))
    valid = joints & F.forall("p", lambda x: x["steps_ok"]) & F.element_at("p", -1)["last_role"].isin(*template.ends)
    return chain.select("conv_id", "n_turns", valid.alias("valid"))


def joined(parts: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted (its parts in order)."""
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "formatted"))).alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["formatted"]), "").alias("formatted"))


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted string: array of (role, text, loss), texts unescaped."""
    name, sep, end = map(re.escape, template.other)
    kinds = "|".join(f"{re.escape(t.before)}(?:.*?){re.escape(t.after)}" for t in template.turns.values())
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s){kinds}|{name}(?:.*?){sep}(?:.*?){end}"), F.lit(0))

    def turn(piece: Column) -> Column:
        """Role, text and loss of one written turn."""
        made = lambda role, text, loss: F.struct(
            role.alias("role"), unescape(text, template).alias("text"), F.lit(loss).alias("loss"))
        within = lambda s, before, after: F.substr(
            s, F.lit(len(before) + 1), F.char_length(s) - len(before) - len(after))
        inner = within(piece, template.other[0], template.other[2])
        cut = F.instr(inner, template.other[1])
        out = made(unescape(F.substr(inner, F.lit(1), cut - 1), template),
                   F.substr(inner, cut + len(template.other[1])), False)
        for role, t in template.turns.items():
            out = F.when(F.startswith(piece, F.lit(t.before)), made(F.lit(role), within(piece, t.before, t.after), t.loss)) \
                .otherwise(out)
        return out

    return F.transform(pieces, turn)
