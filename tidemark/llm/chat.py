"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A turn becomes three segments: a head and a foot, which are never learnt from, and a body, which carries the template's
loss flag of its role. Inside texts and roles a backslash follows each character that control strings begin or end with,
and each backslash, so that no control string is left in them; reading a formatted conversation back undoes it.

Defined results: turns are ordered by turn (null first), then role and text, so that repeated turns have an order; null
texts and roles are empty; a null conversation id is a conversation of its own; roles that the template does not know are formatted, carry
no loss and make the conversation invalid; an empty table gives an empty result; other columns are never read.

A conversation is one output row, which its digests need as a whole; rows are combined by task before they are
exchanged, so one conversation costs its own text, however many others there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles are learnt from, and which role may follow which."""

    head: str = "### {role}: "
    foot: str = "</turn>\n"
    #: The characters that tell head and foot from a text, and the backslash, as a character class. Head and foot begin with one
    #: and the part after the role does too; a foot that ends a text needs none of its own there.
    escaped: str = r"[\\#<:]"
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> {role: next state}
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)


TEMPLATE = Template()
_FAILED = "failed"


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, f"({template.escaped})", r"$1\\")


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"({template.escaped})\\", "$1")


def _final_state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles, in one pass; it stays in failed once a role does not fit."""
    table = F.create_map(*[F.lit(x) for s, row in template.machine.items() for r, t in row.items() for x in (f"{s}\n{r}", t)])
    return F.aggregate(
        roles, F.lit(template.start), lambda state, role: F.coalesce(F.try_element_at(table, F.concat_ws("\n", state, role)), F.lit(_FAILED))
    )


def formatted(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """A row for each conversation: conv_id, segments (text, loss), formatted, valid."""
    empty = F.lit("")
    turns = rows.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce(F.col("role").cast("string"), empty).alias("role"),
            F.coalesce(F.col("text").cast("string"), empty).alias("text"),
        ).alias("t"),
    )
    before, after = template.head.split("{role}")
    shaped = (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.flatten(
                F.transform(
                    "turns",
                    lambda t: F.array(
                        F.struct(F.concat(F.lit(before), escape(t["role"], template), F.lit(after)).alias("text"), F.lit(False).alias("loss")),
                        F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.learnt).alias("loss")),
                        F.struct(F.lit(template.foot).alias("text"), F.lit(False).alias("loss")),
                    ),
                )
            ).alias("segments"),
            _final_state(F.transform("turns", lambda t: t["role"]), template).isin(*template.final).alias("valid"),
        )
    )
    return shaped.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(output: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``output`` of formatted() with the turns (role, text) and the learnt text found in it."""
    # in a role or text each escaped character has a backslash after it; in head and foot it has none
    chars = template.escaped[1:-1]
    own = rf"((?:[^{chars}]++|[{chars}]\\)*+)"
    before, after = template.head.split("{role}")
    quoted = lambda s: "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in s)
    turn = quoted(before) + own + quoted(after) + own + quoted(template.foot)
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    part = lambda k: F.regexp_extract_all("formatted", F.lit(turn), F.lit(k))
    turns = F.zip_with(part(1), part(2), lambda r, t: F.struct(unescape(r, template).alias("role"), unescape(t, template).alias("text")))
    return output.withColumns({"turns": turns, "learnt": F.array_join(learnt, "")})


def report(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    found = read_back(formatted(rows, template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
