"""Chat formatting as a finite-state machine over roles, in DataFrame functions alone.

A declarative template gives the markers of a turn, the roles whose text is learned, the
transitions of the machine, and the control strings. Each conversation becomes segments of text
with a loss flag; ``formatted`` is their concatenation. Control strings inside texts are
escaped reversibly: the escape sign itself first, then each control string by a code letter
(after the sign there is always a code, so reading back has one result).

Defined results: a null text or role is empty; a conversation whose turns break the machine is
still formatted, with ``valid`` false and the first offending position in ``bad_turn``; turns
are ordered by (turn, role, text), null turns first, repeated rows kept; rows with a null
conv_id form one conversation; an empty table gives an empty result; further columns are
ignored. One conversation is one row by definition, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESC = "␛"


@dataclass(frozen=True)
class Template:
    """What marks a turn, what is learned, and which role may follow which."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> roles that may come next; a role's name is the state after it.
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
    )
    final: tuple[str, ...] = ("assistant",)
    # Control strings of common chat templates, which no text may contain unescaped.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    def codes(self) -> list[tuple[str, str]]:
        """(plain, escaped) pairs in the order of escaping: the sign first."""
        return [(ESC, ESC + "0"), *((c, ESC + chr(ord("a") + i)) for i, c in enumerate(self.controls))]


def escape(text: Column, template: Template) -> Column:
    for plain, code in template.codes():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    for plain, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit(template.after_role), F.lit(ESC + "2"))


def unescape_role(role: Column, template: Template) -> Column:
    return unescape(F.replace(role, F.lit(ESC + "2"), F.lit(template.after_role)), template)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, segments (text, loss), valid, bad_turn (0-based, null where valid)."""
    escaped = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = escaped.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    steps = F.create_map(*(F.lit(x) for pair in ((f"{a}\0{b}", b) for a, to in template.transitions.items() for b in to) for x in pair))
    machine = F.aggregate(
        "turns",
        F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda acc, t: F.struct(
            F.coalesce(F.try_element_at(steps, F.concat(acc["state"], F.lit("\0"), t["role"])), t["role"]).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNotNull(), acc["bad"]).when(F.try_element_at(steps, F.concat(acc["state"], F.lit("\0"), t["role"])).isNull(), acc["at"]).alias("bad"),
        ),
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.open), escape_role(t["role"], template), F.lit(template.after_role)), F.lit(False)),
                segment(escape(t["text"], template), t["role"].isin(*template.learned)),
                segment(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    out = grouped.select("conv_id", segments.alias("segments"), machine.alias("m"))
    return out.select(
        "conv_id",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        (F.col("m.bad").isNull() & F.col("m.state").isin(*template.final)).alias("valid"),
        F.coalesce(F.col("m.bad"), F.when(~F.col("m.state").isin(*template.final), F.col("m.at"))).cast("bigint").alias("bad_turn"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role, text) parsed from the formatted text, its loss_text, both unescaped, and the machine's verdict.

    The loss text is cut from the formatted text too: of each block the text, where the mask has its segment learned.
    """
    blocks = F.filter(F.split("formatted", "\\Q" + template.close + "\\E"), lambda b: b != "")

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(template.open) + 1))
        role = F.substring_index(body, template.after_role, 1)
        text = F.substr(body, F.length(role) + len(template.after_role) + 1)
        return F.struct(unescape_role(role, template).alias("role"), unescape(text, template).alias("text"))

    learned = F.transform(blocks, lambda b, i: F.when(F.get("segments", 3 * i + 1)["loss"], turn(b)["text"]).otherwise(""))
    return formatted.select(
        "conv_id",
        F.transform(blocks, turn).alias("turns"),
        F.array_join(learned, "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
