"""Chat formatting with a grammar round trip.

Turns are marked by role: `<<SYS>>..<</SYS>>`, `[INST] .. [/INST]`, `<s>..</s>` for the
assistant, and `[ROLE=name[ROLE]..[/ROLE]` for any other role. A conversation is rendered
as it is and read back by the same deterministic parser that users of the output
have; where the turns that come back differ from the source, or a text or the name of a role
holds a control string, escaped or not, its texts are escaped and the
conversation is rendered again. Escaping puts one more backslash behind the first
character of every control string, however many stand there already, so it can be taken
back exactly, and escaped text holds no control string.

The loss mask is a list of runs over the formatted text; a run is under the mask
when it is the text of an assistant turn.

Null text and null roles count as empty. Rows of a conversation come by turn, then by
role and text, so repeated rows and equal turn numbers have a fixed order; null turn
numbers come first, and a null conv_id is a conversation of its own. An empty table gives
no rows. A conversation is one value of the result, so it is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
NAMED, NAME_END, NAMED_END = "[ROLE=", "[ROLE]", "[/ROLE]"
TAILS = r"/?INST\]|/?s>|</?SYS>>|/?ROLE\]|ROLE="
GRAMMAR = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\] .*? \[/INST\]|<s>.*?</s>|\[ROLE=.*?\[ROLE\].*?\[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\[|<)(\\*)({TAILS})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\[|<)\\(\\*)({TAILS})", "$1$2$3")


def controls(text: Column) -> Column:
    """Whether a text holds a control string, with or without backslashes behind its first character."""
    return F.regexp_like(text, F.lit(rf"(\[|<)\\*({TAILS})"))


def render_turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(NAMED), role, F.lit(NAME_END), text, F.lit(NAMED_END))
    for name, (begin, end) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
    return out


def render(turns: Column, escaped: bool) -> Column:
    """Formatted text of an array of (role, text)."""
    treat = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: render_turn(F.when(t.role.isin(list(MARKS)), t.role).otherwise(treat(t.role)), treat(t.text))), "")


def inner(piece: Column, begin: str, end: str) -> Column:
    return F.substring(piece, F.lit(len(begin) + 1), F.length(piece) - F.lit(len(begin) + len(end)))


def parse_piece(piece: Column) -> Column:
    """(role, text, open, close): content of a rendered turn, and the length of the marks around it."""
    body = inner(piece, NAMED, NAMED_END)
    at = F.instr(body, NAME_END)
    name = F.substring(body, F.lit(1), at - 1)
    rest = F.substring(body, at + F.lit(len(NAME_END)), F.length(body))

    def turn(role: Column, text: Column, begin: Column, end: str) -> Column:
        return F.struct(role.alias("role"), text.alias("text"), begin.alias("open"), F.lit(len(end)).alias("close"))

    out = turn(unescape(name), rest, F.lit(len(NAMED) + len(NAME_END)) + F.length(name), NAMED_END)
    for role, (begin, end) in MARKS.items():
        out = F.when(F.startswith(piece, F.lit(begin)), turn(F.lit(role), inner(piece, begin, end), F.lit(len(begin)), end)).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """Pieces of a formatted text as (role, text still escaped, open, close)."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(GRAMMAR), F.lit(0)), parse_piece)


def turns_of(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.struct(p.role.alias("role"), unescape(p.text).alias("text")))


def mask_of(pieces: Column) -> Column:
    """Runs of the loss mask over the formatted text, in characters."""

    def runs(p: Column) -> Column:
        parts = [(p.open, F.lit(False)), (F.length(p.text), p.role == "assistant"), (p.close, F.lit(False))]
        return F.array(*[F.struct(n.cast("long").alias("chars"), loss.alias("loss")) for n, loss in parts])

    return F.flatten(F.transform(pieces, runs))


def whole(formatted: Column, pieces: Column) -> Column:
    """Whether the parser has accounted for every character."""
    return F.length(formatted) == F.aggregate(mask_of(pieces), F.lit(0).cast("long"), lambda a, r: a + r.chars)


def format_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, turns, loss_mask, escaped, identical) of every conversation.

    `turns` is what the parser reads back from `formatted`.
    """
    rows = conversations.select(
        F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row")
    )
    grouped = rows.groupBy(conv).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    source = grouped.select(conv, F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("source"))
    tried = source.withColumn("plain", render(F.col("source"), escaped=False)).withColumn("first", parse(F.col("plain")))
    same = whole(F.col("plain"), F.col("first")) & (turns_of(F.col("first")) == F.col("source"))
    live = F.exists("source", lambda t: controls(t.text) | (~t.role.isin(list(MARKS)) & controls(t.role)))
    settled = tried.withColumn("escaped", ~same | live).withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), escaped=True)).otherwise(F.col("plain")))
    again = settled.withColumn("pieces", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("first")))
    out = again.withColumn("turns", turns_of(F.col("pieces"))).withColumn("loss_mask", mask_of(F.col("pieces")))
    identical = whole(F.col("formatted"), F.col("pieces")) & (F.col("turns") == F.col("source"))
    return out.select(conv, "formatted", "turns", "loss_mask", "escaped", identical.alias("identical"))


def masked_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t.role == "assistant"), lambda t: t.text), "")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row of counts and digests per conversation, read back from the output."""
    text = masked_text(F.col("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return formatted.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )
