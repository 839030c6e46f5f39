"""Chat formatting: typed content parts become one text with placeholders, attachment references and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions.rows import let

# fixed values: the marks of the template and the control strings that texts may not contain unescaped
TURN, ROLE_END, TURN_END = "<|turn|>", "<|says|>", "<|end|>"
_CONTROL = r"\||/?s>|/?INST\]|/?SYS>>"  # what follows "<" or "[" in <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>

PARTS = "array<struct<kind string, text string, ref string, units long>>"
#: Tokens that a placeholder stands for, per unit of its attachment (image tiles, audio seconds, document pages).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

#: Code points of the pieces in which a long text is read by position.
PIECE = 1024


def escape(text: Column) -> Column:
    """One backslash more after each "<" or "[" that begins a control string, counting those already there."""
    return F.regexp_replace(text, rf"([<\[])(?=\\*(?:{_CONTROL}))", r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, rf"([<\[])\\(?=\\*(?:{_CONTROL}))", "$1")


def flattened(parts: Column) -> tuple[Column, Column]:
    """Typed parts in order as escaped text with placeholders, and their attachments (kind, ref, tokens).

    Text parts give their escaped text; image, audio and document parts a placeholder of
    their kind and a reference with the tokens it expands to. A null array or part, and null
    text, count as empty; unknown kinds give a placeholder and no tokens.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())

    def is_text(p):
        return F.coalesce(p["kind"], F.lit("text")) == "text"

    def visit(p):
        mark = F.concat(F.lit("<|part:"), F.regexp_replace(p["kind"], "[^a-z]", ""), F.lit("|>"))
        return F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)

    def attached(p):
        per_unit = F.lit(0)
        for kind, n in TOKENS_PER_UNIT.items():
            per_unit = F.when(p["kind"] == kind, n).otherwise(per_unit)
        tokens = (per_unit * F.coalesce(p["units"], F.lit(1))).cast("long")
        return F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))

    return F.array_join(F.transform(parts, visit), ""), F.transform(F.filter(parts, lambda p: ~is_text(p)), attached)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to one row per conversation: conv_id, n_turns, formatted, mask, attachments.

    A turn is written as its mark, the role, a mark, the flattened parts and an end mark, without
    anything between; control strings inside roles and texts are escaped. ``mask`` has the code
    point ranges (start from 0, length) that carry loss: the content of each assistant turn,
    in order. Turns come by ``turn``, null first; equal turns in order of role and content, so
    repeated rows stay. Null role and null parts count as empty. A conversation is one row, as its
    result is one text; a null conv_id is a conversation of its own.
    """
    content, attachments = flattened(F.col("parts"))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attachments.alias("attachments"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE_END))
    rows = rows.select(
        "*", head.alias("head"), F.length(head).cast("long").alias("skip"), F.length("content").cast("long").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("skip") + F.col("size") + len(TURN_END)).over(before), F.lit(0))
    rows = rows.withColumn("at", at).select(
        "conv_id", F.struct("turn", "role", "content", "attachments", "at", "head", "skip", "size").alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    body = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["content"], F.lit(TURN_END))), "")
    mask = F.transform(
        F.filter("ts", lambda t: t["role"] == "assistant"),
        lambda t: F.struct((t["at"] + t["skip"]).alias("start"), t["size"].alias("length")))
    return chats.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), body.alias("formatted"), mask.alias("mask"),
        F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"))


def parsed(formatted: Column) -> Column:
    """Turns (role, content) of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), r"<\|says\|>"))
    return F.transform(turns, lambda t: F.struct(unescape(F.get(t, 0)).alias("role"), unescape(F.get(t, 1)).alias("content")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another.

    The text is cut into pieces of equal length once, and a range is read from the pieces it
    touches, so that the cost stays linear however many turns there are.
    """
    pieces = F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0))

    def read(ps, m):
        first, last = F.floor(m["start"] / PIECE).cast("int"), F.floor((m["start"] + m["length"]) / PIECE).cast("int")
        near = F.array_join(F.slice(ps, first + 1, last - first + 1), "")
        return unescape(F.substring(near, (m["start"] % PIECE + 1).cast("int"), m["length"].cast("int")))

    return let(pieces, lambda ps: F.array_join(F.transform(mask, lambda m: read(ps, m)), ""))


def text_parts(text: Column) -> Column:
    """A plain text as a single typed part."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("units")))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Also expanded_tokens: what the attachments expand to (0 for texts only).
    """
    turns = conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    chats = format_chats(turns)
    back = chats.withColumns({"turns": parsed(F.col("formatted")), "loss": under_mask(F.col("formatted"), F.col("mask"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.coalesce(F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]), F.lit(0)).alias("expanded_tokens"))
