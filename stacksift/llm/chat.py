"""Chat formatting of typed content parts, with DataFrame functions only.

A turn has a role and an array of typed parts. The visitor walks the parts in order: text
is escaped, after neighbouring text parts are joined, and an image, audio or document part becomes a placeholder that names its kind
and its place in the turn. The reference of each attachment and the number of tokens that
its placeholder expands to are recorded next to the formatted text.

The template marks a turn as ``<|turn|>role<|body|>text<|end|>``. Control strings inside
texts get one ``~`` after their first character, also those that have some already, so that
the escape can be undone exactly and no text holds a control string. Spans of the loss mask
are kept per turn: the number of the turn, and start and length inside its segment.

Turns of a conversation are ordered by (turn, role, segment), nulls first. A null role,
text or array of parts counts as empty; null conversation ids form one conversation. One
conversation is one output row, so its whole text must fit into one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of this and of other common templates: <|..., <s>, </s>, [INST], [/INST].
_REST = r"(/?s>|\||/?INST\])"


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for."""

    patch: int = 14
    audio_per_second: int = 25
    per_page: int = 256
    least: int = 1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + _REST, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + _REST, "$1$2$3")


def text_part(text: Column) -> Column:
    """A plain text as an array of one typed part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def expanded_tokens(part: Column, rule: Expansion = Expansion()) -> Column:
    """Tokens of an attachment: image patches, seconds of audio, pages; at least ``least``."""

    def sides(name: str) -> Column:
        return F.ceil(F.coalesce(part[name], F.lit(0)) / rule.patch)

    kind = part["type"]
    tokens = F.when(kind == "image", sides("width") * sides("height"))
    tokens = tokens.when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * rule.audio_per_second))
    tokens = tokens.otherwise(F.coalesce(part["pages"], F.lit(0)) * rule.per_page)
    return F.greatest(tokens.cast("long"), F.lit(rule.least).cast("long"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _merged(parts: Column) -> Column:
    """Parts as (mark, part, text), with neighbouring texts in one; ``mark`` is the kind of an attachment."""
    numbered = F.transform(
        parts,
        lambda p, i: F.struct(
            F.when(~_is_text(p), p["type"]).alias("mark"), i.alias("part"),
            F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise("").alias("text"),
        ),
    )
    none = F.array().cast("array<struct<mark:string,part:int,text:string>>")

    def visit(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = p["mark"].isNull() & (F.size(done) > 0) & last["mark"].isNull()
        both = F.struct(last["mark"].alias("mark"), last["part"].alias("part"), F.concat(last["text"], p["text"]).alias("text"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(numbered, none, visit)


def visit_parts(parts: Column, rule: Expansion = Expansion()) -> tuple[Column, Column]:
    """The body of a turn, and its attachments as (part, type, ref, tokens)."""
    # Neighbouring texts are one text before it is escaped: a control string may begin in one and end in the next.
    flat = F.transform(
        _merged(parts),
        lambda p: F.when(p["mark"].isNull(), escape(p["text"])).otherwise(
            F.concat(F.lit("<|"), escape(p["mark"]), F.lit(":"), p["part"].cast("string"), F.lit("|>"))
        ),
    )
    numbered = F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p, rule).alias("tokens")
        ),
    )
    attached = F.filter(numbered, lambda a: F.coalesce(a["type"], F.lit("text")) != "text")
    return F.coalesce(F.array_join(flat, ""), F.lit("")), attached


def format_chat(turns: DataFrame, rule: Expansion = Expansion(), loss_role: str = "assistant") -> DataFrame:
    """Conversations out of (conv_id, turn, role, parts).

    Returns conv_id, formatted, ``loss`` array<(turn, start, length)>, ``attachments``
    array<(turn, part, type, ref, tokens)> and expanded_tokens, their sum.
    """
    body, attached = visit_parts(F.col("parts"), rule)
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(BODY))
    segments = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn"), role.alias("role"), F.concat(head, body, F.lit(END)).alias("segment"),
            F.char_length(head).alias("start"), F.char_length(body).alias("length"),
            F.coalesce(attached, F.array().cast("array<struct<part:int,type:string,ref:string,tokens:bigint>>")).alias("attached"),
        ).alias("t"),
    )
    ordered = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = F.transform(
        F.col("ts"), lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["role"].alias("role"))
    )
    loss = F.transform(
        F.filter(spans, lambda s: s["role"] == loss_role), lambda s: F.struct(s["turn"], s["start"], s["length"])
    )
    attachments = F.flatten(
        F.transform(
            F.col("ts"),
            lambda t, i: F.transform(
                t["attached"],
                lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
            ),
        )
    )
    out = ordered.select(
        "conv_id",
        F.array_join(F.transform(F.col("ts"), lambda t: t["segment"]), "").alias("formatted"),
        loss.alias("loss"),
        attachments.alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    return out.withColumn("expanded_tokens", total)


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with what their formatted text says: ``turns`` (role, text) and ``loss_text``."""
    pieces = F.split("formatted", r"<\|end\|>", -1)
    out = chats.withColumn("_segments", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(segment: Column) -> Column:
        halves = F.split(segment, r"<\|body\|>", -1)
        return F.struct(
            unescape(F.substring(halves[0], len(TURN) + 1, 1 << 30)).alias("role"), unescape(halves[1]).alias("text")
        )

    masked = F.transform(
        F.col("loss"),
        lambda s: unescape(F.col("_segments")[s["turn"]].substr(s["start"] + 1, s["length"])),
    )
    return out.withColumns(
        {"turns": F.transform(F.col("_segments"), turn), "loss_text": F.array_join(masked, "")}
    ).drop("_segments")
