"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds ordered parts. A visitor (one CASE over the part's type) flattens each part:
text stays text, with control strings escaped; an image, audio or document part becomes a
placeholder, leaves a reference to what it attaches, and counts as many tokens as a model
expands it to. A formatted conversation is a list of segments; its text is their
concatenation, and the loss mask marks the segments that hold what the assistant said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template. No text can hold their first two characters, "<|".
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: Type of the parts column.
PART = (
    "struct<type:string, text:string, uri:string, width:int, height:int, seconds:double, pages:int>"
)

PIXELS_PER_SIDE = 28  # an image token covers a square of this side
AUDIO_TOKENS_A_SECOND = 25.0
DOCUMENT_TOKENS_A_PAGE = 256


def escape(text: Column) -> Column:
    """Text without any ``<|``; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """A role on one line: line feeds are escaped besides."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    # An ampersand of the role itself was written &amp;, so &#10; can only be an escaped line feed.
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def known(part: Column) -> Column:
    return part["type"].isin(*PLACEHOLDERS)


def visit(part: Column) -> Column:
    """What a part becomes. A part of unknown or null type counts as text; null text is empty."""
    out = F.lit(None).cast("string")
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return F.coalesce(out, escape(F.coalesce(part["text"], F.lit(""))))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment stands for, 1 at least; missing sizes count as the smallest."""

    def size(name):
        return F.greatest(F.coalesce(part[name], F.lit(0)), F.lit(0))

    tiles = F.ceil(size("width") / PIXELS_PER_SIDE) * F.ceil(size("height") / PIXELS_PER_SIDE)
    return (
        F.when(part["type"] == "image", F.greatest(tiles, F.lit(1)))
        .when(part["type"] == "audio", F.greatest(F.ceil(size("seconds") * AUDIO_TOKENS_A_SECOND), F.lit(1)))
        .when(part["type"] == "document", F.greatest(size("pages") * DOCUMENT_TOKENS_A_PAGE, F.lit(1)))
        .otherwise(F.lit(0))
        .cast("long")
    )


def text_parts(text: Column) -> Column:
    """A parts column that holds one text."""
    fields = PART[len("struct<") : -1].split(", ")
    values = {"type": F.lit("text"), "text": text}
    return F.array(
        F.struct(*[
            values.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in (f.split(":") for f in fields)
        ])
    )


def format_chats(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``segments``, ``formatted``, ``attachments``, ``extra_tokens``.

    ``segments array<struct<text, loss>>`` concatenate to ``formatted``; a segment with loss is the
    flattened content of a turn whose role is among ``loss_roles``. ``attachments`` lists (turn
    number from 0, part number from 0, type, uri, tokens) in order of their placeholders.
    Turns are ordered by ``turn`` (null first), ties by role and content, so equal rows stay as
    many turns. A null role is an empty one; null or empty parts are an empty turn; a null
    conversation id is a conversation like any other. Other columns are left out.
    A conversation is one output text, so it is built in one row.
    """
    flat = messages.select(
        F.col(conv).alias(conv),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.concat_ws("", F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit)).alias("content"),
            F.filter(
                F.transform(
                    F.coalesce(parts, F.array().cast(f"array<{PART}>")),
                    lambda p, i: F.struct(
                        i.alias("part"), p["type"].alias("type"), p["uri"].alias("uri"),
                        expanded_tokens(p).alias("tokens"),
                    ),
                ),
                known,
            ).alias("attached"),
        ).alias("message"),
    )
    ordered = flat.groupBy(conv).agg(F.sort_array(F.collect_list("message")).alias("messages"))

    def segments_of(message: Column) -> Column:
        head = F.concat(F.lit(TURN_START), escape_role(message["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(message["content"].alias("text"), message["role"].isin(*loss_roles).alias("loss")),
            F.struct(F.lit(TURN_END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    attached = F.flatten(
        F.transform(
            "messages",
            lambda m, i: F.transform(
                m["attached"],
                lambda a: F.struct(
                    i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["uri"].alias("uri"),
                    a["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    built = ordered.select(
        conv,
        F.size("messages").cast("long").alias("n_turns"),
        F.flatten(F.transform("messages", segments_of)).alias("segments"),
        attached.alias("attachments"),
    )
    return built.select(
        conv, "n_turns", "segments", F.array_join("segments.text", "").alias("formatted"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("extra_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>, unescaped."""
    ends = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(ends, F.lit(1), F.size(ends) - 1)  # after the last end comes nothing

    def turn_of(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(TURN_START) + 1))
        line = F.instr(body, "\n")
        return F.struct(
            unescape_role(F.substr(body, F.lit(1), line - 1)).alias("role"),
            unescape(F.substr(body, line + 1)).alias("text"),
        )

    return F.transform(turns, turn_of)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Format rows of (conv_id, turn, role, text) and read the output back."""
    messages = conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    chats = format_chats(messages)
    said = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        chats.select("conv_id", "formatted", said.alias("said"), loss_text(F.col("segments")).alias("loss"))
        .select(
            "conv_id",
            F.size("said").cast("long").alias("n_turns"),
            F.sha2(F.array_join("said", ""), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
