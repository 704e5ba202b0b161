"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a list of parts: text, image, audio or document. A visitor over the parts writes
texts with control strings escaped and a placeholder for every attachment, in order; each
attachment is recorded with its place and the tokens that its placeholder expands to. A
conversation's messages are joined by the template, with the mask that a loss may use.

Escaping is reversible: a backslash is doubled, and a backslash goes in after the first
character wherever a control string begins. So no control string survives inside a text, and
taking one backslash of each run away gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import pick

#: Control strings of common chat templates: fixed values that no text may hold unescaped.
COMMON_CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
)


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles that a loss covers, and the sizes of attachments in tokens."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    extra_controls: tuple[str, ...] = COMMON_CONTROLS
    patch_pixels: int = 28
    audio_ms_per_token: int = 40
    tokens_per_page: int = 256

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, self.image, self.audio, self.document, *self.extra_controls)


PART = (
    "struct<type:string,text:string,uri:string,width:int,height:int,duration_ms:bigint,pages:int>"
)


def escape(text: Column, template: Template) -> Column:
    starts = "|".join(re.escape(c).replace("/", r"\/") for c in template.controls)
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?s)(?={starts})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """A message of one text as a list of parts."""
    empty = {"type": F.lit("text"), "text": text}
    fields = [f.split(":") for f in PART[7:-1].split(",")]
    return F.array(F.struct(*(empty.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields)))


def expanded_tokens(part: Column, t: Template) -> Column:
    """Tokens that an attachment's placeholder expands to; unknown sizes count as one patch, step or page."""

    def steps(x: Column, by: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(x, F.lit(1)) / F.lit(by))).cast("bigint")

    return (
        F.when(part["type"] == "image", steps(part["width"], t.patch_pixels) * steps(part["height"], t.patch_pixels))
        .when(part["type"] == "audio", steps(part["duration_ms"], t.audio_ms_per_token))
        .when(part["type"] == "document", steps(part["pages"], 1) * t.tokens_per_page)
        .otherwise(F.lit(0).cast("bigint"))
    )


def visit(part: Column, t: Template) -> Column:
    """What a part becomes: escaped text or a placeholder. Parts of an unknown type are taken as text."""
    return (
        F.when(part["type"] == "image", F.lit(t.image))
        .when(part["type"] == "audio", F.lit(t.audio))
        .when(part["type"] == "document", F.lit(t.document))
        .otherwise(escape(F.coalesce(part["text"], F.lit("")), t))
    )


def format_chat(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts).

    (conv_id, formatted, segments, loss_spans, attachments, expanded_tokens). Turns are in order of
    turn, null last, ties by role and content. ``segments`` are (text, loss): joined they are
    ``formatted``, and those of ``loss`` are the loss mask; ``loss_spans`` are the same mask as
    [start, end) in code points of ``formatted``. ``attachments`` list (ordinal, turn_index, type,
    uri, at, n_tokens) in order, ``at`` being the placeholder's code point. A null role counts as an
    empty one, a null text or list of parts as empty; rows with a null conv_id form one
    conversation; rows that repeat are turns of their own. No rows give no conversations.

    Places are running sums over a conversation's turns, so the work is in proportion to its length.
    """
    t = template
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    seen = F.transform(
        parts,
        lambda p: F.struct(
            visit(p, t).alias("out"), p["type"].alias("type"), p["uri"].alias("uri"), expanded_tokens(p, t).alias("n_tokens")
        ),
    )
    body = F.array_join(F.transform("seen", lambda x: x["out"]), "")
    kinds = ("image", "audio", "document")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<type:string,uri:string,at:int,n_tokens:bigint>>").alias("found"))

    def note(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["type"].alias("type"), x["uri"].alias("uri"), acc["at"].alias("at"), x["n_tokens"].alias("n_tokens")))
        found = F.when(x["type"].isin(*kinds), F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.struct((acc["at"] + F.char_length(x["out"])).alias("at"), found.alias("found"))

    role = F.coalesce("role", F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), seen.alias("seen")).select(
        "conv_id",
        "turn",
        "role",
        body.alias("body"),
        F.concat(F.lit(t.turn), escape(F.col("role"), t), F.lit(t.body)).alias("head"),
        F.aggregate("seen", start, note, lambda acc: acc["found"]).alias("attachments"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").isNull(), "turn", "role", "body")
    size = F.char_length("head") + F.char_length("body") + len(t.end)
    begin = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumns({"turn_index": F.row_number().over(order) - 1, "first": begin + F.char_length("head")})
    attached = F.transform(
        "attachments",
        lambda a: F.struct(
            F.col("turn_index").alias("turn_index"), a["type"].alias("type"), a["uri"].alias("uri"), (a["at"] + F.col("first")).alias("at"), a["n_tokens"].alias("n_tokens")
        ),
    )
    turn = F.struct(
        "turn_index", "head", "body", F.col("role").isin(*t.loss_roles).alias("loss"), "first",
        (F.col("first") + F.char_length("body")).alias("last"), attached.alias("attached"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda m: F.array(
                F.struct(m["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(m["body"].alias("text"), m["loss"].alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    spans = F.transform(F.filter("turns", lambda m: m["loss"]), lambda m: F.struct(m["first"].alias("start"), m["last"].alias("end")))
    placed = talks.select("conv_id", segments.alias("segments"), spans.alias("loss_spans"), F.flatten(F.transform("turns", lambda m: m["attached"])).alias("attached"))
    attachments = F.transform(
        "attached",
        lambda a, i: F.struct(
            i.alias("ordinal"), a["turn_index"].alias("turn_index"), a["type"].alias("type"), a["uri"].alias("uri"),
            a["at"].alias("at"), a["n_tokens"].alias("n_tokens"),
        ),
    )
    total = F.aggregate("attached", F.lit(0).cast("bigint"), lambda acc, a: acc + a["n_tokens"])
    joined = F.array_join(F.transform("segments", lambda x: x["text"]), "")
    return placed.select("conv_id", joined.alias("formatted"), "segments", "loss_spans", attachments.alias("attachments"), total.alias("expanded_tokens"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds; placeholders stay in the text."""
    t = template
    pieces = F.filter(F.split(formatted, re.escape(t.turn)), lambda x: x != "")
    # every piece is role, body mark, text, end mark; inside a turn those marks are escaped
    split = F.transform(pieces, lambda x: F.split(F.left(x, F.char_length(x) - len(t.end)), re.escape(t.body)))
    return F.transform(split, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")


def chat_digests(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """Format, read back, and digest: the turns and the loss text that the output holds."""
    rows = pick(messages, conv_id="bigint", turn="bigint", role="string", text="string")
    done = format_chat(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")), template)
    turns = read_turns(F.col("formatted"), template)
    joined = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    read = done.select("conv_id", "formatted", "expanded_tokens", turns.alias("turns"), loss_text(F.col("segments")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
