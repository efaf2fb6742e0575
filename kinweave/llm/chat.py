"""Chat formatting with typed content parts, in column expressions.

A turn's content is a list of parts: text, image, audio or document. One visit over the parts writes
texts with their control strings escaped and a numbered placeholder for every other part, and records
for each of those its reference, where its placeholder is, and how many tokens it stands for.

    <|turn|>role
    content<|end|>

Control strings inside texts are escaped with one backslash after their first character, or one more
where some are there already, so taking one away restores every text. ``read_back`` takes the
formatted string apart again. The loss mask is a list of code point ranges of the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings of the formats in use, without their first character. Fixed values.
TAILS = (r"\|[^|<>\n]{0,40}\|>", r"/?s>", r"/?<?/?SYS>>", r"/?INST\]", r"/?unk>", r"/?pad>")
TO_ESCAPE = rf"([<\[])(\\*)({'|'.join(TAILS)})"
ESCAPED = rf"([<\[])\\(\\*)({'|'.join(TAILS)})"
ATTACHMENTS = ("image", "audio", "document")
#: Side of the square of pixels that is one token of an image.
PATCH = 14
#: Tokens for a second of audio, and characters of a document for one token.
AUDIO_RATE, DOCUMENT_CHARS = 25, 4
PART = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,chars:bigint>>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, TO_ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role is one line; ``%`` marks what is written otherwise."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def tokens_of(part: Column) -> Column:
    """How many tokens an attachment expands to: patches, time steps or pieces of text, one at least."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    steps = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)
    pieces = F.ceil(F.coalesce(part["chars"], F.lit(0)) / DOCUMENT_CHARS)
    count = F.when(part["type"] == "image", patches).when(part["type"] == "audio", steps).otherwise(pieces)
    return F.greatest(count.cast("long"), F.lit(1).cast("long"))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*ATTACHMENTS), F.lit(False))


def visit(parts: Column) -> Column:
    """Flatten a turn's parts: ``text`` with placeholders numbered from 0, and the ``attachments``.

    A part of another or no type is text; a null text is empty; null parts are left out. Text parts that
    follow one another are escaped as one text, so no control string can lie across two of them.
    """
    def step(state: Column, part: Column) -> Column:
        number = F.size(state["attachments"])
        mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), number.cast("string"), F.lit("|>"))
        before = F.concat(state["text"], escape(state["open"]))
        seen = F.array(F.struct(part["type"].alias("type"), part["ref"].alias("ref"),
                                F.length(before).cast("long").alias("at"), tokens_of(part).alias("tokens")))
        return F.struct(
            F.when(is_attachment(part), F.concat(before, mark)).otherwise(state["text"]).alias("text"),
            F.when(is_attachment(part), "").otherwise(F.concat(state["open"], F.coalesce(part["text"], F.lit("")))).alias("open"),
            F.when(is_attachment(part), F.concat(state["attachments"], seen)).otherwise(state["attachments"]).alias("attachments"))

    begin = F.struct(F.lit("").alias("text"), F.lit("").alias("open"),
                     F.array().cast("array<struct<type:string,ref:string,at:bigint,tokens:bigint>>").alias("attachments"))
    return F.aggregate(F.filter(F.coalesce(parts, F.array().cast(PART)), lambda p: p.isNotNull()), begin, step, lambda state: F.struct(
        F.concat(state["text"], escape(state["open"])).alias("text"), state["attachments"].alias("attachments")))


def text_part(*texts: Column) -> Column:
    """Plain texts as a list of parts."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "chars": "bigint"}
    return F.array(*(F.struct(F.lit("text").alias("type"), text.alias("text"),
                              *(F.lit(None).cast(t).alias(n) for n, t in none.items())) for text in texts)).cast(PART)


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, parts`` to one row per conversation: ``conv_id, formatted, loss_ranges,
    attachments, n_tokens_expanded``.

    Turns are ordered by ``turn``, then role and content, so equal turns and ties have a fixed order;
    repeated rows are turns of their own. A null role or text is empty, a null turn comes first, rows
    with a null ``conv_id`` form one conversation. ``loss_ranges`` are the contents of assistant
    turns, each a range ``[start, end)`` of the formatted string in code points; placeholders of
    attachments count as content.
    """
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts")).alias("flat"))
    shown = flat.select(
        "conv_id", "turn", "role", F.col("flat.attachments").alias("attachments"), F.col("flat.text").alias("content"),
        F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"))
    grouped = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "role", "content", "head", "attachments"))).alias("turns"))

    def place(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["content"])
        ours = F.array(F.struct(start.alias("start"), end.alias("end")))
        files = F.transform(t["attachments"], lambda a: F.struct(
            a["type"].alias("type"), a["ref"].alias("ref"), (a["at"] + start).alias("at"), a["tokens"].alias("tokens")))
        return F.struct((end + len(END)).alias("at"),
                        F.when(t["role"] == "assistant", F.concat(state["loss"], ours)).otherwise(state["loss"]).alias("loss"),
                        F.when(F.size(files) > 0, F.concat(state["files"], files)).otherwise(state["files"]).alias("files"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"),
                     F.array().cast("array<struct<type:string,ref:string,at:bigint,tokens:bigint>>").alias("files"))
    placed = grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", begin, place).alias("places"))
    files = F.col("places.files")
    expanded = F.aggregate(files, F.lit(0).cast("long"), lambda n, f: n + f["tokens"])
    return placed.select("conv_id", "formatted", F.col("places.loss").alias("loss_ranges"), files.alias("attachments"),
                         expanded.alias("n_tokens_expanded"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted``: the turns (role, text) of the formatted string, and all
    text under the loss mask, unescaped.

    A turn ends at the end mark, which no escaped text holds, and its role at its first line end.
    """
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda b: b != "")
    body = F.transform(blocks, lambda b: F.substr(b, F.lit(len(TURN) + 1)))
    turns = F.transform(body, lambda b: F.struct(
        unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, F.lit("\n")) + 1)).alias("text")))
    loss = F.transform("loss_ranges", lambda r: unescape(F.substr(
        F.col("formatted"), (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def chat_digests(back: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
