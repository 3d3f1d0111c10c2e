r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn has a role and a list of parts: ``text``, ``image``, ``audio`` or
``document``. A visitor takes each part by its type: a text becomes a mark and
its escaped text, any other part a placeholder, whose reference and expanded
token count go to the list of attachments, in the order of the placeholders.

The template: ``<|role|>`` role, then for each part ``<|text|>`` text or a
placeholder such as ``<|image|>``, then ``<|end|>``. In roles and texts a
backslash follows each backslash and the first character of each control string
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so none of these occurs in
them; taking it away gives the text back.

A formatted conversation is one row: the text, and for each turn its start and
the spans under the loss mask (the texts of trained roles), in code points.
Reading splits the text at the marks; nothing is looked up in the input.

Defined results: null text is empty, a null role the empty string; rows of a
conversation come by turn, then role, then parts, nulls first; rows with a null
conversation are one conversation; a null list of parts is empty; a null or
unknown type is ``other``, a placeholder; repeated rows are turns of their own;
an empty table gives no rows; other columns are ignored. A conversation is one
row of the output, so it must fit into a task as that row does; its turns come
to it sorted, through one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oppflow.shared import materialize

#: A content part. ``text`` belongs to texts, the others to the parts that ``ref`` names.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Control strings of this and other templates: each is broken up wherever a role or a text holds it.
CONTROLS = r"\\|<(?=\||/?s>)|\[(?=/?INST\])"
ATTACHED = ("image", "audio", "document", "other")
MARKS = r"(?=<\|(?:text|image|audio|document|other)\|>)"
TRAINED = ("assistant",)


@dataclass(frozen=True)
class Costs:
    """Tokens of an attachment once a model expands it."""

    patch: int = 28
    image_marks: int = 2
    audio_per_second: int = 25
    document_per_page: int = 768


def escaped(c: Column) -> Column:
    """``c`` without control strings; :func:`unescaped` gives it back."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), CONTROLS, r"$0\\")


def unescaped(c: Column) -> Column:
    """What was escaped."""
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def text_part(text: Column) -> Column:
    """A list of one part, the text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]).cast(PART))


def _tokens(p: Column, costs: Costs) -> Column:
    """Expanded token count of a part that is no text; a part of unknown size counts as one token."""
    patches = lambda c: F.ceil(p[c] / F.lit(costs.patch))
    cost = F.when(p["type"] == "image", patches("width") * patches("height") + costs.image_marks).when(p["type"] == "audio", F.ceil(p["seconds"] * costs.audio_per_second)).when(p["type"] == "document", p["pages"] * F.lit(costs.document_per_page))
    return F.greatest(F.coalesce(cost.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))


def visited(parts: Column, costs: Costs) -> Column:
    """The parts in order: ``kind``, ``mark``, escaped ``body``, ``ref`` and expanded ``tokens`` (null for texts)."""

    def visit(p: Column) -> Column:
        known = F.when(p["type"].isin("text", *ATTACHED), p["type"]).otherwise("other")
        text = known == "text"
        return F.struct(known.alias("kind"), F.concat(F.lit("<|"), known, F.lit("|>")).alias("mark"), F.when(text, escaped(p["text"])).otherwise("").alias("body"), F.when(~text, p["ref"]).alias("ref"), F.when(~text, _tokens(p, costs)).alias("tokens"))

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit)


def _spans(pieces: Column, head: Column) -> Column:
    """Start and end of the text bodies in a turn that begins with ``head`` characters."""
    none = F.array().cast("array<struct<start:long,end:long>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["mark"])
        end = start + F.char_length(p["body"])
        mine = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["kind"] == "text", F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(head.cast("long").alias("at"), none.alias("spans")), step)["spans"]


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained: tuple[str, ...] = TRAINED, costs: Costs = Costs()) -> DataFrame:
    """Formatted turns: ``conv, seq, piece, start`` in the conversation, loss ``spans`` from there, ``attachments``."""
    head = F.concat(F.lit("<|role|>"), escaped(F.col("role")))
    src = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(parts_col).cast(f"array<{PART}>").alias("parts"))
    seen = src.withColumns({"pieces": visited(F.col("parts"), costs), "head": head})
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), "")
    none = F.array().cast("array<struct<start:long,end:long>>")
    made = seen.select("conv", "turn", "role", "parts", F.concat("head", body, F.lit("<|end|>")).alias("piece"), F.when(F.col("role").isin(*trained), _spans(F.col("pieces"), F.char_length("head"))).otherwise(none).alias("spans"), F.transform(F.filter("pieces", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"))
    by_turn = Window.partitionBy("conv").orderBy("turn", "role", "parts")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    return made.select("conv", F.row_number().over(by_turn).alias("seq"), "piece", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)).cast("long").alias("start"), "spans", "attachments")


def formatted(rows: DataFrame, **how) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, its ``turns`` (start, spans) and ``attachments``; arguments of :func:`turns`."""
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    one = F.struct("seq", "piece", F.struct("start", moved.alias("spans")).alias("turn"), "attachments")
    listed = turns(rows, **how).groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("t"))
    attached = F.flatten(F.col("t.attachments"))
    return listed.select("conv", F.array_join("t.piece", "").alias("formatted"), F.col("t.turn").alias("turns"), attached.alias("attachments"), F.coalesce(F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]), F.lit(0)).alias("attachment_tokens"))


def read_back(out: DataFrame) -> DataFrame:
    """Formatted conversations as ``conv``, ``chars``, ``turns`` (role, parts of type and text, text) and the ``loss`` text."""

    def parsed(piece: Column) -> Column:
        cut = F.split(piece, MARKS, -1)
        parts = F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda p: F.struct(F.regexp_extract(p, r"^<\|(\w+)\|>", 1).alias("type"), unescaped(F.regexp_replace(p, r"^<\|\w+\|>", "")).alias("text")))
        role = unescaped(F.regexp_replace(F.element_at(cut, 1), r"^<\|role\|>", ""))
        return F.struct(role.alias("role"), parts.alias("parts"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))

    def under_mask(piece: Column, turn: Column) -> Column:
        own = F.transform(turn["spans"], lambda s: unescaped(F.substring(piece, (s["start"] - turn["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
        return F.array_join(own, "")

    cut = F.split("formatted", r"<\|end\|>", -1)
    pieces = F.slice(cut, 1, F.size(cut) - 1)
    return out.select("conv", F.char_length("formatted").cast("long").alias("chars"), pieces.alias("pieces"), "turns").select("conv", "chars", F.transform("pieces", parsed).alias("turns"), F.array_join(F.zip_with("pieces", "turns", under_mask), "").alias("loss"))


def digest(conversations: DataFrame) -> DataFrame:
    """Rows of the query: all conversations and one that holds the template's own control strings."""
    rows = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    said = text_part(F.lit("</s>[INST] ok [/INST]"))
    own = conversations.sparkSession.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("parts"))
    out = materialize(formatted(rows.unionByName(own)), "chats")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(out).select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        sha(lines).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
