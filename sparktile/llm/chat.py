"""Chat formatting: typed content parts flattened by a visitor into ordered placeholders.

Image parts refer to the project's image records (``source_id``, ``width``, ``height``) and expand to one group of tokens
per tile of the record's tile grid (``patch_size``, ``stride``).  Conversations themselves are not part of the project's
records; any table of turns serves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import tile_positions

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PART_TYPE = "array<struct<kind:string,text:string,source_id:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class PartCosts:
    """Tokens that one attachment stands for after expansion."""

    patch_size: int = 256
    stride: int = 128
    tokens_per_tile: int = 64
    tokens_per_second: float = 25.0
    tokens_per_page: int = 512


def escape(text: Column) -> Column:
    """Control strings start with ``<|``; a backslash keeps them apart and is itself doubled, so nothing is lost."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class PartVisitor:
    """Visits one content part; each kind has a method that gives its placeholder and its expanded token count."""

    def __init__(self, costs: PartCosts):
        self.costs = costs

    def text(self, part: Column, index: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column, index: Column) -> tuple[Column, Column]:
        c = self.costs
        side = [F.size(tile_positions(F.greatest(part[k], F.lit(1)), c.patch_size, c.stride)) for k in ("width", "height")]
        return self._mark("image", index), F.coalesce(side[0] * side[1] * c.tokens_per_tile, F.lit(0))

    def audio(self, part: Column, index: Column) -> tuple[Column, Column]:
        return self._mark("audio", index), F.coalesce(F.ceil(part["seconds"] * self.costs.tokens_per_second).cast("int"), F.lit(0))

    def document(self, part: Column, index: Column) -> tuple[Column, Column]:
        return self._mark("document", index), F.coalesce(part["pages"] * self.costs.tokens_per_page, F.lit(0))

    @staticmethod
    def _mark(kind: str, index: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), index.cast("string"), F.lit("|>"))

    def visit(self, part: Column, index: Column) -> Column:
        """struct(written, kind, source_id, tokens); a kind without a method is written as its text."""
        written, tokens = self.text(part, index)
        for kind in ("image", "audio", "document"):
            mark, cost = getattr(self, kind)(part, index)
            written = F.when(part["kind"] == kind, mark).otherwise(written)
            tokens = F.when(part["kind"] == kind, cost).otherwise(tokens)
        return F.struct(written.alias("written"), part["kind"].alias("kind"), part["source_id"].alias("source_id"), tokens.cast("long").alias("tokens"))


def text_part(text: Column) -> Column:
    """``parts`` of a turn that is text only."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("source_id"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    ).cast(PART_TYPE)


def format_conversations(turns: DataFrame, costs: PartCosts = PartCosts()) -> DataFrame:
    """(conv_id, turn, role, parts) to one row per conversation: ``formatted``, ``loss_spans``, ``attachments``, ``n_turns``,
    ``attachment_tokens``.

    Method: a visitor with one case per part kind flattens parts into ordered placeholders (``<|image:k|>``, k counts the
    parts of the turn), and records attachment references and expanded token counts.  Built-in functions only.
    ``loss_spans`` holds (start, length) in code points of ``formatted`` for every assistant body.

    Turns are ordered by turn number, then role, then content, so ties have one result.  Null role or text counts as empty,
    null parts as no part, null turn comes first, and null conv_id is one conversation.  Repeated rows are repeated
    turns.  An empty table gives no rows; other columns are ignored.  A conversation is one output value, so it is gathered
    in one row; conversations are spread over tasks by conv_id.
    """
    visitor = PartVisitor(costs)
    parts = F.coalesce(F.col("parts"), F.array().cast(PART_TYPE))
    seen = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.transform(parts, lambda p, i: visitor.visit(p, i)).alias("parts"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    body = F.array_join(F.transform("parts", lambda p: p["written"]), "")
    numbered = F.transform("parts", lambda p, i: F.struct(i.alias("part"), *[p[c].alias(c) for c in ("kind", "source_id", "tokens")]))
    files = F.filter(numbered, lambda p: p["kind"].isin("image", "audio", "document"))
    written = seen.select("conv_id", F.struct("turn", "role", body.alias("body"), F.length(head).alias("head_chars"), F.concat(head, body, F.lit(END)).alias("written"), files.alias("files")).alias("t"))
    grouped = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    sized = F.transform("ts", lambda t: F.struct((t["role"] == "assistant").alias("learn"), t["head_chars"].alias("head"), F.length(t["body"]).alias("body"), F.length(t["written"]).alias("all")))
    spans = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["all"]).alias("at"),
            F.when(t["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    out = grouped.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["written"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("turn"), f["part"].alias("part"), f["kind"].alias("kind"), f["source_id"].alias("source_id"), f["tokens"].alias("tokens"))))).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) back to ``turns`` array<struct<role,text>> and ``loss_texts`` array<string>, unescaped."""
    cut = F.split("formatted", r"<\|end\|>")
    pieces = F.slice(cut, 1, F.size(cut) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, BODY)
        role = F.substring(piece, F.lit(len(TURN) + 1), at - 1 - len(TURN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, at + len(BODY), F.length(piece))).alias("text"))

    return formatted.select(
        "conv_id", "formatted",
        F.transform(pieces, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss_texts"),
    )
