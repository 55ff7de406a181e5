"""Chat formatting of conversations with typed content parts, on DataFrame functions alone.

A turn is a role and an array of parts (``PART``): text, or an attachment, which is an
image, audio, a document or any other kind.  A visitor flattens the parts: text is
escaped, an attachment becomes a placeholder at its place, and its reference and the
number of tokens it expands to are recorded in the same order.  The template sets a
turn between the marks of its role (``ROLES``; other roles are spelled out after
``[ROLE]``).  The loss mask holds the text parts of the trained roles, as spans of code
points of the formatted string.

Escaping is reversible: in a text, a control string gets one backslash after its first
character, as does one that already has backslashes there; reading takes one away.  So a
text never holds a mark, and a text without control strings stays as it is.

A conversation is one string, so its rows meet in one task: that is the size of what is
asked for, whatever else the table holds.

Cases: a null text is empty; a null part or turn without parts is an empty text; a part of null kind
is text; a null role reads back as empty; rows of a conversation go by turn (null
first), then role, then parts, so repeated rows stand side by side; rows with a null
``conv_id`` are one conversation; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import materialise

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
BOS = "<s>"
# Fixed values of this template: role -> marks before and after its content.
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
ANY_FILE = "[FILE]"
_NAMES = r"/?(?:s>|(?:INST|OUT|SYS|ROLE|SAYS|IMAGE|AUDIO|DOCUMENT|FILE)\])"
CONTROL = rf"([<\[])(\\*)({_NAMES})"
_ESCAPED = rf"([<\[])\\(\\*)({_NAMES})"
_CLOSED = r"(?<=\[/INST\]|</s>|\[/SYS\]|\[/ROLE\])"
_PLACE = r"(?<=\[(?:IMAGE|AUDIO|DOCUMENT|FILE)\])|(?=\[(?:IMAGE|AUDIO|DOCUMENT|FILE)\])"


@dataclass(frozen=True)
class ChatTemplate:
    """What an attachment expands to, and which roles are trained on."""

    patch: int = 14  # pixels a side of an image patch; one token each
    max_image_tokens: int = 1600
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 512
    trained: tuple[str, ...] = field(default=("assistant",))

    def tokens_of(self, part: Column) -> Column:
        """Tokens that a part's placeholder stands for; 0 for text."""
        side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(0)), F.lit(1)) / self.patch)
        kind = part["kind"]
        return (
            F.when(_is_text(part), 0)
            .when(kind == "image", F.least(side("width") * side("height"), F.lit(self.max_image_tokens)))
            .when(kind == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate), F.lit(1)))
            .when(kind == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.page_tokens)
            .otherwise(1)
            .cast("long")
        )


def text_part(text: Column) -> Column:
    """A text as an array of one part."""
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *rest))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _is_text(part: Column) -> Column:
    return part.isNull() | part["kind"].isNull() | (part["kind"] == "text")


def _flat(part: Column) -> Column:
    """The visitor: escaped text, or the placeholder of an attachment."""
    mark = F.lit(ANY_FILE)
    for kind, own in PLACEHOLDERS.items():
        mark = F.when(part["kind"] == kind, own).otherwise(mark)
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def _marks(role: Column) -> tuple[Column, Column]:
    opened, closed = F.concat(F.lit(OTHER[0]), escape(F.coalesce(role, F.lit(""))), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (a, b) in ROLES.items():
        opened, closed = F.when(role == name, a).otherwise(opened), F.when(role == name, b).otherwise(closed)
    return opened, closed


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans), attachments, n_parts, expanded_tokens.

    ``turns``: conv_id, turn, role, parts (array of ``PART``).
    """
    in_turns = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    rows = turns.select("conv_id", "turn", "role", F.expr(f"CAST(parts AS array<{PART}>)").alias("parts")).withColumn("nth", F.row_number().over(in_turns))
    rows = rows.select("conv_id", "nth", "role", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("pos", "part"))
    opened, closed = _marks(F.col("role"))
    first, last = F.coalesce(F.col("pos") == 0, F.lit(True)), F.coalesce(F.col("pos") == F.col("n") - 1, F.lit(True))
    start = F.when((F.col("nth") == 1) & first, BOS).otherwise("")
    rows = rows.select(
        "conv_id", "nth", F.coalesce("pos", F.lit(0)).alias("pos"), "part", F.concat(start, F.when(first, opened).otherwise("")).alias("before"), _flat(F.col("part")).alias("flat"),
        F.when(last, closed).otherwise("").alias("after"), (F.col("role").isin(*template.trained) & _is_text(F.col("part"))).alias("trained"),
    ).withColumn("piece", F.concat("before", "flat", "after"))
    upto = Window.partitionBy("conv_id").orderBy("nth", "pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("piece")).over(upto), F.lit(0)) + F.char_length("before")
    # `at` is worked out of the window, so that the rows are sorted by conversation already
    rows = rows.select("conv_id", "nth", "pos", "piece", at.alias("at"), F.char_length("flat").cast("long").alias("length"), F.coalesce("trained", F.lit(False)).alias("trained"), "part", template.tokens_of(F.col("part")).alias("tokens"))
    found = F.when(~_is_text(F.col("part")), F.struct("nth", "pos", "at", "part.kind", "part.ref", "tokens"))
    out = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "pos", "piece"))).alias("pieces"), F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct("nth", "pos", "at", "length")))).alias("loss"),
        F.array_sort(F.collect_list(found)).alias("attachments"), F.sum("tokens").alias("expanded_tokens"), F.count(F.lit(1)).alias("n_parts"),
    )
    return out.select(
        "conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), F.transform("loss", lambda x: F.struct(x["at"].alias("start"), x["length"].alias("length"))).alias("loss"),
        F.transform("attachments", lambda x: F.struct(x["nth"].alias("nth"), x["at"].alias("start"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))).alias("attachments"), "n_parts", "expanded_tokens",
    )


def _between(text: Column, opened: Column, closed: Column) -> Column:
    return text.substr(F.char_length(opened) + 1, F.char_length(text) - F.char_length(opened) - F.char_length(closed))


def _turn(piece: Column) -> Column:
    """Role and parts of one turn as it stands in the string."""
    mark = F.regexp_extract(piece, r"^\[(INST|OUT|SYS|ROLE)\]", 1)
    role, inside = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (a, b) in ROLES.items():
        role, inside = F.when(mark == a[1:-1], name).otherwise(role), F.when(mark == a[1:-1], _between(piece, F.lit(a), F.lit(b))).otherwise(inside)
    whole = _between(piece, F.lit(OTHER[0]), F.lit(OTHER[2]))
    name = F.substring_index(whole, OTHER[1], 1)
    other = mark == OTHER[0][1:-1]
    role, inside = F.when(other, unescape(name)).otherwise(role), F.when(other, whole.substr(F.char_length(name) + len(OTHER[1]) + 1, F.char_length(whole))).otherwise(inside)
    kind_of = lambda x: F.coalesce(*[F.when(x == own, kind) for kind, own in {**PLACEHOLDERS, "file": ANY_FILE}.items()], F.lit("text"))
    parts = F.transform(F.split(inside, _PLACE), lambda x: F.struct(kind_of(x).alias("kind"), F.when(kind_of(x) == "text", unescape(x)).alias("text")))
    return F.struct(role.alias("role"), parts.alias("parts"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns of formatted conversations: adds turns (role, parts) and trained (the text under the loss mask)."""
    body = F.regexp_replace("formatted", "^<s>", "")
    pieces = F.filter(F.split(body, _CLOSED), lambda x: x != "")
    trained = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": F.transform(pieces, _turn), "trained": trained})


def chat_digest(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of conversations read back."""
    said = lambda t: F.array_join(F.transform(t["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), said(t), F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "n_parts", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )


def text_turns(conversations: DataFrame) -> DataFrame:
    """Turns of text alone (conv_id, turn, role, text) with typed parts."""
    return conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))


def format_and_digest(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Format, write, read back, digest."""
    return chat_digest(read_chats(materialise(format_chats(turns, template), "chats")))


_ESC = "([<\\[])(\\\\*)(/?(?:s>|(?:INST|OUT|SYS|ROLE|SAYS|IMAGE|AUDIO|DOCUMENT|FILE)\\]))"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_ESC}')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11
        ELSE 19 + length(coalesce(role, '')) + len(regexp_extract_all(coalesce(role, ''), '{_ESC}')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_parts, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM n GROUP BY conv_id
"""
