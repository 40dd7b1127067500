"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is a row (conversation, turn, role, parts). Each part is a struct with the fields of ``PART``: the visitor turns
text parts into escaped text and image, audio and document parts into placeholders in the order they stand, and records
for each attachment its reference, its place and the number of tokens that the placeholder stands for.

Template of a turn: ``<|turn|>role<|text|>content<|end|>``. A backslash is put after the first character of every control
string found in a role or a text, and backslashes are doubled, so that dropping one backslash before any character undoes it.
Neighbouring text parts are joined before that, so no control string arises where two of them meet.

Reading back gives each turn's role and text, or its parts in order: a placeholder never stands inside escaped text, so parts
and texts that look like them are told apart (neighbouring text parts come back as one, empty ones not at all).

Defined results: a null text, role or list of parts is empty; a part of any other kind than those of ``PLACEHOLDERS`` is text,
so no kind forges a control string; a null conversation id is a conversation of its own; equal turn numbers are ordered by
role, then content as escaped; repeated rows are kept as repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Kinds of parts with a placeholder.
PLACEHOLDERS = ("image", "audio", "document")
_MARK = rf"<\|(?:{'|'.join(PLACEHOLDERS)})\|>"
#: Where a control string of this or of another common template begins.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expanded_tokens(part: Column, patch: int = 14, audio_rate: int = 25, page_tokens: int = 256) -> Column:
    """Tokens that stand behind a placeholder: image patches, audio frames or document pages; 0 for text."""

    def cells(edge: str) -> Column:
        return F.ceil(F.coalesce(part[edge], F.lit(0)) / F.lit(patch))

    return (
        F.when(part["kind"] == "image", cells("width") * cells("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * page_tokens)
        .otherwise(F.lit(0))
        .cast("long")
    )


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*PLACEHOLDERS), F.lit(False))


def places(parts: Column) -> Column:
    """Where the attachments stand, and the end, each with the place before it: the runs of text lie between them. array<struct<before:int,at:int>>"""
    at = F.concat(F.filter(F.transform(parts, lambda p, i: F.when(is_attachment(p), i)), lambda i: i.isNotNull()), F.array(F.size(parts)))
    before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1))
    return F.arrays_zip(before.alias("before"), at.alias("at")).cast("array<struct<before:int,at:int>>")


def visit(parts: Column, runs: Column) -> Column:
    """What the parts become in the content: each run of text escaped as one, and each attachment's placeholder after it."""

    def one(r: Column) -> Column:
        texts = F.transform(F.slice(parts, r["before"] + 2, r["at"] - r["before"] - 1), lambda p: F.coalesce(p["text"], F.lit("")))
        mark = F.concat(F.lit("<|"), F.get(parts, r["at"])["kind"], F.lit("|>"))
        return F.concat(escape(F.array_join(texts, "")), F.coalesce(mark, F.lit("")))

    return F.array_join(F.transform(runs, one), "")


def text_parts(text: Column) -> Column:
    """The parts of a message that is only text."""
    return F.array(F.named_struct(*[x for f in ("kind", "text", "ref", "width", "height", "seconds", "pages") for x in (F.lit(f), {"kind": F.lit("text"), "text": text}.get(f, F.lit(None)))])).cast(PARTS)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss_spans (code points in formatted) and attachments."""
    none = F.array().cast(PARTS)
    messages = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(parts).cast(PARTS), none).alias("parts"))
    one = messages.withColumn("runs", places(F.col("parts"))).select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        visit(F.col("parts"), F.col("runs")).alias("content"),
        F.transform(
            F.filter("parts", is_attachment),
            lambda p, i: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), i.cast("int").alias("place"), expanded_tokens(p).alias("n_tokens")),
        ).alias("attached"),
    )
    turns = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "attached"))).alias("turns"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(head(t))
        end = start + F.length(t["content"])
        kept = F.when(t["role"] == loss_role, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), kept.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", first, step)["spans"].alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.cast("int").alias("turn_index"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["place"].alias("place"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array<struct<role,text>>."""
    return F.transform(
        F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x, i: i > 0),
        lambda x: F.struct(
            unescape(F.get(F.split(x, r"<\|text\|>", 2), F.lit(0))).alias("role"),
            unescape(F.substring_index(F.get(F.split(x, r"<\|text\|>", 2), F.lit(1)), END, 1)).alias("text"),
        ),
    )


def read_parts(content: Column) -> Column:
    """The parts of a turn's content as formatted (not unescaped): array<struct<kind,text>>, a placeholder's text is null."""
    pieces = F.filter(F.split(content, rf"(?={_MARK})|(?<={_MARK})", -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.when(x.rlike(f"^{_MARK}$"), F.regexp_extract(x, r"\w+", 0)).otherwise("text").alias("kind"), F.when(~x.rlike(f"^{_MARK}$"), unescape(x)).alias("text")))


def contents(formatted: Column) -> Column:
    """The contents of the turns of a formatted conversation, for ``read_parts``."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x, i: i > 0)
    return F.transform(turns, lambda x: F.substring_index(F.get(F.split(x, r"<\|text\|>", 2), F.lit(1)), END, 1))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table, whole_text

    own = spark.sql("select -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = format_chats(rows.select("conv_id", "turn", "role", text_parts(whole_text()).alias("parts")))
    back = done.select("conv_id", "formatted", "attachments", read_back(F.col("formatted")).alias("back"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("attached_tokens"),
    )


#: The digests are of the plain texts, so they hold only if the format can be undone. The table has texts only, no attachments.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g') AS escaped,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g') AS named FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, escaped)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, escaped) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + length(named) + 23) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attached_tokens
FROM e GROUP BY conv_id
"""
