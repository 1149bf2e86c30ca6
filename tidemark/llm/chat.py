r"""Chat formatting with typed content parts, with DataFrame functions only.

A message holds parts of type text, image, audio or document (plain text is one text part). A visitor over the
parts writes text with its control strings escaped, and a placeholder for anything else, in order, while the
attachments' references and the tokens they expand to are recorded beside the formatted string.

A turn is written ``<|im_start|>role<|im_sep|>content<|im_end|>`` and a newline. In texts and roles a backslash
becomes two, and the first character of every control string, this template's or a widely used other one's, gets a
backslash behind it; taking each backslash away together with what it protects gives the text back exactly. So no
text can open or close a turn, and the formatted string alone tells turns, roles and texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Where a backslash goes in: behind < of <|, <s>, </s>, <<SYS>>, <</SYS>> and behind [ of [INST], [/INST].
CONTROL = r"(?:<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
#: Tokens that a part stands for if it doesn't say so itself.
PART_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text (null: empty) as content parts."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("tokens"))).cast(PARTS)


def _kind(part: Column) -> Column:
    known = F.lower(part["type"])
    return F.when(known.isin(*PART_TOKENS), known).otherwise(F.lit("file"))


def _is_text(part: Column) -> Column:
    return F.coalesce(F.lower(part["type"]), F.lit("text")) == "text"


def flatten(parts: Column) -> Column:
    """The content string of parts."""
    visit = lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))
    return F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), visit), "")


def attachments(parts: Column) -> Column:
    """type, ref and tokens of the parts that are no text, in order."""
    expanded = lambda p: F.coalesce(p["tokens"], F.element_at(F.create_map(*[F.lit(x) for kv in PART_TOKENS.items() for x in kv]), _kind(p)), F.lit(1))
    return F.transform(F.filter(parts, lambda p: p.isNotNull() & ~_is_text(p)), lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (start, end of each assistant content in code points), attachments, attachment_tokens.

    messages: conv_id, turn, role and text, or parts (PARTS) in place of text; more columns are left out. Turns go
    by turn, equal turns by role and content; null roles and texts are empty. A null conv_id is a conversation. An
    empty table gives an empty result.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)) if "parts" in messages.columns else text_parts(F.col("text").cast("string"))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", flatten(F.col("parts")).alias("content"), attachments(F.col("parts")).alias("files"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEPARATOR))
    rows = rows.withColumn("head", F.length(head)).withColumn("written", F.concat(head, "content", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum(F.length("written")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("upto") - F.length("written") + F.col("head")
    span = F.when(F.col("role") == "assistant", F.struct(begin.alias("start"), (begin + F.length("content")).alias("end")))
    rows = rows.select("conv_id", F.struct("nth", "written", span.alias("span"), "files").alias("turn"))
    turns = F.sort_array(F.collect_list("turn"))
    done = rows.groupBy("conv_id").agg(turns.alias("turns"))
    files = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: F.struct(t["nth"].alias("turn"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return done.select(
        "conv_id",
        F.array_join(F.col("turns.written"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(
        pieces, lambda p: F.struct(unescape(F.substring_index(body(p), SEPARATOR, 1)).alias("role"), unescape(F.substring_index(body(p), SEPARATOR, -1)).alias("text"))
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, read from the formatted string."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("learnt", loss_text(F.col("formatted"), F.col("loss")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests as SQL over a table ``conversations``; {extra} adds rows (conv_id, turn, role, text).
DIGEST_SQL = r"""
WITH messages AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES {extra}) AS v(conv_id, turn, role, text)
), escaped AS (
    SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'),
        '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS content
    FROM messages
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content)) AS turns_sha256,
    coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, content), '')) AS loss_sha256,
    sum(length(role) + length(content) + 33)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
