"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role are merged into one block; the blocks are concatenated:

    ### role:\\n text </part> text </turn>\\n      (without the spaces)

Control strings inside texts are escaped reversibly: a backslash becomes \\b, a
# that starts ### becomes \\h, the < of a closing mark becomes \\l (and a new
line inside a role \\n). No escaped text holds a mark, so splitting at the marks
gives the turns back. The loss mask lists the code point ranges of the
assistant texts in the output, marks excluded.

Cases: rows sort by turn, then role and text (nulls first), repeated rows are
turns of their own; a null text is empty; a null role is written \\0 and read
back as null; a null conversation id is a conversation; an empty table gives an
empty result; other columns of the input are not used. A conversation is one
output value, so it is collected by definition; everything but the mask is
linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, let

TURN_END = "</turn>\n"
PART_END = "</part>"
OPEN = "### "
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\b"))
    t = F.regexp_replace(t, "#(?=##)", r"\\h")
    return F.regexp_replace(t, "<(?=/turn>|/part>)", r"\\l")


def unescaped(text: Column) -> Column:
    t = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(t, F.lit("\\b"), F.lit("\\"))


def _header(role: Column) -> Column:
    name = F.coalesce(F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\\0"))
    return F.concat(F.lit(OPEN), name, F.lit(":\n"))


def _role(header: Column) -> Column:
    """The role of a header without its ``:`` and new line."""
    name = F.substr(header, F.lit(len(OPEN) + 1))
    return F.when(name != "\\0", unescaped(F.replace(name, F.lit("\\n"), F.lit("\n"))))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Per conversation: id, ``formatted`` and ``loss_spans``, an array of
    (start, length) in code points from 0."""
    one = F.struct(col(turns, turn_col).alias("turn"), col(turns, role_col).alias("role"),
                   F.coalesce(col(turns, text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(col(turns, conv_col).alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("t"))

    def pieces(t: Column) -> Column:
        """Mark before, escaped text and mark after each turn; the marks
        merge neighbours of one role into one block."""
        same = lambda x, i: F.get(t, i)["role"].eqNullSafe(x["role"])
        return F.transform(t, lambda x, i: F.struct(
            F.when((i > 0) & same(x, i - 1), F.lit(PART_END)).otherwise(_header(x["role"])).alias("before"),
            escaped(x["text"]).alias("text"),
            F.when((i + 1 < F.size(t)) & same(x, i + 1), F.lit("")).otherwise(F.lit(TURN_END)).alias("after"),
            F.coalesce(x["role"] == LEARNED, F.lit(False)).alias("learned")))

    spans = lambda p: F.aggregate(
        p, F.struct(F.lit(0).cast("long").alias("at"),
                    F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["before"]) + F.char_length(x["text"]) + F.char_length(x["after"])).alias("at"),
            F.when(x["learned"], F.array_append(s["spans"], F.struct(
                (s["at"] + F.char_length(x["before"])).alias("start"),
                F.char_length(x["text"]).cast("long").alias("length")))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    built = lambda p: F.struct(
        F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["text"], x["after"])), "").alias("formatted"),
        spans(p).alias("loss_spans"))
    out = chats.select("conv", let(pieces(F.col("t")), built).alias("o"))
    return out.select(F.col("conv").alias(conv_col), "o.formatted", "o.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, TURN_END), lambda b: b != "")

    def turns(b: Column) -> Column:
        end = F.instr(b, ":\n")
        role = _role(F.substr(b, F.lit(1), end - 1))
        return F.transform(F.split(F.substr(b, end + 2), PART_END),
                           lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What reading the output back gives, per conversation."""
    turns = F.transform(F.col("t"), lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n")))
    read = chats.select(conv_col, "formatted", read_turns(F.col("formatted")).alias("t"),
                        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        conv_col, F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def with_marks_conversation(turns: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds conversation -7, whose texts hold the marks themselves."""
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(LEARNED)).alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL AS joins,
             lead(role) OVER w IS NOT DISTINCT FROM role AND lead(turn) OVER w IS NOT NULL AS joined FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
n AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
             + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
             + (length(text) - length(replace(replace(text, '</turn>', ''), '</part>', ''))) // 7
             + CASE WHEN joins THEN 7 ELSE 6 + length(role) END + CASE WHEN joined THEN 0 ELSE 8 END AS chars FROM p)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
