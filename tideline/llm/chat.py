"""Chat formatting by grammar round trip, in DataFrame functions only.

A conversation is rendered to one string::

    conversation := turn*
    turn         := "<s>" role "\\n" body "</s>"              (assistant)
                  | "[INST]" role "\\n" body "[/INST]"        (every other role)

A body holds no bare mark (``<s> </s> [INST] [/INST]``). Each turn is first rendered as it is and parsed again; where
the parser does not give the source back, or the body holds a bare mark, the body is escaped: every mark-like string,
with however many backslashes behind its bracket, gets one backslash more, which the reader takes off again. The
rendered conversation is parsed once more as a whole and compared with its source; a difference raises an error.

Defined results: null text and null role are empty; null conv_id is a conversation of its own; rows are ordered by
(turn, role, text), null turns first; repeated rows are turns of their own; roles other than ``[a-z_]+`` are written as
``=`` and hexadecimal UTF-8. An empty table gives an empty table; other columns are left out.

A conversation is one output string, so one row and one task hold it whole; that is the operator's result, not a
collected group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ANY_MARK = r"([<\[])(\\*)(/?(?:INST\]|s>))"
ESCAPED_MARK = r"([<\[])\\(\\*)(/?(?:INST\]|s>))"
BARE_MARK = r"[<\[]/?(?:INST\]|s>)"
TURN = r"(?s)(?:<s>|\[INST\])([^\n]*)\n(.*?)(?:</s>|\[/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ANY_MARK, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED_MARK, "$1$2$3")


def write_role(role: Column) -> Column:
    return F.when(role.rlike(r"\A[a-z_]+\z"), role).otherwise(F.concat(F.lit("="), F.hex(role.cast("binary"))))


def read_role(role: Column) -> Column:
    return F.when(role.startswith("="), F.decode(F.unhex(F.substring(role, 2, 1 << 30)), "UTF-8")).otherwise(role)


def render_turn(role: Column, body: Column) -> Column:
    said = role == "assistant"
    return F.concat(
        F.when(said, F.lit("<s>")).otherwise(F.lit("[INST]")), write_role(role), F.lit("\n"), body,
        F.when(said, F.lit("</s>")).otherwise(F.lit("[/INST]")),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered string: array<struct<role, text>>, unescaped."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(read_role(r).alias("role"), unescape(b).alias("text")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points, one for each assistant body), n_turns."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = render_turn(F.col("role"), F.col("text"))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("trial", plain)
    whole = (parse(F.col("trial")) == source) & ~F.col("text").rlike(BARE_MARK)
    rows = rows.withColumn("body", F.when(whole, F.col("text")).otherwise(escape(F.col("text")))).drop("trial")
    rows = rows.withColumn("rendered", render_turn(F.col("role"), F.col("body")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(order), F.lit(0)))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "role", "text", "body", "rendered"))).alias("turns"))
    out = turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t.rendered), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t.role == "assistant"),
            lambda t: F.struct(
                (t.start + F.length(F.lit("<s>assistant\n"))).cast("long").alias("start"), F.length(t.body).cast("long").alias("length")
            ),
        ).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"),
        F.size("turns").cast("long").alias("n_turns"),
    )
    same = parse(F.col("formatted")) == F.col("source")
    return out.select(
        "conv_id",
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse back to its source"))).alias("formatted"),
        "loss_spans",
        "n_turns",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and their loss masks give back."""
    text = F.col("formatted")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(text, (s.start + 1).cast("int"), s.length.cast("int")))), "")
    turns = F.array_join(F.transform(parse(text), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return formatted.select("conv_id", text, turns.alias("turns_text"), loss.alias("loss_text"), F.size(parse(text)).cast("long").alias("n_turns")).select(
        "conv_id",
        "n_turns",
        F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_conversations(conversations.unionByName(planted)))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(t, '([<\[])(\\*)(/?(?:INST\]|s>))', '\1\2\\\3', 'g') AS b,
        CASE WHEN regexp_full_match(role, '[a-z_]+') THEN role ELSE '=' || hex(role) END AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + 1 + length(b) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
