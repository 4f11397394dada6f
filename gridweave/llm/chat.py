"""Multi-party perspective rotation of dialogues.

For every participant of a conversation (distinct role), the whole dialogue is rendered with that speaker as the
assistant and every other speaker as a named user. Each message carries its text, its character range in the rendering
and its mask: 1 where the speaker is the one to learn from, else 0. Only DataFrame functions are used, and a
conversation that holds very many turns is never gathered: messages are sorted over the whole table by ranges of
(conversation, turn, speaker, text), a conversation's spans are the ranges that it lies in, and positions are running sums
within a span, shifted by the sums of the spans before. So spans hold about as many messages whatever the turns' values,
nulls included; only messages equal in all four columns can't be told apart and share a span.

Edge cases: a null role speaks as `unknown`; a null text is an empty message; a null conv_id is a conversation of its
own; rows that repeat a turn are kept, ordered by turn (null first), role and text, identical rows as they come; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.common import Workspace

#: Messages of a span, about; no fewer spans than shuffle partitions are used.
SPAN = 50_000


def _render(speaker: Column, viewer: Column, text: Column) -> Column:
    return F.when(speaker == viewer, F.concat(F.lit("<|assistant|>\n"), text, F.lit("<|end|>\n"))).otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"), text, F.lit("<|end|>\n")))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, mask, begin, end, rendered: a row per perspective and message.

    begin and end bound the message's own text within the rendering of the conversation; the rendering is the `rendered`
    parts of one perspective in order.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    viewers = rows.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    spark = conversations.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // SPAN))
    # Written, because a range's number must be the same in all that follows.
    rows = rows.repartitionByRange(ranges, "conv_id", "turn", "speaker", "text").withColumn("span", F.spark_partition_id())
    rows = Workspace(spark, "chat").write(rows, "messages")
    spans = rows.select("conv_id", "span").distinct()
    x, v = spans.alias("x"), viewers.alias("v")
    seats = x.join(v, F.col("x.conv_id").eqNullSafe(F.col("v.conv_id"))).select("x.conv_id", "x.span", "perspective")
    m, s = rows.alias("m"), seats.alias("s")
    seen = m.join(s, F.col("m.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("m.span") == F.col("s.span"))).select("m.*", "perspective")
    seen = seen.withColumn("rendered", _render(F.col("speaker"), F.col("perspective"), F.col("text"))).withColumn("size", F.length("rendered").cast("long"))
    # Running sums in two steps: within a span of turns, and over the spans before. A message's size differs between
    # views by its head only, so a span's size for a viewer comes from the sizes of its speakers.
    by_speaker = rows.groupBy("conv_id", "span", "speaker").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("text").cast("long")).alias("chars"))
    own, other = (F.length(_render(F.col("speaker"), w, F.lit(""))) for w in (F.col("speaker"), F.lit("")))
    t, u = by_speaker.alias("t"), seats.alias("u")
    met = t.join(u, F.col("t.conv_id").eqNullSafe(F.col("u.conv_id")) & (F.col("t.span") == F.col("u.span"))).select("t.*", "perspective")
    sums = met.groupBy("conv_id", "perspective", "span").agg(F.sum(F.col("chars") + F.col("k") * F.when(F.col("speaker") == F.col("perspective"), own).otherwise(other)).alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("conv_id", "span", "perspective").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    a, b = seen.alias("a"), shifts.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.perspective") == F.col("b.perspective")) & (F.col("a.span") == F.col("b.span"))
    joined = a.join(b, same).select("a.*", "shift")
    own = F.col("speaker") == F.col("perspective")
    head = F.length("rendered") - F.length("text") - F.length(F.lit("<|end|>\n"))
    begin = (F.col("shift") + F.col("at") + head).cast("long")
    return joined.select("conv_id", "perspective", "turn", "speaker", F.when(own, "assistant").otherwise("user").alias("role"), own.cast("int").alias("mask"), begin.alias("begin"), (begin + F.length("text")).cast("long").alias("end"), "rendered")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m),
s AS (
  SELECT m.*, v.perspective,
    CASE WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) || text || '<|end|>' || chr(10) AS rendered
  FROM m JOIN v ON m.conv_id IS NOT DISTINCT FROM v.conv_id
), r AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(rendered) - length(text) - 8 AS "begin"
  FROM s
)
SELECT conv_id, perspective, turn, speaker, CASE WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
  CAST(speaker = perspective AS INTEGER) AS mask, "begin", "begin" + length(text) AS "end", rendered
FROM r
"""
