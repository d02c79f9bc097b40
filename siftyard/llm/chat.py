"""Chat formatting: multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask marks what the assistant says. Context roles (`system`) keep their role and are nobody's turn.
The result has one row for each message and perspective: the rendered segment and its places (code points) in the
rendered dialogue. So no conversation, however long, has to fit in a row or a task: places are running sums inside
blocks of turns plus the sums of earlier blocks. `assemble` joins the segments of each dialogue where that is wanted.

Edge cases: a null role speaks as `unknown`; a null text is empty; a null conversation id is a conversation of its own;
null turns come first; ties go by role, then text; repeated rows are repeated messages. A conversation of context
roles only has no perspective and gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftyard.llm.common import read

CONTEXT_ROLES = ("system",)
BLOCK_TURNS = 256
END = "<|end|>\n"


def _header(role: Column, perspective: Column, context: tuple[str, ...]) -> Column:
    return (
        F.when(role.isin(*context), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .when(role == perspective, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))
    )


def rotate(conversations: DataFrame, context: tuple[str, ...] = CONTEXT_ROLES, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, start, end, masked, mask_start, mask_end (null where not masked)."""
    said = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    people = said.filter(~F.col("role").isin(*context)).select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    rows = said.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    rows = rows.withColumn("masked", F.col("role") == F.col("perspective")).withColumn("header", _header(F.col("role"), F.col("perspective"), context))
    rows = rows.withColumn("size", (F.length("header") + F.length("text") + len(END)).cast("long"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 60))))
    key = ["conv_id", "perspective"]
    inside = Window.partitionBy(*key, "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key, "block").agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    blocks = blocks.select(*[F.col(x).alias(f"b_{x}") for x in (*key, "block")], "base")
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(
        blocks, F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("perspective") == F.col("b_perspective")) & (F.col("block") == F.col("b_block"))
    )
    end = F.col("base") + F.col("upto")
    start = end - F.col("size")
    return placed.select(
        "conv_id", "perspective", "turn", F.col("role").alias("speaker"),
        F.concat("header", "text", F.lit(END)).alias("segment"), start.alias("start"), end.alias("end"), "masked",
        F.when(F.col("masked"), start + F.length("header")).alias("mask_start"), F.when(F.col("masked"), end).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, rendered, masks: whole dialogues, for conversations that are known to fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    return segments.groupBy("conv_id", "perspective").agg(parts.alias("p")).select(
        "conv_id", "perspective", F.array_join(F.col("p.segment"), "").alias("rendered"),
        F.transform(F.filter("p", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


ORACLE = """
WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM s WHERE role <> 'system'),
r AS (SELECT s.*, p.perspective, s.role = p.perspective AS masked,
             CASE WHEN s.role = 'system' THEN '<|system|>' || chr(10) WHEN s.role = p.perspective THEN '<|assistant|>' || chr(10)
                  ELSE '<|user:' || s.role || '|>' || chr(10) END AS header
      FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
z AS (SELECT *, header || text || '<|end|>' || chr(10) AS segment FROM r),
e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM z)
SELECT conv_id, perspective, turn, role AS speaker, segment, "end" - length(segment) AS start, "end", masked,
       CASE WHEN masked THEN "end" - length(segment) + length(header) END AS mask_start, CASE WHEN masked THEN "end" END AS mask_end
FROM e
"""
