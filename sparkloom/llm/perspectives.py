"""Chat rendering from the perspective of every participant.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; system turns stay as they are and have no perspective of their own. One row holds one turn of one
rendering: its text, its place in the rendering and the range that a loss mask covers (the assistant's words and the
end mark). Renderings are the rows in order of place; no conversation is gathered, so a very long one is spread over
tasks: places come from sums over blocks of turns first, then over the turns of a block.

Defined results: null texts render as empty; turns without role belong to one participant without name, apart from any
that has one; turns without conversation form one, apart from all with an id, and turns without number come first;
turns that repeat a number stand in order of role and text; a conversation of system turns only has no rendering;
repeated rows are turns of their own; extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


def perspectives(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    speakers = rows.where(~system).select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()
    own = F.col("role").eqNullSafe(F.col("perspective"))
    head = F.when(system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user|>"), F.coalesce("role", F.lit("")), F.lit("\n")))
    turned = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv").withColumn("head", head).withColumn("rendered", F.concat("head", "text", F.lit("<|end|>\n"))).withColumn("size", F.length("rendered").cast("long")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    who = ["conv_id", "perspective"]
    inside = Window.partitionBy(*who, "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    sums = turned.groupBy(*who, "block").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*who).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    before = before.withColumnsRenamed({c: f"__{c}" for c in (*who, "block")})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*who, "block")]
    placed = turned.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, same)
    start = F.col("start") + F.col("before")
    return placed.select(
        "conv_id", "perspective", "turn", "role", "rendered", start.alias("start"), (start + F.col("size")).alias("end"),
        F.when(own, start + F.length("head")).alias("mask_start"), F.when(own, start + F.col("size") - 1).alias("mask_end"),
    )


SQL = """
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(role = 'system', false) AS system FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE NOT system),
h AS (SELECT r.*, perspective, CASE WHEN system THEN '<|system|>' || chr(10) WHEN role IS NOT DISTINCT FROM perspective THEN '<|assistant|>' || chr(10) ELSE '<|user|>' || coalesce(role, '') || chr(10) END AS head FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
t AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM h),
p AS (SELECT *, CAST(length(rendered) AS BIGINT) AS size, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t)
SELECT conv_id, perspective, turn, role, rendered, start, start + size AS "end", CASE WHEN role IS NOT DISTINCT FROM perspective THEN start + length(head) END AS mask_start, CASE WHEN role IS NOT DISTINCT FROM perspective THEN start + size - 1 END AS mask_end FROM p
"""


def op3_perspectives(spark, sf_dir: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
