"""Score model replies as they arrive (Structured Streaming form of W6 + J12 + A10).

``responses`` is a streaming DataFrame ``(group_id, attempt, text)``; ``prompts`` is
a static ``(group_id, answers)`` table.  The stream-static join brings the expected
answer count, row-local parsing keeps the usable replies, and a streaming
aggregation keeps per prompt the reply with the smallest attempt seen so far
(state is one row per prompt).  Totals are one aggregate over the result table
(``evaluate.er_metrics``) or, per micro-batch, in ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.replies import parse_yes_no
from quire.operators.evaluate import MAX_ATTEMPTS


def first_usable_replies(responses: DataFrame, prompts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Streaming ``(group_id, attempt, parsed, answers)``: run with output mode ``update``
    or ``complete``."""
    p = prompts.select("group_id", "answers", F.size("answers").alias("_n"))
    usable = responses.where(F.col("attempt") <= max_attempts).join(p, "group_id") \
        .withColumn("parsed", parse_yes_no(F.col("text"))).where(F.size("parsed") == F.col("_n"))
    return usable.groupBy("group_id").agg(
        F.min("attempt").alias("attempt"),
        F.min_by(F.struct("parsed", "answers"), "attempt").alias("_r")) \
        .select("group_id", "attempt", F.col("_r.parsed").alias("parsed"), F.col("_r.answers").alias("answers"))
