"""Progress and usage: time left by measured text, and folds of counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_left(chapters: DataFrame, group: list[str]) -> DataFrame:
    """group, seconds_left: by characters measured so far; null before a twentieth is. chapters: chars, seconds (null while not done)."""
    done = F.col("seconds").isNotNull()
    x = chapters.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(done, F.col("chars"))), F.lit(0)).alias("done"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("took"), F.coalesce(F.sum(F.when(~done, F.col("chars"))), F.lit(0)).alias("left")
    )
    known = (F.col("done") > 0) & (F.col("took") > 0) & (F.col("done") * 20 >= F.col("done") + F.col("left"))
    return x.select(*group, F.when(known, F.col("took") / F.col("done") * F.col("left")).alias("seconds_left"))


def usage(batches: DataFrame, group: list[str], order: str) -> DataFrame:
    """Counters summed, failed ids as a sorted set, the first error. batches: translated, failed_ids, tokens_in, tokens_out, error."""
    return batches.groupBy(*group).agg(
        F.sum("translated").alias("translated"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("failed_ids")))).alias("failed_ids"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col(order))).alias("first_error"),
    )
