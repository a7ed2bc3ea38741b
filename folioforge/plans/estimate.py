"""The flagship plan: what a run over each book would cost, without any request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import cost
from folioforge.operators import segments as S


def estimate(segments: DataFrame, book: list[str], chapter: list[str], model: str, level: str = "sentence", density: str | None = None) -> DataFrame:
    """book, segments, source_tokens, tokens_in, tokens_out, usd and, with a density, the same of notes. Rights pages cost nothing.

    One pass over the segments and one shuffle of a row a chapter; the second grouping is by a prefix of the first.
    """
    has = S.apparatus(segments, chapter).select(*chapter, "apparatus")
    t = S.chapter_totals(segments, chapter).join(has, chapter)
    x = t.groupBy(*book).agg(F.sum("segments").alias("segments"), F.coalesce(F.sum(F.when(~F.col("apparatus"), F.col("tokens"))), F.lit(0)).alias("source_tokens"))
    tin, tout = cost.estimated_tokens(F.col("source_tokens"), level)
    x = x.withColumn("tokens_in", tin).withColumn("tokens_out", tout)
    x = x.withColumn("usd", cost.cost_usd(F.lit(model), F.col("tokens_in"), F.col("tokens_out")))
    if density is not None:
        nin, nout = cost.estimated_note_tokens(F.col("tokens_in"), density)
        x = x.withColumn("note_tokens_in", nin).withColumn("note_tokens_out", nout)
        x = x.withColumn("note_usd", cost.cost_usd(F.lit(model), F.col("note_tokens_in"), F.col("note_tokens_out")))
    return x
