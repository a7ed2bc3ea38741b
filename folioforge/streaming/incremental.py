"""Streams: documents that arrive are segmented, counted and stored once; rolling memory is state by book."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.config import Config
from folioforge.functions import text as T
from folioforge.operators import cache
from folioforge.plans import translate
from folioforge.sources import txt


def arriving_segments(spark: SparkSession, path: str, schema, delimiter: str = "\n", most_files: int = 64) -> DataFrame:
    """A stream of the segments of documents that arrive as Parquet files under a path."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
    s = txt.segments(docs, "doc_id", delimiter)
    return s.withColumn("tokens", T.est_tokens(F.col("source")))


def store_translations(segments: DataFrame, store: str, checkpoint: str, config: Config, translated: Callable[[DataFrame], DataFrame] = translate.translated_offline):
    """Start a query that stores translations of new texts. A batch that is run again adds nothing, as what is there is left out by key."""

    def batch(df: DataFrame, _: int) -> None:
        known = translate.stored(df.sparkSession, store)
        todo = df.select("source").distinct().withColumn("target", F.lit(None).cast("string")).withColumn("apparatus", F.lit(False))
        todo = cache.prefilled(todo, known, config.signature()).where("target IS NULL").drop("prefilled")
        done = translated(todo).withColumn("failed", F.lit(False))
        cache.append(cache.to_store(done, config.signature(), known), store)

    return segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_digests(lines: DataFrame, book: str = "book_id", most: int = 1600) -> DataFrame:
    """A stream of book, chapter, digest: what of a book was read before each chapter, as state of `most` characters a book.

    lines: book, chapter, line, arriving in reading order within a book.
    """
    kind = lines.schema[book].dataType.simpleString()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        digest = state.get[0] if state.exists else ""
        for f in frames:
            f = f.sort_values("chapter")
            out = []
            for line in f["line"]:
                out.append(digest)
                digest = (f"{digest}\n{line}" if digest else line)[-most:]
            yield pd.DataFrame({book: key[0], "chapter": f["chapter"].to_numpy(), "digest": out})
        state.update((digest,))

    return lines.select(F.col(book), F.col("chapter").cast("long").alias("chapter"), "line").groupBy(book).applyInPandasWithState(
        step, f"{book} {kind}, chapter long, digest string", "digest string", "append", "NoTimeout"
    )
