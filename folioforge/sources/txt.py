"""Plain text: one segment a paragraph that isn't blank; blank paragraphs keep their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the path), text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("book_id"), F.col("value").alias("text"))


def paragraphs(books: DataFrame, key: str = "doc_id", delimiter: str = "\n\n") -> DataFrame:
    """key, block_index, source of all paragraphs, blank ones too. A generator on the scan: no shuffle."""
    parts = F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), _quoted(delimiter))
    return books.where("text IS NOT NULL").select(key, F.posexplode(parts).alias("block_index", "source"))


def segments(books: DataFrame, key: str = "doc_id", delimiter: str = "\n\n") -> DataFrame:
    """key, block_index, source of the paragraphs that aren't blank; numbers keep the gaps."""
    return paragraphs(books, key, delimiter).where(~T.is_blank(F.col("source")))


def _quoted(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def rendered(paragraphs: DataFrame, decisions: DataFrame, bilingual: bool = False, key: str = "doc_id", delimiter: str = "\n\n") -> DataFrame:
    """key, text: paragraphs joined again with the decisions written in.

    decisions: key, block_index, target (placeholders restored), note_pos, note. A target replaces its paragraph or stands
    under it; a note is a line above it or below all.
    """
    x = paragraphs.join(decisions, [key, "block_index"], "left")
    slot = slot_text(F.col("source"), F.col("target"), F.col("note_pos"), F.col("note"), bilingual)
    x = x.select(key, "block_index", slot.alias("slot"))
    parts = F.sort_array(F.collect_list(F.struct("block_index", "slot")))
    return x.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["slot"]), delimiter).alias("text"))


def slot_text(source, target, note_pos, note, bilingual: bool):
    """What stands in a paragraph's place."""
    body = F.concat_ws("\n", source, target) if bilingual else F.coalesce(target, source)
    line = F.concat(F.lit(T.NOTE_PREFIX + " "), note)
    noted = note.isNotNull() & ~T.is_blank(note)
    return F.when(noted & (note_pos == "before"), F.concat_ws("\n", line, body)).when(noted, F.concat_ws("\n", body, line)).otherwise(body)
