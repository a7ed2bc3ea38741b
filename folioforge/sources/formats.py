"""One way in for both formats, and the finding of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import book_format
from folioforge.sources import epub, txt

# Folders that hold no books.
SKIPPED = r"(^|/)(\.[^/]*|node_modules|target|venv)/"


def extract(spark: SparkSession, path: str) -> DataFrame:
    """path, href, block_index, source, apparatus of the books under a path, by its extension; any other raises ValueError."""
    ext = path.rpartition(".")[2].lower()
    if ext == "txt":
        s = txt.segments(txt.read_txt(spark, path), "book_id")
        return s.select(F.col("book_id").alias("path"), F.lit("").alias("href"), "block_index", "source", F.lit(False).alias("apparatus"))
    if ext == "epub":
        return epub.epub_segments(epub.read_epub(spark, path)).select("path", "href", "block_index", "source", "apparatus")
    raise ValueError(f"unsupported format: {path}")


def found_books(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of the books in a folder and the folders in it, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    inner = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^\\Q" + folder.rstrip("/") + "\\E/", "")
    ok = book_format(F.col("path")).isNotNull() & ~inner.rlike(SKIPPED) & (F.regexp_count(inner, F.lit("/")) <= 1)
    return files.where(ok).orderBy(F.desc("modificationTime"), "path")
