"""Whole books from file to file: the three verbs of the command line."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.config import Config, ReaderProfile, checked_output, validate_base_url, write_atomically
from folioforge.functions import text as T
from folioforge.operators import cache
from folioforge.operators import segments as S
from folioforge.plans import annotate, estimate, translate
from folioforge.provider import provider_for
from folioforge.sources import epub, txt

CHAPTER, ORDER = ["book", "chapter", "href"], "block_index"

# What of a result may leave the engine for a caller that isn't trusted.
PUBLIC = ["chapters", "segments", "source_tokens", "tokens_in", "tokens_out", "usd", "restored", "missing", "prefilled", "failed", "notes"]


def book_segments(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, href, block_index, source, placeholders, apparatus, target (null). A malformed book raises ValueError."""
    ext = path.rpartition(".")[2].lower()
    if ext == "txt":
        s = txt.segments(txt.read_txt(spark, path), "book_id")
        marks = S.apparatus(s, ["book_id"]).select("book_id", "apparatus")
        x = s.join(marks, "book_id").select(F.col("book_id").alias("book"), F.lit(0).alias("chapter"), F.lit("").alias("href"), ORDER, "source", F.create_map().cast("map<string,string>").alias("placeholders"), "apparatus")
    elif ext == "epub":
        rows = epub.epub_segments(epub.read_epub(spark, path))
        bad = rows.where("error IS NOT NULL").select("error").first()
        if bad:
            raise ValueError(bad.error)
        x = rows.select(F.col("path").alias("book"), F.col("spine_index").alias("chapter"), "href", ORDER, "source", "placeholders", "apparatus")
    else:
        raise ValueError(f"unsupported format: {path}")
    return x.withColumn("target", F.lit(None).cast("string"))


def estimate_book(spark: SparkSession, path: str, model: str, level: str = "sentence", density: str | None = None) -> dict:
    s = book_segments(spark, path)
    row = estimate.estimate(s, ["book"], CHAPTER, model, level, density).drop("book").first()
    return {"chapters": s.select("chapter").distinct().count()} | (row.asDict() if row else {"segments": 0})


def decided(
    spark: SparkSession, path: str, config: Config, job: str, notes_only: bool = False, base_url: str = "", key: str = "", trusted: bool = False, on: translate.Sink = translate.silent
) -> DataFrame:
    """Segments with target and notes, read from the job's tables, to which all that was asked for has gone.

    trusted: base_url was given by the operator, so it may be remote. on is told of each phase.
    """
    s = book_segments(spark, path)
    provider = lambda: provider_for(config, base_url, key, trusted)
    provider()  # a refused address is told before anything runs
    states = s.groupBy(F.col("chapter").cast("long").alias("idx"), "href").agg(F.lit(1))
    state = lambda name: cache.append(states.select("idx", "href", F.lit(name).alias("status"), F.lit(cache.now()).alias("seq")), f"{job}/chapters")
    state("in_progress")
    cache.set_meta(spark, f"{job}/meta", "config_sig", config.signature())
    cache.set_meta(spark, f"{job}/meta", "target_lang", config.target_lang)
    if notes_only:
        s = s.withColumn("prefilled", F.lit(False)).withColumn("failed", F.lit(False))
    else:
        s = cache.kept(translate.run(s, CHAPTER, ORDER, config, f"{job}/cache", provider, on=on, book=["book"]), f"{job}/translated")
    if config.annotations is not None:
        signature = config.note_signature()
        cache.set_meta(spark, f"{job}/meta", "anno_sig", signature)
        s = annotate.run(s, ["book"], CHAPTER, ORDER, config.annotations, provider, f"{job}/annotations", signature, on)
    else:
        s = s.withColumn("note_pos", F.lit(None).cast("string")).withColumn("note_text", F.lit(None).cast("string"))
    state("done")
    return s


def chapters(spark: SparkSession, job: str) -> DataFrame:
    """idx, href, status of a job's chapters."""
    return cache.chapter_states(cache.read(spark, f"{job}/chapters", cache.STATES))


def write_book(spark: SparkSession, path: str, found: DataFrame, out: str, config: Config) -> None:
    """The book with its decisions written in. One book is one file, so it is put together on the driver."""
    checked_output(path, out)
    note_lang = config.annotations.lang if config.annotations else None
    tag = spark.range(1).select(T.language_tag(F.lit(config.target_lang)), T.language_tag(F.lit(note_lang or config.target_lang))).first()
    live = found.where("NOT apparatus")
    if path.lower().endswith("txt"):
        target = T.name_separators(T.restore(F.col("target"), F.col("placeholders")), F.lit(tag[0]))
        d = live.select(F.col("book").alias("book_id"), ORDER, target.alias("target"), "note_pos", F.col("note_text").alias("note"))
        row = txt.rendered(txt.paragraphs(txt.read_txt(spark, path), "book_id"), d, config.output_mode == "bilingual", "book_id").first()
        write_atomically(out, (row.text if row else "").encode())
        return
    target = T.name_separators(T.restore(T.escape_text(F.col("target")), F.col("placeholders")), F.lit(tag[0]))
    note = F.when(~T.is_blank(F.col("note_text")), T.name_separators(T.escape_text(F.col("note_text")), F.lit(tag[1])))
    rows = live.select("href", ORDER, target.alias("target"), "note_pos", note.alias("note")).collect()
    book = epub.parse_book(bytes(epub.read_epub(spark, path).first().content))
    targets = {(r.href, r.block_index): r.target for r in rows if r.target is not None}
    notes = {(r.href, r.block_index): (r.note_pos or "after", r.note) for r in rows if r.note}
    write_atomically(out, epub.write_book(book, targets, notes, config.output_mode == "bilingual", tag[0], note_lang and tag[1]))


def summary(found: DataFrame) -> dict:
    """Counters of a run."""
    row = cache.render_summary(found, ["book"]).drop("book").first()
    failed = found.where("failed").count()
    return {"segments": row.total, "restored": row.restored, "missing": row.missing, "prefilled": row.prefilled, "notes": row.notes, "failed": failed} if row else {"segments": 0, "failed": 0}


def public(result: dict) -> dict:
    """What an untrusted caller may see: the named counters alone, and only where they are numbers or booleans."""
    return {k: result[k] for k in PUBLIC if isinstance(result.get(k), (int, float, bool))}


def default_output(path: str, lang: str, spark: SparkSession) -> str:
    p = PurePosixPath(path)
    slug = spark.range(1).select(T.file_slug(F.lit(lang))).first()[0]
    return str(p.with_name(f"{p.stem}.{slug}{p.suffix or '.out'}"))


def event(kind: str, **values) -> str:
    """A line of the JSON event stream."""
    return json.dumps({"event": kind} | values, ensure_ascii=False)


def checked_arguments(arguments: dict) -> None:
    """Raise unless an untrusted caller's arguments stay on this machine: no remote endpoint, no file in place of a profile."""
    if arguments.get("base_url"):
        validate_base_url(arguments["base_url"])
    if arguments.get("note_profile"):
        ReaderProfile.load(arguments["note_profile"], allow_file=False)
