"""Quotation linking: replies find the messages that they quote, and conversations are ordered by reply, without quotes.

A line's quote level is the number of `>` before its text. Lines of level 0 are the message's own; a line that only introduces a quote ("On ...
wrote:") is neither. Passages, the lines of one level in a row, are normalised (lower-case words, whatever the line breaks) and hashed by content: of every
SPAN_GRAMS runs of GRAM words the one with the least hash, so that a passage of GRAM + SPAN_GRAMS - 1 = 7 words or more shares a hash with the message that it
stands in, however either is wrapped. Shorter lines, passages and paragraphs have one hash each. A quoted passage of level n is joined to the latest earlier messages of the
conversation that have its hashes as their own; the message that accounts for most quoted words is what is replied to (ties: the latest), level 1 before deeper levels.

The join is an as-of scan in two levels: inside windows of SPAN turns, then over a conversation's windows, so neither a very long conversation nor a
passage that all its messages share makes rows for pairs or meets in one task. A thread's root is found by pointer jumping, a number of rounds
that grows with the logarithm of its depth.

Defined cases: null text is empty, own text of a message of quotes alone is empty, passages without a word don't link. The text of a message that quotes nothing is returned as
it is; of others the own lines, without white space at either end. Texts are read whole, whatever their length. Without a link reply_to is null and the message
is the root of its thread. Rows that repeat conv_id and turn are each returned, with the link of the turn. Rows with null conv_id or turn don't link. An
empty table gives no rows. Other columns aren't read, so their names may clash. turn must be integral.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from folioforge.llm.common import WordIds, discard, materialise, shingle_hashes, slices
from folioforge.llm.decontamination import normalised_words

#: Turns in a window of the as-of scan. Words of a run that is hashed, and runs in a row of which one is.
SPAN = 1024
GRAM, SPAN_GRAMS = 4, 4

_PARAGRAPHS = re.compile(r"\n[ \t]*\n")
_QUOTE = re.compile(r"[ \t]*(?:>[ \t]?)+")
_INTRODUCES = re.compile(r"(?i)\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*")


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and (level, line) of its quoted lines."""
    lines: list[tuple[int, str]] = []
    for line in (text or "").splitlines():
        m = _QUOTE.match(line)
        lines.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    if not any(n for n, _ in lines):
        return text or "", []
    own = [line for i, (n, line) in enumerate(lines) if n == 0 and not (_INTRODUCES.fullmatch(line) and any(x for x, t in lines[i + 1 : i + 3]))]
    return "\n".join(own).strip(), [x for x in lines if x[0]]


def words_of(lines: list[str]) -> list[bytes]:
    return [w for line in lines for w in normalised_words(line.encode("utf-8", "surrogatepass"))]


def passage_hashes(words: list[bytes], ids: WordIds) -> dict[int, int]:
    """hash -> words that it stands for: of a long passage some of its runs, by content, of a short one itself."""
    if not words:
        return {}
    if len(words) < GRAM + SPAN_GRAMS - 1:
        return {int(shingle_hashes(ids.of(words), len(words)).view(np.int64)[0]): len(words)}
    grams = shingle_hashes(ids.of(words), GRAM)
    return dict.fromkeys(np.unique(sliding_window_view(grams, SPAN_GRAMS).min(axis=1)).view(np.int64).tolist(), 2)


def shorter(found: list[list[bytes]]) -> list[list[bytes]]:
    return [w for w in found if len(w) < GRAM + SPAN_GRAMS - 1]


def units_of(text: str | None, ids: WordIds) -> tuple[str, int, list[tuple[int, int, int]]]:
    """The message's own text, the number of quoted lines that have words, and (hash, level, words) of its passages."""
    own, quoted = parsed(text)
    out = passage_hashes(words_of([own]), ids)
    for part in shorter([words_of([x]) for x in [*own.splitlines(), *_PARAGRAPHS.split(own)]]):
        out |= passage_hashes(part, ids)
    found = [(h, 0, n) for h, n in out.items()]
    held: dict[int, dict[int, int]] = {}
    for level, lines in groupby(quoted, key=lambda x: x[0]):
        own_lines = [words_of([line]) for _, line in lines]
        held.setdefault(level, {}).update(passage_hashes([w for x in own_lines for w in x], ids))
        for part in shorter(own_lines):
            held[level] |= passage_hashes(part, ids)
    found += [(h, level, n) for level, some in held.items() for h, n in some.items()]
    return own, sum(bool(words_of([x])) for _, x in quoted), found


_UNIT = StructType([StructField("hash", LongType()), StructField("level", IntegerType()), StructField("words", IntegerType())])
_UNITS = pa.list_(pa.struct([("hash", pa.int64()), ("level", pa.int32()), ("words", pa.int32())]))


def unquoted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), quotes (lines), units (hash, level, words; level 0 for its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches):
            made = [units_of(text, ids) for text in b.column("text").to_pylist()]
            units = [[{"hash": h, "level": level, "words": n} for h, level, n in found] for _, _, found in made]
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array(units, _UNITS)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role")), *columns], ["conv_id", "turn", "role", "text", "quotes", "units"])

    schema = StructType([messages.schema[c] for c in ("conv_id", "turn", "role")] + [StructField("text", StringType()), StructField("quotes", LongType()), StructField("units", ArrayType(_UNIT))])
    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def quote_links(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, turn, reply_to. lines: conv_id, turn, hash, level, words of passages."""
    key = ["conv_id", "hash"]
    quoted = lines.where("level > 0").groupBy(*key, "turn").agg(F.min(F.struct("level", "words")).alias("q"))
    own = lines.where("level = 0").select(*key, "turn").distinct()
    # only passages that somebody quotes can be joined; one row a passage and message
    own = own.join(quoted.select(*key).distinct(), key, "left_semi")
    x = quoted.select(*key, "turn", "q").unionByName(own.select(*key, "turn", F.lit(None).cast("struct<level:int,words:int>").alias("q")))
    x = x.withColumn("window", F.floor(F.col("turn") / span)).withColumn("has", F.when(F.col("q").isNull(), F.col("turn")))
    each = x.groupBy(*key, "window").agg(F.max("has").alias("m"))
    each = each.withColumn("before", F.max("m").over(W.partitionBy(*key).orderBy("window").rowsBetween(W.unboundedPreceding, -1)))
    here = F.max("has").over(W.partitionBy(*key, "window").orderBy("turn").rangeBetween(W.unboundedPreceding, -1))
    x = x.withColumn("here", here).where("q IS NOT NULL").join(each.select(*key, "window", "before"), [*key, "window"], "left")
    votes = x.select("conv_id", "turn", F.coalesce("here", "before").alias("to"), "q.level", "q.words").where("to IS NOT NULL")
    votes = votes.groupBy("conv_id", "turn", "to").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    return votes.groupBy("conv_id", "turn").agg(F.min_by("to", F.struct("level", -F.col("words"), -F.col("to"))).alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the turn of its root), depth, by pointer jumping."""
    x = links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth"))
    x = materialise(x, "threads")
    while True:
        up = x.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        y = x.join(up, ["conv_id", "up"], "left")
        y = y.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        old, y = x, materialise(y, "threads")
        discard(old)
        x = y.drop("moved")
        x.scratch__ = y.scratch__
        if y.where("moved").isEmpty():
            return x.withColumnRenamed("up", "thread")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, thread, turn, role, text, reply_to, depth, quotes: ordered by the first three, a reply comes after what it replies to.

    text has no quotes; thread is the turn of the thread's first message; quotes counts quoted lines.
    """
    x = materialise(unquoted(messages), "messages")
    lines = x.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.inline("units"))
    links = materialise(quote_links(lines), "links")
    found = links.join(threads(links), ["conv_id", "turn"])
    y = x.drop("units").join(found, ["conv_id", "turn"], "left")
    return y.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "text", "reply_to", F.coalesce("depth", F.lit(0)).alias("depth"), "quotes")
