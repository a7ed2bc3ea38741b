"""HTML pages as tables: segments, tokens and rendering, one document a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.sources import markup

SEGMENT = "block_index int, tag string, source string, placeholders map<string,string>"


def page_segments(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, block_index, tag, source, placeholders: the leaf blocks of each page with text. Null pages have none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, source in zip(b["key"], b["html"], strict=True):
                if source is not None:
                    doc = markup.parse(source, lenient=True)
                    rows += [(k, s.block_index, doc.tokens[s.first].name, s.source, s.placeholders) for s in doc.segments]
            yield pd.DataFrame(rows, columns=["key", "block_index", "tag", "source", "placeholders"])

    made = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, {SEGMENT}")
    return made.withColumnRenamed("key", key)


def page_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, token, kind, name, raw: all tokens; joined in order they are the page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, t.kind, t.name, t.raw) for k, source in zip(b["key"], b["html"], strict=True) if source is not None for i, t in enumerate(markup.tokens_of(source, lenient=True))]
            yield pd.DataFrame(rows, columns=["key", "token", "kind", "name", "raw"])

    made = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, token int, kind string, name string, raw string")
    return made.withColumnRenamed("key", key)


def joined_pages(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """key, html of the tokens: the round trip of page_tokens. A page's tokens meet in one row, as the page did."""
    parts = F.sort_array(F.collect_list(F.struct("token", "raw")))
    return tokens.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["raw"]), "").alias("html"))


def rendered_pages(pages: DataFrame, decisions: DataFrame, bilingual: bool, lang: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, html with the decisions written in: decisions are key, block_index, target (markup), note_pos, note (markup), null where there is none."""
    by_page = decisions.groupBy(key).agg(F.collect_list(F.struct("block_index", "target", "note_pos", "note")).alias("decisions"))
    kind = pages.schema[key].dataType.simpleString()
    x = pages.select(key, html).join(by_page, key, "left").select(F.col(key).alias("key"), F.col(html).alias("html"), "decisions")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, found in zip(b["html"], b["decisions"], strict=True):
                rows = [] if found is None else list(found)
                targets = {r["block_index"]: r["target"] for r in rows if r["target"] is not None}
                notes = {r["block_index"]: (r["note_pos"] or "after", r["note"]) for r in rows if r["note"]}
                text = None if source is None else markup.rendered(markup.parse(source, lenient=True), targets, notes, bilingual, lang)
                if text is not None and targets and bilingual:
                    text = markup.with_style(text, markup.BILINGUAL_STYLE)
                if text is not None and notes:
                    text = markup.with_style(text, markup.NOTE_STYLE)
                out.append(text)
            yield pd.DataFrame({"key": b["key"], "html": out})

    return x.mapInPandas(run, f"key {kind}, html string").withColumnRenamed("key", key)
