"""EPUB books: archives read under limits, chapters and segments as rows, and written again in their order."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import RIGHTS_LEAST_MARKERS, RIGHTS_MARKERS, RIGHTS_MOST_SEGMENTS
from folioforge.sources import markup

# Guards on what an archive may unpack to, and the kinds of rights pages.
MOST_FILE, MOST_ENTRIES, MOST_ENTRY, MOST_TOTAL = 512 << 20, 65_536, 256 << 20, 1 << 30
APPARATUS_TYPES = frozenset(["copyright-page", "imprint", "colophon"])


class MalformedBook(ValueError):
    pass


@dataclass
class Chapter:
    spine_index: int
    href: str
    doc: markup.Document
    apparatus: bool


@dataclass
class Book:
    title: str | None
    chapters: list[Chapter]
    entries: list[tuple[str, bytes]]


def safe_name(name: str) -> bool:
    if not name or name[0] in "/\\" or re.match(r"[^\x00-\x7f]|.:", name[:2]) and name[1:2] == ":":
        return False
    return not {".", ".."} & set(re.split(r"[/\\]", name))


def read_entries(content: bytes, most_entry: int = MOST_ENTRY, most_total: int = MOST_TOTAL) -> list[tuple[str, bytes]]:
    """(name, bytes) in archive order. Sizes are measured while unpacking, not taken from the archive's word."""
    if len(content) > MOST_FILE:
        raise MalformedBook("file larger than the limit")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise MalformedBook(f"not an archive: {e}") from e
    names = archive.infolist()
    if len(names) > MOST_ENTRIES:
        raise MalformedBook("more entries than the limit")
    out, total = [], 0
    for info in names:
        if info.is_dir():
            continue
        if not safe_name(info.filename):
            raise MalformedBook(f"entry name leaves the archive: {info.filename!r}")
        try:
            with archive.open(info) as f:
                data = f.read(most_entry + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
            raise MalformedBook(f"entry {info.filename!r} can't be read: {e}") from e
        total += len(data)
        if len(data) > most_entry or total > most_total:
            raise MalformedBook(f"entry {info.filename!r} exceeds the size limit")
        out.append((info.filename, data))
    return out


def _attribute(tag: str, key: str) -> str | None:
    m = re.search(rf'{re.escape(key)}="([^"]*)"', tag)
    return m and m[1]


def _tags(text: str, local: str) -> list[str]:
    return re.findall(rf"<(?:[^\s:>/<]+:)?{local}(?=[\s>/])[^>]*", text)


def package_path(container: str) -> str | None:
    return _attribute(container, "full-path")


def parse_package(opf: str) -> tuple[dict[str, str], list[str], str | None]:
    """Manifest (id -> href), spine (ids in order), title."""
    manifest = {i: h for t in _tags(opf, "item") if (i := _attribute(t, "id")) is not None and (h := _attribute(t, "href")) is not None}
    spine = [i for t in _tags(opf, "itemref") if (i := _attribute(t, "idref")) is not None]
    title = re.search(r"(?s)<(?:[^\s:>/<]+:)?title(?=[\s>/])[^>]*>(.*?)</", opf)
    return manifest, spine, title[1].strip() if title else None


def declared_apparatus(opf: str, navigation: list[str]) -> set[str]:
    """Hrefs, without fragments, that the book itself names as rights pages."""
    out = set()
    for t in _tags(opf, "reference"):
        if (_attribute(t, "type") or "").lower() in APPARATUS_TYPES and (h := _attribute(t, "href")):
            out.add(h.split("#")[0])
    for nav in navigation:
        for t in _tags(nav, "a"):
            kinds = (_attribute(t, "epub:type") or _attribute(t, "type") or "").lower().split()
            if APPARATUS_TYPES & set(kinds) and (h := _attribute(t, "href")):
                out.add(h.split("#")[0])
    return out


def looks_like_apparatus(doc: markup.Document) -> bool:
    if len(doc.segments) > RIGHTS_MOST_SEGMENTS:
        return False
    low = "\n".join(re.sub("⟦[^⟧]*(⟧|$)|⟧", "", s.source) for s in doc.segments).lower()
    return sum(m in low for m in RIGHTS_MARKERS) >= RIGHTS_LEAST_MARKERS


def parse_book(content: bytes) -> Book:
    entries = read_entries(content)
    by_name = dict(entries)

    def text(name: str) -> str:
        if name not in by_name:
            raise MalformedBook(f"{name} is missing")
        return by_name[name].decode("utf-8", "replace")

    path = package_path(text("META-INF/container.xml"))
    if path is None:
        raise MalformedBook("the container names no package")
    opf, base = text(path), path.rpartition("/")[0] + "/" if "/" in path else ""
    manifest, spine, title = parse_package(opf)
    hrefs = [manifest[i] for i in spine if i in manifest]
    navigation = [by_name[base + h].decode("utf-8", "replace") for t in _tags(opf, "item") if "nav" in (_attribute(t, "properties") or "").split() and base + (h := _attribute(t, "href") or "") in by_name]
    declared = declared_apparatus(opf, navigation)
    chapters = []
    for href in hrefs:
        name = base + href
        if re.search(r"(?i)\.(xhtml|html|htm)$", name) and name in by_name:
            doc = markup.parse(by_name[name].decode("utf-8", "replace"))
            chapters.append(Chapter(len(chapters), name, doc, href in declared or looks_like_apparatus(doc)))
    if not chapters:
        raise MalformedBook("no chapters")
    return Book(title, chapters, entries)


def write_book(book: Book, targets: dict[tuple[str, int], str], notes: dict[tuple[str, int], tuple[str, str]], bilingual: bool, lang: str, note_lang: str | None = None) -> bytes:
    """The archive with targets and notes (markup, by href and block) written in: mimetype first and stored, the rest deflated in their order."""
    made: dict[str, str] = {}
    for c in book.chapters:
        own = {} if c.apparatus else {s.block_index: targets[c.href, s.block_index] for s in c.doc.segments if (c.href, s.block_index) in targets}
        beside = {} if c.apparatus else {s.block_index: notes[c.href, s.block_index] for s in c.doc.segments if (c.href, s.block_index) in notes}
        text = markup.rendered(c.doc, own, beside, bilingual, lang, note_lang)
        if own and bilingual:
            text = markup.with_style(text, markup.BILINGUAL_STYLE)
        if beside:
            text = markup.with_style(text, markup.NOTE_STYLE)
        made[c.href] = text
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in sorted(book.entries, key=lambda e: e[0] != "mimetype"):
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, made[name].encode() if name in made else data)
    return out.getvalue()


SEGMENTS = "path string, title string, spine_index int, href string, apparatus boolean, block_index int, source string, placeholders map<string,string>, error string"


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the books under a path; the size limit is pushed to the listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path).where(F.col("length") <= MOST_FILE).select("path", "content")


def epub_segments(books: DataFrame) -> DataFrame:
    """Segments of books given as path, content. A malformed book is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SEGMENTS.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    book = parse_book(bytes(content))
                    rows = [(path, book.title, c.spine_index, c.href, c.apparatus, s.block_index, s.source, s.placeholders, None) for c in book.chapters for s in c.doc.segments]
                except ValueError as e:
                    rows = [(path, None, None, None, None, None, None, None, str(e))]
                frame = pd.DataFrame(rows, columns=columns)
                yield frame.astype({"spine_index": "Int32", "block_index": "Int32", "apparatus": "boolean"})

    return books.select("path", "content").mapInPandas(run, SEGMENTS)


def epub_entries(books: DataFrame) -> DataFrame:
    """path, seq, name, content of the archives' entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(path, i, n, d) for i, (n, d) in enumerate(read_entries(bytes(content)))], columns=["path", "seq", "name", "content"])

    return books.select("path", "content").mapInPandas(run, "path string, seq int, name string, content binary")


def rendered_books(books: DataFrame, decisions: DataFrame, bilingual: bool, lang: str) -> DataFrame:
    """path, content with the decisions written in: path, href, block_index, target (markup), note_pos, note (markup)."""
    by_book = decisions.groupBy("path").agg(F.collect_list(F.struct("href", "block_index", "target", "note_pos", "note")).alias("decisions"))
    x = books.select("path", "content").join(by_book, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content, found in zip(b["content"], b["decisions"], strict=True):
                rows = [] if found is None else list(found)
                targets = {(r["href"], r["block_index"]): r["target"] for r in rows if r["target"] is not None}
                notes = {(r["href"], r["block_index"]): (r["note_pos"] or "after", r["note"]) for r in rows if r["note"]}
                out.append(write_book(parse_book(bytes(content)), targets, notes, bilingual, lang))
            yield pd.DataFrame({"path": b["path"], "content": out})

    return x.mapInPandas(run, "path string, content binary")
