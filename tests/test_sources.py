import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.sources import epub, formats, markup, pages, txt

CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def book(chapters, guide="", extra=()):
    items = "".join(f'<opf:item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(chapters)))
    refs = "".join(f'<opf:itemref idref="c{i}"/>' for i in range(len(chapters)))
    opf = f"<package><metadata><dc:title> My Book </dc:title></metadata><manifest>{items}<item id='x'/></manifest><spine>{refs}<itemref idref=\"gone\"/></spine>{guide}</package>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", opf)
        for i, c in enumerate(chapters):
            z.writestr(f"OEBPS/c{i}.xhtml", f"<html><head><title>t</title></head><body>{c}</body></html>")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def sources(html):
    return [(s.source, s.placeholders) for s in markup.parse(html).segments]


def test_segments():
    assert sources("<div><p>One <b>red</b> car</p><p> </p><ul><li>two</li></ul>loose</div>") == [("One ⟦1⟧red⟦/1⟧ car", {"1": "<b>", "/1": "</b>"}), ("two", {})]
    assert sources("<p>a<br/>b<!-- c --><![CDATA[d]]><?e?></p>") == [("a⟦C1⟧b⟦C2⟧⟦C3⟧⟦C4⟧", {"C1": "<br/>", "C2": "<!-- c -->", "C3": "<![CDATA[d]]>", "C4": "<?e?>"})]
    assert sources("<x:p>a &amp; b &#65; &#x42;</x:p><p>c &nbsp; &amp;</p>") == [("a & b A B", {}), ("c &nbsp; &amp;", {})]
    assert sources('<p title="a>b">x</p>') == [("x", {})]


def test_end_tags_close_whatever_is_open():
    doc = markup.parse("<div><p>a<b>c</i></p>tail")
    assert doc.text() == "<div><p>a<b>c</i></p>tail" and doc.segments[0].source == "a⟦1⟧c⟦/1⟧"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "text", " ", "<br/>", "<!-- x -->", "&amp;", "<div>", "</div>", '<a href=">">', "</a>", "<", ">", "é"]), max_size=25).map("".join))
def test_round_trip_of_anything(html):
    doc = markup.parse(html, lenient=True)
    assert doc.text() == html
    assert markup.rendered(doc, {}, {}, True, "fr") == html
    assert [s.block_index for s in doc.segments] == list(range(len(doc.segments)))


def test_rendering():
    doc = markup.parse("<body><p id='1'>a</p><p>b</p></body>")
    assert markup.rendered(doc, {0: "A"}, {1: ("after", "N")}, False, "fr") == "<body><p id='1'>A</p><p>b</p>\n<div class=\"folio-note\" dir=\"auto\">〔註〕 N</div></body>"
    got = markup.rendered(doc, {0: "A"}, {0: ("before", "N")}, True, 'x"y', "fr")
    assert got == "<body><div class=\"folio-note\" lang=\"fr\" dir=\"auto\">〔註〕 N</div>\n<p id='1'>a</p>\n<p class=\"folio-translation\" lang=\"x&quot;y\" dir=\"auto\">A</p><p>b</p></body>"


def test_depth_and_malformed():
    with pytest.raises(markup.MalformedMarkup):
        markup.parse("<div>" * 300)
    with pytest.raises(markup.MalformedMarkup):
        markup.parse("<p>a < b</p")


def test_book_and_its_rights_pages():
    rights = "<p>All rights reserved.</p><p>ISBN 1</p>"
    guide = '<guide><reference type="Colophon" href="c2.xhtml#x"/></guide>'
    b = epub.parse_book(book(["<p>One</p><p>Two</p>", rights, "<p>declared</p>"], guide))
    assert b.title == "My Book" and [(c.href, c.apparatus, len(c.doc.segments)) for c in b.chapters] == [("OEBPS/c0.xhtml", False, 2), ("OEBPS/c1.xhtml", True, 2), ("OEBPS/c2.xhtml", True, 1)]


def test_written_book():
    b = epub.parse_book(book(["<p>One</p>", "<p>ISBN</p><p>Library of Congress</p>"]))
    made = epub.write_book(b, {("OEBPS/c0.xhtml", 0): "Un", ("OEBPS/c1.xhtml", 0): "no"}, {}, True, "fr")
    z = zipfile.ZipFile(io.BytesIO(made))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.infolist()[1].compress_type == zipfile.ZIP_DEFLATED
    assert "Un</p>" in z.read("OEBPS/c0.xhtml").decode() and "folio-translation {" in z.read("OEBPS/c0.xhtml").decode() and b"no" not in z.read("OEBPS/c1.xhtml")
    again = epub.parse_book(epub.write_book(b, {}, {}, False, "fr"))
    assert [(n, d) for n, d in again.entries] == b.entries


def test_limits_and_names():
    for name in ("../x", "/x", "C:/x", "a/./b", "a\\..\\b"):
        with pytest.raises(epub.MalformedBook):
            epub.read_entries(book(["<p>a</p>"], extra=[(name, "x")]))
    with pytest.raises(epub.MalformedBook):
        epub.read_entries(book(["<p>a</p>"], extra=[("big", "0" * 5000)]), most_entry=1000)
    with pytest.raises(epub.MalformedBook):
        epub.parse_book(b"not a zip")
    with pytest.raises(epub.MalformedBook):
        epub.parse_book(book([]))


def test_epub_tables(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book(["<p>One <i>x</i></p>", "<p>Two</p>"]))
    (tmp_path / "b.EPUB").write_bytes(b"broken")
    (tmp_path / "c.doc").write_bytes(b"no")
    books = epub.read_epub(spark, str(tmp_path))
    rows = sorted((r.path[-6:], r.spine_index if r.error is None else -1, r.source, r.error is None) for r in epub.epub_segments(books).collect())
    assert rows == [("a.epub", 0, "One ⟦1⟧x⟦/1⟧", True), ("a.epub", 1, "Two", True), ("b.EPUB", -1, None, False)]
    one = books.where(F.col("path").endswith("a.epub"))
    d = epub.epub_segments(one).select("path", "href", "block_index", T.restore(T.escape_text(T.pseudo_translation(F.col("source"))), F.col("placeholders")).alias("target"), F.lit(None).cast("string").alias("note_pos"), F.lit(None).cast("string").alias("note"))
    made = bytes(epub.rendered_books(one, d, False, "fr").first().content)
    assert b"<p>\xe3\x80\x88\xe8\xad\xaf\xe3\x80\x89One <i>x</i></p>" in zipfile.ZipFile(io.BytesIO(made)).read("OEBPS/c0.xhtml")
    assert epub.epub_entries(one).count() == 5
    assert [r.path[-6:] for r in formats.found_books(spark, str(tmp_path)).collect()] != [] and formats.extract(spark, str(tmp_path / "a.epub")).count() == 2
    with pytest.raises(ValueError):
        formats.extract(spark, "x.pdf")


def test_txt(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("one\r\n\r\n \n\ntwo\nmore".encode())
    s = formats.extract(spark, str(tmp_path / "b.txt")).orderBy("block_index").collect()
    assert [(r.block_index, r.source) for r in s] == [(0, "one"), (2, "two\nmore")]
    df = spark.createDataFrame([(1, "a\n\n\n\nb"), (2, None)], "doc_id long, text string")
    p = txt.paragraphs(df)
    d = spark.createDataFrame([(1, 0, "A", "before", "N"), (1, 2, "B", None, None)], "doc_id long, block_index int, target string, note_pos string, note string")
    assert txt.rendered(p, d).first().text == "〔註〕 N\nA\n\n\n\nB"
    assert txt.rendered(p, d, bilingual=True).first().text == "〔註〕 N\na\nA\n\n\n\nb\nB"


def test_pages_with_null_and_empty(spark):
    p = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x<p>y")], "page_id long, html string")
    assert sorted((r.page_id, r.source) for r in pages.page_segments(p).collect()) == [(3, "y")]
    assert {r.page_id: r.html for r in pages.joined_pages(pages.page_tokens(p)).collect()} == {3: "<p>x<p>y"}
