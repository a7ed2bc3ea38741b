import io
import json
import zipfile

import pytest
from test_sources import book

from folioforge import __main__ as cli
from folioforge.config import Annotations, Config
from folioforge.plans import books


def test_txt_from_file_to_file(spark, tmp_path):
    src, out = tmp_path / "a.txt", tmp_path / "o.txt"
    src.write_text("First paragraph here.\n\n \n\nSecond one.", encoding="utf-8")
    cfg = Config("fr", output_mode="bilingual", annotations=Annotations())
    found = books.decided(spark, str(src), cfg, str(tmp_path / "job")).cache()
    books.write_book(spark, str(src), found, str(out), cfg)
    assert out.read_text(encoding="utf-8") == "〔註〕 〈註〉背景補充：First paragraph he\nFirst paragraph here.\n〈譯〉First paragraph here.\n\n \n\nSecond one.\n〈譯〉Second one."
    assert books.summary(found) == {"segments": 2, "restored": 2, "missing": 0, "prefilled": 0, "notes": 1, "failed": 0}
    again = books.decided(spark, str(src), cfg, str(tmp_path / "job"))
    assert books.summary(again)["prefilled"] == 2


def test_epub_from_file_to_file(spark, tmp_path):
    src, out = tmp_path / "a.epub", tmp_path / "o.epub"
    src.write_bytes(book(["<p>One <i>x</i> &amp; y</p><p>Two</p>", "<p>All rights reserved</p><p>ISBN</p>"]))
    cfg = Config("繁體中文")
    found = books.decided(spark, str(src), cfg, str(tmp_path / "job")).cache()
    books.write_book(spark, str(src), found, str(out), cfg)
    z = zipfile.ZipFile(io.BytesIO(out.read_bytes()))
    assert "<p>〈譯〉One <i>x</i> &amp; y</p><p>〈譯〉Two</p>" in z.read("OEBPS/c0.xhtml").decode() and "〈譯〉" not in z.read("OEBPS/c1.xhtml").decode()
    assert books.summary(found)["missing"] == 2  # rights pages count
    only = books.decided(spark, str(src), Config("fr", annotations=Annotations()), str(tmp_path / "n"), notes_only=True)
    assert only.where("target IS NOT NULL").count() == 0 and only.where("note_text <> ''").count() == 1
    assert books.estimate_book(spark, str(src), "gpt-4o-mini")["segments"] == 4


def test_errors(spark, tmp_path):
    (tmp_path / "bad.epub").write_bytes(b"x")
    with pytest.raises(ValueError):
        books.book_segments(spark, str(tmp_path / "bad.epub"))
    with pytest.raises(ValueError):
        books.book_segments(spark, "a.pdf")
    with pytest.raises(ValueError):
        books.checked_arguments({"base_url": "https://example.com"})
    with pytest.raises(ValueError):
        books.checked_arguments({"note_profile": "@/etc/passwd"})
    books.checked_arguments({"note_profile": "{}", "base_url": "http://localhost:1"})
    assert books.public({"segments": 3, "usd": 0.1, "text": "secret", "failed": "no"}) == {"segments": 3, "usd": 0.1}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    src = tmp_path / "b.txt"
    src.write_text("One.\n\nTwo.", encoding="utf-8")
    assert cli.main(["estimate", str(src), "--model", "gpt-4o-mini", "--notes"]) == 0
    assert json.loads(capsys.readouterr().out)["source_tokens"] == 4
    assert cli.main(["translate", str(src), "--to", "繁體中文", "--json"]) == 0
    *events, done = map(json.loads, capsys.readouterr().out.splitlines())
    assert [e["event"] for e in events] == ["translating"] * 4 and events[-1]["done"] == events[-1]["of"] == 4
    assert [tuple(r) for r in books.chapters(spark, f"{done['out']}.job").collect()] == [(0, "", "done")]
    assert done["out"].endswith("b.繁體中文.txt") and (tmp_path / "b.繁體中文.txt").read_text(encoding="utf-8") == "〈譯〉One.\n\n〈譯〉Two."
    assert cli.main(["annotate", str(src), "--note-presets", "terms,nope"]) == 0
    assert "nope" in capsys.readouterr().err
