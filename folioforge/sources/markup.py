"""Byte-faithful reading and writing of XHTML, as a flat list of tokens.

A document is cut into tokens whose raw texts, joined, are the document. An end tag closes whatever element is open, whatever
its name; elements still open at the end are closed there. Start tags know the place of their end, so a leaf block is a range of
tokens; nothing is built as a tree. Leaf blocks with text are segments, in document order, counted densely.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Elements through which text flows, and elements that hold a paragraph.
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "i", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr",
    "br", "img",
}
BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "figcaption", "caption", "td", "th", "div", "label", "summary"}
# The five entities that XML knows.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
MOST_DEPTH = 256
NOTE_PREFIX = "〔註〕"

_TOKEN = re.compile(
    r"""(?s)(?P<aside><!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>)|(?P<decl><![^>]*>)|(?P<end></[^>]*>)"""
    r"""|(?P<tag><(?:[^<>"']|"[^"]*"|'[^']*')+>)|(?P<text>[^<]+)|(?P<bad><)"""
)
_NAME = re.compile(r"<\s*([^\s/>]+)")
_REF = re.compile(r"&([^;&\s]*);?")


class MalformedMarkup(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str  # start, empty, end, text, aside
    raw: str
    name: str = ""
    partner: int = -1  # of a start tag: its end, or the number of tokens; of an end tag: its start


@dataclass(slots=True)
class Segment:
    block_index: int
    source: str
    placeholders: dict[str, str]
    first: int  # token of the start tag
    last: int  # token of the end tag


@dataclass
class Document:
    tokens: list[Token]
    segments: list[Segment] = field(default_factory=list)

    def text(self) -> str:
        return "".join(t.raw for t in self.tokens)


def local_name(name: str) -> str:
    return name.rpartition(":")[2].lower()


def tokens_of(source: str, lenient: bool = False) -> list[Token]:
    out: list[Token] = []
    opened: list[int] = []
    for m in _TOKEN.finditer(source):
        kind, raw = m.lastgroup, m[0]
        if kind == "bad":
            if not lenient:
                raise MalformedMarkup(f"unclosed markup at {m.start()}")
            kind = "text"
        if kind == "tag":
            name = _NAME.match(raw)
            kind = "empty" if raw.endswith("/>") else "start"
            if kind == "start":
                if len(opened) >= MOST_DEPTH and not lenient:
                    raise MalformedMarkup(f"elements nest deeper than {MOST_DEPTH}")
                opened.append(len(out))
            out.append(Token(kind, raw, local_name(name[1]) if name else ""))
        elif kind == "end":
            at = opened.pop() if opened else -1
            if at >= 0:
                out[at].partner = len(out)
            out.append(Token("end", raw, partner=at))
        else:
            out.append(Token("aside" if kind == "aside" else "text", raw))
    for at in opened:
        out[at].partner = len(out)
    return out


def unescaped(raw: str) -> str:
    """Entities of XML and character references; unchanged where any is unknown."""

    def one(m: re.Match) -> str:
        ref = m[1]
        if ref in ENTITIES and m[0].endswith(";"):
            return ENTITIES[ref]
        if re.fullmatch(r"#(\d+|x[0-9A-Fa-f]+)", ref) and m[0].endswith(";"):
            n = int(ref[2:], 16) if ref[1] == "x" else int(ref[1:])
            if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000:
                return chr(n)
        raise KeyError(ref)

    try:
        return _REF.sub(one, raw) if "&" in raw else raw
    except KeyError:
        return raw


def inline_source(tokens: list[Token]) -> tuple[str, dict[str, str]]:
    """Text with ⟦n⟧ ... ⟦/n⟧ for elements and ⟦Cn⟧ for what has no content, by one count from 1, and what they stand for."""
    out: list[str] = []
    held: dict[str, str] = {}
    opened: list[int] = []
    n = 0

    def close(raw: str) -> None:
        k = opened.pop()
        held[f"/{k}"] = raw
        out.append(f"⟦/{k}⟧")

    for t in tokens:
        if t.kind == "text":
            out.append(unescaped(t.raw))
        elif t.kind == "end":
            close(t.raw)
        else:
            n += 1
            key = str(n) if t.kind == "start" else f"C{n}"
            held[key] = t.raw
            out.append(f"⟦{key}⟧")
            if t.kind == "start":
                opened.append(n)
    while opened:
        close("")
    return "".join(out), held


def parse(source: str, lenient: bool = False) -> Document:
    doc = Document(tokens_of(source, lenient))
    tokens = doc.tokens
    holds_block = [False] * len(tokens)
    opened: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind in ("start", "empty") and t.name in BLOCK:
            for k in reversed(opened):
                if holds_block[k]:
                    break  # so do those around it
                holds_block[k] = True
        if t.kind == "start":
            opened.append(i)
        elif t.kind == "end" and t.partner >= 0:
            opened.pop()
    for i, t in enumerate(tokens):
        if t.kind == "start" and t.name in BLOCK and not holds_block[i]:
            source, held = inline_source(tokens[i + 1 : t.partner])
            if source.strip():
                doc.segments.append(Segment(len(doc.segments), source, held, i, t.partner))
    return doc


def attribute_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def translation_block(name: str, inner: str, lang: str) -> str:
    return f'<{name} class="folio-translation" lang="{attribute_text(lang)}" dir="auto">{inner}</{name}>'


def note_block(inner: str, lang: str | None) -> str:
    tag = f' lang="{attribute_text(lang)}"' if lang and lang.strip() else ""
    return f'<div class="folio-note"{tag} dir="auto">{NOTE_PREFIX} {inner}</div>'


def rendered(doc: Document, targets: dict[int, str], notes: dict[int, tuple[str, str]], bilingual: bool, lang: str, note_lang: str | None = None) -> str:
    """The document with targets (markup, by block) in place of the blocks' content or after them, and notes (pos, markup) beside them."""
    raw = [t.raw for t in doc.tokens]
    out, at = [], 0
    for s in doc.segments:
        target, (pos, note) = targets.get(s.block_index), notes.get(s.block_index, ("after", ""))
        note = note_block(note, note_lang) if note.strip() else ""
        start, end = raw[s.first], raw[s.last] if s.last < len(raw) else ""
        block = start + (target if target is not None and not bilingual else "".join(raw[s.first + 1 : s.last])) + end
        beside = [block]
        if target is not None and bilingual:
            beside.append(translation_block(_NAME.match(start)[1].rpartition(":")[2], target, lang))
        if note:
            beside.insert(0 if pos == "before" else len(beside), note)
        out += ["".join(raw[at : s.first]), "\n".join(beside)]
        at = s.last + 1
    return "".join([*out, "".join(raw[at:])])


BILINGUAL_STYLE = """<style>
.folio-translation { font-family: sans-serif; text-indent: 0; opacity: 0.8 }
</style>"""
NOTE_STYLE = """<style>
.folio-note { background: #f6f3ea; border-radius: 6px; font-style: italic; margin: 1em 2em; padding: 0.6em 1em; page-break-inside: avoid }
</style>"""


def with_style(xhtml: str, style: str) -> str:
    at = xhtml.lower().find("</head>")
    return xhtml if at < 0 else xhtml[:at] + style + xhtml[at:]
