"""Text scalars as Column expressions: tokens, placeholders, escaping, note guards, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "⟦", "⟧"
MOCK_MARK = "〈譯〉"
NOTE_PREFIX = "〔註〕"

# Scripts written without spaces, whose characters count as a token each.
DENSE = "[\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\uAC00-\\uD7AF\\uFF66-\\uFF9F]"

# Phrases that write the reader into a note, and openers that say nothing.
READER_PHRASES = [
    "就像你", "跟你一樣", "和你一樣", "像你這樣", "身為讀者", "讀者你", "的你", "你也", "你會", "你可能", "你應該", "你我", "親愛的讀者",
    "dear reader", "as you ", "like you,", "you might", "you may", "you probably", "readers like you",
]
GENERIC_OPENERS = ["這段", "這一段", "此段", "此處", "本段", "作者在此", "作者在這", "this passage", "this paragraph", "here the author", "in this passage"]

# Ids of the preset help angles, in their canonical order.
PRESETS = ["terms", "history", "author", "culture", "characters", "concepts", "world", "methods", "research"]

# Phrases of rights pages.
RIGHTS_MARKERS = [
    "all rights reserved", "library of congress", "cataloging-in-publication", "isbn", "no part of this book", "penguin random house",
    "無断複製", "無断転載", "発行所", "発行者", "著作権法", "版權所有", "翻印必究", "著作權",
]
RIGHTS_MOST_SEGMENTS, RIGHTS_LEAST_MARKERS = 40, 2

# Language labels and their BCP-47 tags.
LANG_TAGS = {
    "繁體中文": "zh-Hant", "繁体中文": "zh-Hant", "简体中文": "zh-Hans", "簡體中文": "zh-Hans", "中文": "zh", "English": "en", "英文": "en",
    "日本語": "ja", "日文": "ja", "한국어": "ko", "韓文": "ko", "韩文": "ko",
}

# Prefixes of vendor keys, longest of a family first.
KEY_PREFIXES = ["sk-ant-", "sk-proj-", "sk-", "ghp_", "github_pat_", "xoxb-", "AIza"]

# What stands between head and middle of a plan sample, and what errors of a busy provider say.
SAMPLE_JOIN = "\n…（章中段抽樣）…\n"
BUSY = ["429 Too Many Requests", "_kit_busy"]

STYLE_CHARS, ANCHOR_CHARS, ANCHOR_COUNT = 4000, 80, 16


def utrim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def est_tokens(c: Column) -> Column:
    """Dense-script characters count one each, the others two and a half to a token, rounded up."""
    dense = F.regexp_count(c, F.lit(DENSE)).cast("long")
    return dense + F.ceil((F.length(c) - dense) / F.lit(2.5)).cast("long")


def guess_tokens(c: Column) -> Column:
    """The estimate that batching uses: two and a half characters of any script to a token, rounded up."""
    return F.ceil(F.length(c) / F.lit(2.5)).cast("long")


def placeholder_tokens(c: Column) -> Column:
    """Bodies of the closed placeholders, in order."""
    return F.regexp_extract_all(c, F.lit("⟦([^⟧]*)⟧"), F.lit(1))


def same_placeholders(a: Column, b: Column) -> Column:
    """Whether both hold the same placeholders as often, in any order."""
    return F.sort_array(placeholder_tokens(a)) == F.sort_array(placeholder_tokens(b))


def strip_tokens(c: Column) -> Column:
    """Without placeholders. An unclosed one takes the rest with it; a stray close goes alone."""
    return F.regexp_replace(c, "⟦[^⟧]*(⟧|$)|⟧", "")


def restore(c: Column, tokens: Column) -> Column:
    """Known placeholders become their markup (a map by body), unknown ones stay, an unclosed tail goes."""
    parts = F.regexp_extract_all(c, F.lit("⟦[^⟧]*(?:⟧|$)|[^⟦]+"), F.lit(0))

    def one(t: Column) -> Column:
        body = F.substring(t, F.lit(2), F.length(t) - 2)
        closed = t.startswith(OPEN) & t.endswith(CLOSE)
        return F.when(closed, F.coalesce(F.try_element_at(tokens, body), t)).when(t.startswith(OPEN), F.lit("")).otherwise(t)

    return F.array_join(F.transform(parts, one), "")


def has_visible_text(c: Column) -> Column:
    """Whether any character outside placeholders isn't white space."""
    return ~is_blank(strip_tokens(c))


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def name_separators(c: Column, lang: Column) -> Column:
    """In Traditional Chinese the separator of transliterated names, where other dots stand between name parts.

    Both neighbours, looking past tags, are Han characters or ASCII letters, one of them Han at least.
    """
    han, part = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF", "A-Za-z"
    tag = "<(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
    dot = "[\\u30FB\\u00B7\\uFF0E](?![^<>]*>)"  # not inside a tag
    # what stands before is taken and put back, as tags have no largest length that a look-behind could go by
    fixed = F.regexp_replace(c, f"([{han}](?:{tag})*){dot}(?=(?:{tag})*[{han}{part}])", "$1‧")
    fixed = F.regexp_replace(fixed, f"([{part}](?:{tag})*){dot}(?=(?:{tag})*[{han}])", "$1‧")
    return F.when(lang.startswith("zh-Hant"), fixed).otherwise(c)


def sanitised_target(c: Column) -> Column:
    """A glossary target without characters of placeholders or markup."""
    return F.translate(c, "⟦⟧<>", "")


def snippet(c: Column, chars: int) -> Column:
    return F.substring(c, 1, chars)


def plan_sample(text: Column, head: int = 900, tail: int = 400) -> Column:
    """The head of a chapter's text and, where it is longer, a slice from its middle on that the head doesn't hold."""
    at = F.greatest(F.floor(F.length(text) / 2), F.lit(head)).cast("int")
    middle = F.substring(text, at + 1, F.lit(tail))
    longer = (F.length(text) > head) & ~is_blank(middle)
    return F.when(longer, F.concat(F.substring(text, 1, head), F.lit(SAMPLE_JOIN), middle)).otherwise(F.substring(text, 1, head))


def addresses_reader(note: Column) -> Column:
    low = F.lower(note)
    return F.exists(F.array(*map(F.lit, READER_PHRASES)), lambda p: F.contains(low, p))


def opens_generic(note: Column) -> Column:
    low = F.lower(F.regexp_replace(note, r"(?U)^\s+", ""))
    return F.exists(F.array(*map(F.lit, GENERIC_OPENERS)), lambda p: F.startswith(low, p))


def note_ok(note: Column) -> Column:
    """Whether a note's text may stand: not blank, no placeholder, no word to the reader, no empty opener."""
    return ~is_blank(note) & ~note.rlike("[⟦⟧]") & ~addresses_reader(note) & ~opens_generic(note)


def canonical_anchors(anchors: Column) -> Column:
    """Trimmed, cut, not empty, the first of each, so many at most."""
    cut = F.transform(anchors, lambda a: F.substring(utrim(a), 1, ANCHOR_CHARS))
    return F.slice(F.array_distinct(F.filter(cut, lambda a: a != "")), 1, ANCHOR_COUNT)


def canonical_presets(ids: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, PRESETS)), ids)


def unknown_presets(ids: Column) -> Column:
    return F.array_except(ids, F.array(*map(F.lit, PRESETS)))


def sanitised_style(c: Column) -> Column:
    return F.substring(utrim(c), 1, STYLE_CHARS)


def redact_keys(c: Column) -> Column:
    """Without vendor keys of 8 characters or more after their prefix, and without bearer tokens."""
    keyed = F.regexp_replace(c, f"({'|'.join(KEY_PREFIXES)})[A-Za-z0-9_-]{{8,}}", "$1<redacted>")
    return F.regexp_replace(keyed, "(?i)(bearer )[A-Za-z0-9\\-._~+/=]+", "$1<redacted>")


def pseudo_translation(c: Column) -> Column:
    """What the offline provider returns for a sentence."""
    return F.concat(F.lit(MOCK_MARK), c)


def without_paired_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, "⟦(/+[0-9]*|[0-9]+)⟧", "")


def language_tag(label: Column) -> Column:
    tags = F.create_map(*(F.lit(x) for kv in LANG_TAGS.items() for x in kv))
    return F.coalesce(F.try_element_at(tags, utrim(label)), utrim(label))


def with_css(xhtml: Column, css: str) -> Column:
    """The style before the first </head>, in either case; unchanged without one."""
    at = F.locate("</head>", F.lower(xhtml))
    return F.when(at > 0, F.concat(F.substring(xhtml, F.lit(1), at - 1), F.lit(css), F.substring(xhtml, at, F.length(xhtml)))).otherwise(xhtml)


def file_slug(label: Column) -> Column:
    """One file-name part: letters, digits, - and _, white space as one hyphen, everything else left out."""
    spaced = F.regexp_replace(F.regexp_replace(label, r"(?U)[^\p{Alpha}\p{N}_\s-]", ""), r"(?U)\s+", " ")
    joined = F.regexp_replace(F.regexp_replace(F.trim(spaced), "- ", "-"), " ", "-")
    slug = F.regexp_replace(joined, "^[-_]+|[-_]+$", "")
    return F.when(slug == "", "translated").otherwise(slug)


def book_format(path: Column) -> Column:
    """epub or txt by the extension, in either case; null for any other."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("epub", "txt"), ext)


def is_xhtml(name: Column) -> Column:
    return name.rlike(r"(?i)\.(xhtml|html|htm)$")


def safe_entry_name(name: Column) -> Column:
    """Whether an archive entry's name stays inside the folder it is unpacked to."""
    return (name != "") & ~name.rlike(r"^[/\\]") & ~name.rlike(r"^[A-Za-z]:") & ~name.rlike(r"(^|[/\\])\.{1,2}([/\\]|$)")


def rights_markers(text: Column) -> Column:
    """How many distinct rights markers a text holds."""
    low = F.lower(text)
    return F.aggregate(F.array(*map(F.lit, RIGHTS_MARKERS)), F.lit(0), lambda n, m: n + F.contains(low, m).cast("int"))


def looks_like_apparatus(text: Column, segments: Column) -> Column:
    return (segments <= RIGHTS_MOST_SEGMENTS) & (rights_markers(text) >= RIGHTS_LEAST_MARKERS)


def is_busy(error: Column) -> Column:
    """Whether a provider error says that it is busy, so that waiting helps."""
    return F.exists(F.array(*map(F.lit, BUSY)), lambda m: F.contains(error, m))
