"""Secret scans: patterns give candidates, dictionary-primed zstandard says how new each candidate is where it stands.

Novelty of a candidate is the number of bytes that it adds to a frame compressed with a raw dictionary of common identifiers
followed by the surrounding text, without the candidate's own copies there. Prose and identifiers add few bytes; a key adds nearly
one byte a character, or the entropy of its alphabet where it is long enough for its characters to be coded. The base patterns (assign, access, hex) are reported whatever their novelty. Other token-like strings
with a word such as `key` or `bearer` around them, on either side, are reported, as kind `novel`, when they are incompressible but for their alphabet, and
spelt as no identifier is: zstandard finds no four letters of a new identifier in its dictionary either, so a model of the pairs of characters in the same
dictionary has to be surprised, too, by SURPRISE bits a character or more. Hexadecimal strings need no such surprise; UUIDs aren't secrets. Token-like
strings that follow one another with nothing but line ends, quotes and the like between (the lines of a PEM block) carry the context on.

Defined cases: null and empty texts have no findings. Texts are read whole, whatever their length. Repeated rows are each returned, with their doc_id whatever it is.
Ties: findings that start together stand in the order of kinds. An empty table gives an empty result. Columns of `keep` named like one that is made
(`findings`, or `text` where it is redacted) raise ValueError; others are passed on or not read.
Offsets are code points of the original text, ends exclusive, of the whole match.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from folioforge.llm.common import own_names, slices, texts_as_bytes

KINDS = ("assign", "access", "hex", "novel")
#: Characters of surrounding text on each side that prime the dictionary.
CONTEXT = 256
#: Characters on each side of a candidate in which a sensitive word must stand.
REACH = 256
#: Marginal bytes a character from which a string is new, if zstandard doesn't code its literals; it does from CODED characters on.
NOVEL, CODED = 0.75, 64
#: The part of its alphabet's entropy from which a longer string is new.
RANDOM = 0.95
#: Bits a character from which a string is spelt as no identifier is.
SURPRISE = 5.25

# Words that make a context sensitive, and the common identifiers that prime the dictionary.
SENSITIVE = ("auth", "bearer", "credential", "key", "passphrase", "passwd", "password", "private", "pwd", "secret", "signature", "token")
IDENTIFIERS = (
    "access_key account_id api_key apikey app_id application/json args array async auth_token authorization await base64 bearer bool "
    "callback catch certificate char class client_id client_secret config connection const content-type context cookie credentials data "
    "database default def delete description device_id else encoding endpoint environment error example.com except export false file "
    "filename float for format from function get github.com group_id hash header host http https://www. id identifier import index "
    "instance int integer interface json key kwargs label length list localhost login master message method module name namespace new "
    "node null number object offset option order_id output package parameter parent password path permission placeholder port private "
    "project property protected public query raise range read request response result return role schema secret secret_key select self "
    "server service session session_id set signature size source ssh-rsa state static status string struct switch table target test "
    "throw timeout timestamp title token true try type undefined update url user user_id username uuid value var vector version void "
    "while window write yield 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the length can stand in the pattern
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_GAP = r"""(?:\\[nr]|[\s"'\\+#*,;>|])"""  # between lines of one secret, in source code, too
_BETWEEN = re.compile(_GAP + "*")
_TAIL = re.compile(_GAP + "{1,64}([A-Za-z0-9+/]{1,15}={0,2})" + _GAP + "{0,64}-----END")
_NAMED = re.compile(r"=+(?=[^=])")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)

_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SENSITIVE_HINTS = tuple(w.encode() for w in SENSITIVE)
_HEX_CLASS = bytes(0x78 if b in b"0123456789abcdef" else 0x20 for b in range(256))
_HEX_RUN = b"x" * 16


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the three base kinds. raw: the text in UTF-8; low: raw in lower case."""
    out = []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _HEX_RUN in raw.translate(_HEX_CLASS):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def other_candidates(text: str, low: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Token-like strings of which base spans leave 16 characters or more, with a sensitive word in or around them or after one that has it. A name and its value are two."""
    if not any(h in low for h in _SENSITIVE_HINTS):
        return []
    starts, ends = [], []  # base spans, joined where they overlap
    for a, _, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    begins = [a for a, _ in words]
    out, last = [], -1  # the end of the last string in a sensitive context
    for m in _WORD.finditer(text):
        start, end = m.span()
        carried = last >= 0 and _BETWEEN.fullmatch(text, last, start) is not None
        k = bisect_left(begins, end + REACH) - 1  # the last word that begins within reach; words don't overlap
        if not carried and (k < 0 or words[k][1] <= start - REACH):
            last = -1
            continue
        last = end
        named = _NAMED.search(text, start, end)
        for a, b in [(start, named.start()), (named.end(), end)] if named else [(start, end)]:
            t = text[a:b]
            over = range(bisect_left(ends, a + 1), bisect_left(starts, b))  # base spans that touch this
            free = len(t) - sum(min(b, ends[i]) - max(a, starts[i]) for i in over)
            if free >= 16 and (carried or any(c.isdigit() for c in t) and any(c.isalpha() for c in t)):
                out.append((a, b))
        tail = _TAIL.match(text, end)  # the last line of a block may be short
        if tail and tail.end(1) - tail.start(1) < 16:
            out.append(tail.span(1))
    return out


_ALPHABETS = [(re.compile(p), n) for p, n in (("[0-9A-F]+", 16), ("[0-9a-f]+", 16), ("[0-9A-Fa-f]+", 22), ("[A-Z2-7]+", 32), ("[a-z2-7]+", 32), ("[A-Z0-9]+", 36), ("[a-z0-9]+", 36), ("[A-Za-z0-9]+", 62))]


def least_new(t: str) -> float:
    """Marginal bytes from which a candidate is new: never above what a random string of its alphabet has."""
    if len(t) < CODED:
        return NOVEL * len(t)
    body = t.rstrip("=")
    plain = re.sub("[+/_=-]", "", body)
    letters = next((n for p, n in _ALPHABETS if p.fullmatch(plain)), 64) + len(set(body) - set(plain))
    return min(NOVEL, RANDOM * math.log2(letters) / 8) * len(body)


_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
_NEW_WORD = re.compile("(?<=[a-z0-9])(?=[A-Z])")


def spelling(t: str) -> str:
    """Lower-case letters, 0 for digits, _ for the rest, ^ where a word begins with a capital."""
    t = re.sub("[0-9]", "0", _NEW_WORD.sub("^", t).lower())
    return re.sub("[^a-z0^]", "_", t)


class Pairs:
    """How surprising a string's pairs of characters are after those of the dictionary."""

    SIGNS, LEAST = 29, 0.3

    def __init__(self, text: str):
        s = "_" + spelling(text)
        self.pairs, self.firsts = Counter(zip(s, s[1:], strict=False)), Counter(s[:-1])

    def bits(self, t: str) -> float:
        """A character, on average; the sign of a new word is no character. Which digit a digit is isn't in the pairs, so it is a choice of ten besides."""
        s = "_" + spelling(t)
        digits = math.log2(10) * s.count("0")
        return (digits + sum(math.log2((self.firsts[a] + self.LEAST * self.SIGNS) / (self.pairs[a, b] + self.LEAST)) for a, b in zip(s, s[1:], strict=False))) / len(t)


class Novelty:
    """Marginal compressed bytes of a candidate, given identifiers and the text around it."""

    def __init__(self, level: int = 3):
        import zstandard

        self.zstd, self.level, self.prime, self.pairs = zstandard, level, IDENTIFIERS.encode(), Pairs(IDENTIFIERS)
        self.params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, text: str, start: int, end: int) -> float:
        t = text[start:end]
        wide = CONTEXT + len(t)  # a copy that begins or ends in the context stands in this whole
        clear = lambda x: x.replace(t, " " * len(t))
        around = clear(text[max(0, start - wide) : start])[-CONTEXT:] + " " + clear(text[end : end + wide])[:CONTEXT]
        primed = self.zstd.ZstdCompressionDict(self.prime + around.encode("utf-8", "surrogatepass"), dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        squeeze = self.zstd.ZstdCompressor(dict_data=primed, compression_params=self.params)
        body = text[start:end].encode("utf-8", "surrogatepass")
        return float(len(squeeze.compress(body)) - len(squeeze.compress(b"")))


    def new(self, t: str, marginal: float) -> bool:
        """Whether a candidate of so many marginal bytes is reported."""
        return marginal >= least_new(t) and not _UUID.fullmatch(t) and (_HEXADECIMAL.fullmatch(t) is not None or self.pairs.bits(t) >= SURPRISE)


def scan(text: str | None, raw: bytes | None, novelty: Novelty) -> list[tuple[int, int, int, float]]:
    """(start, number of the kind, end, marginal bytes) by start, then kind."""
    if not text:
        return []
    low = raw.lower()
    base = base_spans(text, raw, low)
    out = [(s, k, e, novelty.of(text, s, e)) for s, k, e in base]
    for s, e in other_candidates(text, low, base):
        n = novelty.of(text, s, e)
        if novelty.new(text[s:e], n):
            out.append((s, 3, e, n))
    return sorted(out)


FINDING = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("novelty", DoubleType())])
_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def findings(documents: DataFrame, keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """The kept columns and `findings`, by start, then kind. No shuffle.

    redact: where given, `text` is also returned, with every finding replaced by it (overlapping findings as one).
    """
    keep = ["doc_id"] if keep is None else keep
    own_names(keep, ["findings"])
    df = documents.select(*dict.fromkeys([*keep, "text"]))
    out = [c for c in keep if c != "text" or redact is None] + (["text"] if redact is not None else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in slices(batches):
            found, texts = [], b.column("text")
            changed = texts.to_pylist() if redact is not None else []
            for i, raw in enumerate(texts_as_bytes(texts)):
                text = raw.decode("utf-8") if raw else ""
                hits = scan(text, raw, novelty)
                found.append([{"kind": KINDS[k], "start": s, "end": e, "novelty": n} for s, k, e, n in hits])
                if hits and redact is not None:
                    changed[i] = redacted(text, [(s, e) for s, _, e, _ in hits], redact)
            columns = {c: b.column(c) for c in keep}
            if redact is not None:
                columns["text"] = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in out), pa.array(found, _FINDINGS)], [*out, "findings"])

    return df.mapInArrow(run, StructType([documents.schema[c] for c in out] + [StructField("findings", ArrayType(FINDING))]))


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()
