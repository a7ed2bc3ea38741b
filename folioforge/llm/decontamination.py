"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

Text is normalised to lower-case words between single spaces, as UTF-8 bytes read one character a byte. The automaton holds
every window with a space at either end, so a match begins and ends at word borders. Text is scanned once; places in the
normalised text are mapped to words by the ranks of their spaces, and to offsets in the original only where there is a hit.

Defined cases: a null or wordless text has no words, n_hit 0, and isn't contaminated. Items without words, or null, make no window. Windows of
an item without item_id hit, but the item isn't listed. Rows that repeat an item_id are one item. Repeated document rows are each
returned, with their doc_id whatever it is. Texts are read whole, whatever their length. Ties: items are a set. An empty table of documents gives no rows, an
empty benchmark no hits. Other columns of either table aren't read, or are passed on where `keep` names them; names that the result needs raise ValueError there.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from folioforge.llm.common import discard, kept, materialise, own_names, slices, texts_as_bytes

#: Upper bound of benchmark text for one automaton, in bytes; more text is scanned for in several passes.
BLOCK_BYTES = 4_000_000
WINDOW = 13

#: Bytes that are part of words stay, A-Z in lower case; every other byte is a space.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised_words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[str | None, bytes | None]], size: int = WINDOW):
    """None without a window. The value of a pattern: (its length, the item ids that hold it)."""
    import ahocorasick

    held: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for w in windows(normalised_words(text), size):
            held[w] |= {item} - {None}
    if not held:
        return None
    found = ahocorasick.Automaton()
    for w, ids in held.items():
        key = f" {w.decode('latin-1')} "
        found.add_word(key, (len(key), tuple(ids)))
    found.make_automaton()
    return found


def scan(text: bytes, found) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, runs of hit words (first, last), ids of items that occur."""
    words = normalised_words(text)
    if not words or found is None:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    runs, items, at = [], set(), None
    for end, (length, ids) in found.iter(line):
        if at is None:
            at = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 0x20)
        first, last = np.searchsorted(at, [end - length + 1, end])
        runs.append((int(first), int(last) - 1))
        items.update(ids)
    return len(words), merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in runs]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[str | None, bytes]]]]:
    """How many blocks of about block_bytes the items make, and those blocks; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def blocks():
        for k in range(n):
            block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield [(r[0], bytes(r[1])) for r in block.collect()]

    return n, blocks()


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_STATE = [StructField("runs__", ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))), StructField("items__", ArrayType(StringType()))]
_RESULT = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    StructField("contaminated", BooleanType()),
]


def contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the kept columns, n_words, n_hit, items (sorted ids), spans (in the original text), contaminated.

    Contaminated: at least one word in twenty lies in a window. No shuffle: the automaton goes to the text. A benchmark larger
    than block_bytes is taken block by block, each pass adding its hits to the rows of the one before.
    """
    keep = ["doc_id"] if keep is None else keep
    own_names(keep, [f.name for f in _RESULT + _STATE])
    df = documents.select(*dict.fromkeys([*keep, "text"]))
    own = list(df.schema.fields)
    n, blocks = benchmark_blocks(benchmark, block_bytes)
    before = None
    for k, block in enumerate(blocks):
        shared = df.sparkSession.sparkContext.broadcast(block)
        last = k == n - 1
        made = [documents.schema[c] for c in keep] + _RESULT if last else own + _STATE
        df = df.mapInArrow(_pass(shared, window, keep, [f.name for f in own], last), StructType(made))
        if not last:
            df = materialise(df, "contamination")
            if before is not None:
                discard(before)
            before = df
    return df


def _built(shared, window: int):
    """One automaton per Python worker, not per task."""
    return kept(("automaton", shared._path if hasattr(shared, "_path") else id(shared), window), lambda: automaton(shared.value, window))


def _pass(shared, window: int, keep: list[str], own: list[str], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _built(shared, window)
        for b in slices(batches):
            text = b.column("text")
            known = "runs__" in b.schema.names
            old = b.column("runs__").to_pylist() if known else [()] * b.num_rows
            had = b.column("items__").to_pylist() if known else [()] * b.num_rows
            words, hits, items = [], [], []
            for x, before, ids in zip(texts_as_bytes(text), old, had, strict=True):
                n, runs, got = scan(x or b"", found)
                words.append(n)
                hits.append(merged(runs + [(r["first"], r["last"]) for r in before]))
                items.append(sorted(got.union(ids)))
            if not last:
                runs = pa.array([[{"first": x, "last": y} for x, y in h] for h in hits], _RUNS)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), runs, pa.array(items, pa.list_(pa.string()))], [*own, "runs__", "items__"])
                continue
            n_hit = [sum(y - x + 1 for x, y in h) for h in hits]
            spans = [[{"start": x, "end": y} for x, y in original_spans(text[i].as_py(), h)] if h else [] for i, h in enumerate(hits)]
            bad = [h > 0 and 20 * h >= w for h, w in zip(n_hit, words, strict=True)]
            made = [pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, *(f.name for f in _RESULT)])

    return run


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
