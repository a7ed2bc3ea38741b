"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of a text and its blocks between blank lines, of `least` words or more, however long, and the whole text, of a shingle's words or
more. For passages that begin or end inside a paragraph there is an exact search besides, for runs of PASSAGE words or more.

Paragraphs:
1. Paragraphs with equal words are one class. Classes' five-word shingle sets are banded by min-max hashing: BANDS bands of ROWS values. A pair at
   Jaccard 0.8 shares a band with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9998, wherever its changed words stand.
2. Classes that share a band are joined, and Jaccard similarity of 0.8 or more is confirmed on full shingle sets (common.linked). Components of the links
   are clusters. A cluster counts where it has members in two documents.

Passages:
3. Texts are cut by content: an anchor is a place whose 3-gram hash is the least of SPAN 3-grams in a row, and a piece is the PIECE words from there, so
   any PASSAGE words in a row hold a whole piece. Pieces that stand in one document alone are dropped by a count before anything else is looked at. Of
   documents with the same words the first one alone is cut: the others go whole, as the paragraph that each of them is.
4. Of the other documents, all windows of PASSAGE words that hold a piece which is shared are hashed and counted. Windows of two documents are shared passages, every one of them and nothing else.

Decision: a paragraph, or a window, is kept in the document with the smallest doc_id of its cluster, or of its own, and is to be removed from the
others, wherever it stands there. Units of a document that overlap and have the same decision are one passage. Passages to be kept and to be removed
may overlap: what is to be removed goes, and a passage to be kept of which fewer than LEFT words are left isn't returned. What goes stands in a document
with a smaller doc_id, where it is kept or is itself a copy of one in a still smaller doc_id, so some copy stays. cluster_id is that of the cluster; of a passage
the least hash of its windows; of units that make one passage the least.

Defined cases: null and empty texts have no paragraphs, texts of fewer words than a shingle neither. A near paragraph is one passage whole, with the words that
differ. Rows that repeat a doc_id are one document; repeats inside one document don't make a cluster count, but every one is returned where it does. Rows
with a null doc_id take no part. Texts are read whole, whatever their length. Ties: the least hash names a cluster, the least doc_id keeps it. An empty
table gives no rows. Other columns aren't read, so their names may clash. doc_id must be integral.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import MOST_SENT, U64, WordIds, discard, group_join, linked, materialise, mix64, shared_buckets, shingle_hashes, slices, texts_as_bytes
from folioforge.llm.minhash import MinMax

#: Words of a passage; of a piece, which any passage holds; 3-grams among which an anchor is the least.
GRAM, PIECE, PASSAGE = 3, 16, 51
SPAN = PASSAGE - PIECE + 1
SHINGLE, PERCENT = 5, 80
ROWS, BANDS = 3, 12
#: Words from which lines and blocks are paragraphs, unless a caller says otherwise. Shorter lines (headings, licence notices, set phrases) recur in texts that share nothing else.
LEAST = 20
LEFT = 12

_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: An odd base for hashes of windows, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes of text that are worked on at a time (a longer text alone), and the bits of a key that hold a place: more words than a text can have.
AT_ONCE, PLACE_BITS = 4 << 20, 30


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the start and end of each word."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, dtype=np.uint8)], [True]])
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def anchors(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of 3-grams that are the least of SPAN in a row, the first of equals, with PIECE words from there on.

    words and doc: the hashes of all words of some documents in a row, and the document of each. Runs and pieces stay
    inside a document. Minima of SPAN in a row come from minima of 2, 4, 8 and so on.
    """
    n = len(words) - GRAM + 1
    windows = n - SPAN + 1
    if windows <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = U64(PLACE_BITS)
    key = shingle_hashes(words, GRAM) >> bits << bits | np.arange(n, dtype=U64)
    low, done, size = None, 0, 1
    while size <= SPAN:
        if SPAN & size:
            part = key[done : done + windows]
            low = part if low is None else np.minimum(low, part)
            done += size
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    whole = doc[:windows] == doc[SPAN + GRAM - 2 :][:windows]
    at = np.unique((low[whole] & U64((1 << PLACE_BITS) - 1)).astype(np.int64))
    at = at[at + PIECE <= len(words)]
    return at[doc[at] == doc[at + PIECE - 1]]


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, by sums of a polynomial: a run's doesn't depend on its place."""
    n = len(words)
    if n < size:
        return np.zeros(0, dtype=U64)
    up, down = (np.cumprod(np.concatenate([np.ones(1, dtype=U64), np.full(n - 1, b, dtype=U64)]), dtype=U64) for b in (_BASE, _INVERSE))
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix64(words) * up, dtype=U64)])
    return mix64((total[size:] - total[:-size]) * down[: n - size + 1])


def class_hash(words: np.ndarray) -> int:
    """Of a paragraph, given as its word hashes; signed."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(words.tobytes(), seed=len(words))
    return h - (h >> 63 << 64)


def borders(raw: bytes, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the lines, of the blocks between blank lines, and of the texts, of all texts in a row."""
    new = np.zeros(len(starts), dtype=bool)
    new[:1] = True
    new[1:] = doc[1:] != doc[:-1]
    at = np.frombuffer(raw, dtype=np.uint8)
    # "\r\n" and a lone "\r" each end one line
    end = (at == 10) | (at == 13) & np.r_[at[1:] != 10, True]
    breaks = np.concatenate([[0], np.cumsum(end)])[starts]  # before each word
    gap = np.diff(breaks, prepend=breaks[:1])
    return np.flatnonzero(new | (gap >= 1)), np.flatnonzero(new | (gap >= 2)), np.flatnonzero(new)


def paragraphs(t: Texts, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of the paragraphs; lines, blocks and whole texts that are the same are one."""
    if not len(t.starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = [np.stack([b, np.diff(np.r_[b, len(t.starts)])], axis=1) for b in borders(t.raw, t.starts, t.doc)]
    found = [f[f[:, 1] >= max(n, SHINGLE)] for f, n in zip(found, (least, least, SHINGLE), strict=True)]
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def band_keys(words: np.ndarray, first: np.ndarray, n: np.ndarray, hashes: MinMax) -> np.ndarray:
    """Paragraphs x BANDS: keys as those of MinMax.bands."""
    if not len(first):
        return np.zeros((0, BANDS), dtype=np.int64)
    h = (shingle_hashes(words, SHINGLE) >> U64(32)).astype(np.uint32)
    cuts = np.stack([first, first + n - SHINGLE + 1], axis=1)
    order = np.argsort(first, kind="stable")
    found = []
    for x in hashes.permuted(h):
        x = np.append(x, x[-1:])  # so that a paragraph may end with the last shingle
        found.append([f.reduceat(x, cuts[order].reshape(-1))[::2] for f in (np.minimum, np.maximum)])
    v = np.concatenate([np.stack([low for low, _ in found], axis=1), np.stack([high for _, high in found], axis=1)], axis=1).astype(U64)
    v = v.reshape(len(first), BANDS, ROWS)
    keys = mix64((mix64(v + hashes.place[0]) * hashes.place[0]).sum(axis=2, dtype=U64) ^ hashes.band[None, :]).view(np.int64)
    out = np.empty_like(keys)
    out[order] = keys
    return out


class Texts:
    """Words of some texts in a row, and where they stand."""

    def __init__(self, texts: list[bytes], ids: WordIds):
        self.raw = b" ".join(texts)
        self.starts, self.ends = word_places(self.raw)
        self.begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.doc = np.searchsorted(self.begin, self.starts, side="right") - 1
        self.words = ids.of(self.raw.lower().split())
        self.chars = np.concatenate([[0], np.cumsum((np.frombuffer(self.raw, dtype=np.uint8) & 0xC0) != 0x80)])

    def places(self, at: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, ...]:
        """text (its number), first (word), start and end (code points) of n words from each place."""
        own = self.doc[at]
        first = at - np.searchsorted(self.doc, own)  # doc rises, so this is the text's first word
        zero = self.chars[self.begin[own]]
        return own, first, self.chars[self.starts[at]] - zero, self.chars[self.ends[at + n - 1]] - zero


def pieces(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash (signed) of each piece."""
    at = anchors(t.words, t.doc)
    return at, run_hashes(t.words, PIECE)[at].view(np.int64) if len(at) else at


def first_of(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind that its owner has."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    new = np.ones(len(order), dtype=bool)
    new[order[1:]] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return new


def lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """A list for each of n owners of the values, which are in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def at_once(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, ...]]:
    """Texts in groups of about AT_ONCE bytes, with other columns; rows without text left out."""
    for batch in slices(batches):
        held, size = [], 0
        for row in zip(texts_as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0]:
                held.append(row)
                size += len(row[0])
            if size >= AT_ONCE:
                yield tuple(map(list, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield tuple(map(list, zip(*held, strict=True)))


def document_units(documents: DataFrame, least: int) -> DataFrame:
    """doc_id, h (of all its words), pieces (hashes, each once), paragraphs (first word, n words, start, end, h: the class, bands: where the class stands first in the text)."""
    kinds = {"first": pa.int32(), "n": pa.int32(), "start": pa.int32(), "end": pa.int32(), "h": pa.int64(), "bands": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = WordIds(), MinMax(BANDS * ROWS // 2, ROWS)
        for texts, docs in at_once(batches, ["doc_id"]):
            t = Texts(texts, ids)
            at, h = pieces(t)
            own = first_of(t.doc[at], h)
            first = lists(h[own], t.doc[at][own], len(docs), pa.int64())
            at, n = paragraphs(t, least)
            h = np.array([class_hash(t.words[a : a + k]) for a, k in zip(at.tolist(), n.tolist(), strict=True)], dtype=np.int64)
            text, *place = t.places(at, n)
            new = first_of(text, h)
            bands = band_keys(t.words, at, n, hashes)[new]
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(new * BANDS)], pa.int32()), pa.array(bands.reshape(-1), pa.int64()))
            columns = [pa.array(c, k) for c, k in zip((place[0], n, *place[1:], h), list(kinds.values())[:-1], strict=True)]
            struct = pa.StructArray.from_arrays([*columns, bands], list(kinds))
            second = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(docs) + 1)), pa.int32()), struct)
            begin = np.searchsorted(t.doc, np.arange(len(docs) + 1))
            whole = pa.array([class_hash(t.words[a:z]) for a, z in zip(begin, begin[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), whole, first, second], ["doc_id", "h", "pieces", "paragraphs"])

    ok = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ok.mapInArrow(run, "doc_id long, h long, pieces array<long>, paragraphs array<struct<first:int,n:int,start:int,end:int,h:long,bands:array<long>>>")


def looked_up(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is needed of the texts of some documents, in one pass over them. wanted: doc_id, h, first, n; n is null for a piece.

    A row a class: id, shingles (packed 64-bit hashes of the paragraph of n words from first). A row a stretch of words each PASSAGE of which hold a wanted
    piece: doc_id, first, windows (the hash of the PASSAGE words from each), starts and ends of its words (code points, each less the one before).
    """
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "first", "n")).alias("wanted"))  # no more than a document has
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_doc = materialise(by_doc, "wanted")
    if by_doc.count() <= MOST_SENT:  # a long a row: other texts needn't be dealt
        texts = texts.join(F.broadcast(by_doc.select("doc_id")), "doc_id", "left_semi")
    kinds = {"id": pa.int64(), "shingles": pa.binary(), "doc_id": pa.int64(), "first": pa.int32()}
    kinds |= {"windows": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for found, docs, wanted in at_once(batches, ["doc_id", "wanted"]):
            t, out = Texts(found, ids), {k: [] for k in kinds}
            begin = np.searchsorted(t.doc, np.arange(len(docs) + 1))
            at, h = pieces(t) if any(w["n"] is None for own in wanted for w in own) else (np.zeros(0, dtype=np.int64),) * 2
            cuts = np.searchsorted(t.doc[at], np.arange(len(docs) + 1))
            windows = run_hashes(t.words, PASSAGE).view(np.int64) if len(at) else at

            def add(**row) -> None:
                for k in kinds:
                    out[k].append(row.get(k))

            for i, own in enumerate(wanted):
                lo, hi = int(begin[i]), int(begin[i + 1])
                for w in own:
                    m = t.words[lo + w["first"] : lo + w["first"] + w["n"]] if w["n"] is not None else None
                    if m is not None and len(m) == w["n"] and lo + w["first"] + w["n"] <= hi and class_hash(m) == w["h"]:  # another text of the same doc_id may differ
                        add(id=w["h"], shingles=np.unique(shingle_hashes(m, SHINGLE)).tobytes())
                shared = np.array([w["h"] for w in own if w["n"] is None], dtype=np.int64)
                mine = at[cuts[i] : cuts[i + 1]][np.isin(h[cuts[i] : cuts[i + 1]], shared)]
                last = hi - PASSAGE  # of the document's windows
                old = None
                for a, z in [(max(lo, int(p) + PIECE - PASSAGE), min(int(p), last)) for p in mine] + [(1 << 62, 1 << 62)]:
                    if old and a > old[1] + 1 or z == 1 << 62:
                        if old:
                            span = slice(old[0], old[1] + PASSAGE)
                            zero = t.chars[t.begin[i]]
                            add(doc_id=docs[i], first=old[0] - lo, windows=windows[old[0] : old[1] + 1], starts=np.diff(t.chars[t.starts[span]], prepend=zero), ends=np.diff(t.chars[t.ends[span]], prepend=zero))
                        old = None
                    if a <= z < 1 << 62:
                        old = (old[0], max(old[1], z)) if old else (a, z)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], list(kinds))

    return texts.join(by_doc, "doc_id").mapInArrow(run, "id long, shingles binary, doc_id long, first int, windows array<long>, starts array<int>, ends array<int>")


def by_document(rows: DataFrame, names: list[str], of_document: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What of_document makes of each document's rows, given as tuples of the columns names, by first word. schema: doc_id, then what it makes."""
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        doc, units, out, made = None, [], [], to_arrow_schema(target)

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(made)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], made.names)

        for batch in batches:
            for d, *x in zip(*(batch.column(k).to_pylist() for k in ("doc_id", *names)), strict=True):
                if d != doc:
                    out += [(doc, *r) for r in of_document(units)]
                    doc, units = d, []
                units.append(tuple(x))
            if len(out) > 10_000:
                yield batch_of()
                out.clear()
        out += [(doc, *r) for r in of_document(units)]
        yield batch_of()

    return rows.select("doc_id", *names).repartition("doc_id").sortWithinPartitions("doc_id", "first", "n").mapInArrow(run, target)


def merged(units: list[tuple]) -> list[list]:
    """first word, word behind, start, end, cluster of runs of units (first, n, start, end, cluster, ...) that overlap."""
    out: list[list] = []
    for u in units:
        a, n, s, e, c = u[:5]
        if out and a < out[-1][1]:
            x = out[-1]
            x[1], x[2], x[3], x[4] = max(x[1], a + n), min(x[2], s), max(x[3], e), min(x[4], c)
        else:
            out.append([a, a + n, s, e, c])
    return out


def decided(units: list[tuple]) -> Iterator[tuple]:
    """start, end, cluster, keep; of runs to be kept those of which LEFT words aren't removed, or that no removed one touches."""
    gone, at = merged([u for u in units if not u[5]]), 0
    yield from ((s, e, c, False) for _, _, s, e, c in gone)
    for a, b, s, e, c in merged([u for u in units if u[5]]):
        while at < len(gone) and gone[at][1] <= a:
            at += 1
        left, k = b - a, at
        while k < len(gone) and gone[k][0] < b:
            left -= min(b, gone[k][1]) - max(a, gone[k][0])
            k += 1
        if left >= LEFT or left == b - a:
            yield s, e, c, True


UNIT = "doc_id long, first int, n int, start int, end int, cluster_id long, keep boolean"


def passages(made: DataFrame) -> DataFrame:
    """Units of the windows that stand in two documents, a unit a run of windows with the same decision. made: of looked_up."""
    stretches = made.where("doc_id IS NOT NULL").select("doc_id", "first", "windows", "starts", "ends")
    each = stretches.select("doc_id", "first", F.posexplode("windows").alias("k", "w"))
    shared = each.groupBy("w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner <> last").select("w", "owner")
    # written, as the skew join splits a very common window only where both sides come from shuffles of the join's own
    hits = each.join(materialise(shared, "windows").hint("merge"), "w").groupBy("doc_id", "first").agg(F.collect_list(F.struct("k", (F.col("owner") == F.col("doc_id")).alias("keep"))).alias("hits"))  # no more than the stretch has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.bool_()]
        names = ["doc_id", "first", "n", "start", "end", "cluster_id", "keep"]
        for b in slices(batches, 256):
            rows = []
            for i in range(b.num_rows):
                doc, first, hits = (b.column(c)[i].as_py() for c in ("doc_id", "first", "hits"))
                windows, starts, ends = (b.column(c)[i].values.to_numpy() for c in ("windows", "starts", "ends"))
                starts, ends = np.cumsum(starts), np.cumsum(ends)
                for keep in (False, True):
                    at = np.unique(np.array([x["k"] for x in hits if x["keep"] == keep and x["k"] < len(windows)], dtype=np.int64))
                    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                        a, z = int(part[0]), int(part[-1])
                        rows.append((doc, first + a, z - a + PASSAGE, int(starts[a]), int(ends[z + PASSAGE - 1]), int(windows[a : z + 1].min()), keep))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return stretches.join(hits, ["doc_id", "first"]).mapInArrow(run, UNIT)


def repeated_passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, end (code points), cluster_id, keep: passages that other documents share. least: words of lines and blocks."""
    units = materialise(document_units(documents, least), "units")
    of_paragraphs = units.select("doc_id", F.inline("paragraphs"))
    classes = of_paragraphs.where("size(bands) > 0").groupBy("h")  # a row a document that has the class
    classes = classes.agg(F.min(F.struct("doc_id", "first")).alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = materialise(classes.select("h", "rep.*", "last", "n", "bands"), "banded")
    size = (F.col("n") - SHINGLE + 1).cast("long")
    buckets = materialise(shared_buckets(banded.select(F.explode("bands").alias("key"), F.col("h").alias("id"), size.alias("size"))), "buckets")
    # what is needed further on, without the bands
    classes, places = materialise(banded.drop("bands"), "classes"), materialise(of_paragraphs.drop("bands"), "places")
    discard(banded)

    near = classes.join(buckets.select(F.col("id").alias("h")).distinct(), "h").select("doc_id", "h", "first", "n")
    firsts = units.select("doc_id", "h").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    of_pieces = group_join(units.select("doc_id", "pieces"), firsts, "doc_id", "left_semi").select("doc_id", F.explode("pieces").alias("h"))
    shared = of_pieces.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h")
    cut = of_pieces.join(materialise(shared, "shared").hint("merge"), "h").select("doc_id", "h", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("n"))
    made = materialise(looked_up(documents, near.unionByName(cut)), "stretches")
    discard(units)

    sets = made.where("id IS NOT NULL").select("id", "shingles")
    unpacked = lambda t: [np.frombuffer(x.as_buffer(), dtype=U64) for x in t.column("shingles")]
    found = linked(buckets, lambda tasks: tasks.join(sets.hint("merge"), "id"), unpacked, PERCENT, most_items=2048)
    label = classes.join(found, F.col("h") == F.col("node"), "left").where("component IS NOT NULL OR doc_id <> last")
    label = label.select("h", F.coalesce("component", "h").alias("cluster_id"), F.col("doc_id").alias("from"), F.col("last").alias("to"))
    label = materialise(label, "clusters")
    shared = label.groupBy("cluster_id").agg(F.min("from").alias("owner"), F.max("to").alias("z")).where("owner <> z").select("cluster_id", "owner")
    label = label.join(shared, "cluster_id").select("h", "cluster_id", "owner")
    whole = places.join(label, "h").select("doc_id", "first", "n", "start", "end", "cluster_id", (F.col("owner") == F.col("doc_id")).alias("keep"))
    every = whole.unionByName(materialise(passages(made), "passages"))
    return by_document(every, ["first", "n", "start", "end", "cluster_id", "keep"], decided, "doc_id long, start int, end int, cluster_id long, keep boolean")
