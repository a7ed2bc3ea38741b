"""MinHash near-dedup with min-max hashing: each permutation of the shingle space gives two signature values, the shingles'
minimum and their maximum, so half as many hash evaluations are needed. Either agrees with probability J for two sets of Jaccard similarity J.

The steps, none of which collects ids, links or groups to the driver or a hot group to one task:

1. Each document's distinct shingles give its set's size, a 128-bit hash of the whole set, and band hashes. Written once.
2. Documents with equal sets are one class; from here on a class is one item, named by its smallest doc_id.
3. Bands: classes that share a band hash are a bucket. Nothing but the band keys of classes is shuffled for that.
4. Inside the buckets links are confirmed on full sets, made again from the texts of the members alone: first each class with the least of its buckets,
   then, in buckets that aren't in one component by that, the rest (common.linked). No group is closed over its candidate links.
5. Components of the links, then each class's component goes back to its documents.

With BANDS bands of ROWS values each, a pair at J is a candidate with probability 1 - (1 - J**ROWS)**BANDS at least: at 0.8, all but 6 in a
million; at 0.3, 3 in a hundred.

Defined cases: a null, empty or blank text has an empty set, is linked with nothing and is its own component. With fewer words than a shingle
the whole sequence is the one shingle. Texts are read whole, whatever their length; ties can't arise, as links are exact. An empty table gives an empty result.
Other columns aren't read, so their names may clash. doc_id must be integral, as component_id is the least of a group. Rows that repeat a doc_id are one node and are each returned. A row with a null doc_id has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import U64, WordIds, group_join, linked, materialise, mix64, shared_buckets, shingle_hashes, slices, texts_as_bytes

ROWS, BANDS = 6, 40
PERMUTATIONS = ROWS * BANDS // 2


def word_list(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; bytes.lower and bytes.split are just that."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None, ids: WordIds, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    return np.unique(shingle_hashes(ids.of(word_list(text)), size))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(16)
    return x


class MinMax:
    """Signatures: per permutation the minimum and the maximum of the permuted 32-bit shingles."""

    CHUNK = 2048

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS):
        k = np.arange(1, permutations + 1, dtype=U64)
        self.salt = (mix64(k * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)[:, None]
        self.odd = (mix64(k * U64(0xD1B54A32D192ED03)) >> U64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.rows = rows
        self.place = mix64(np.arange(1, rows + 1, dtype=U64))[None, :] | U64(1)
        self.band = mix64(np.arange(1, 2 * permutations // rows + 1, dtype=U64) + U64(1 << 40))

    def signature(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (shingles >> U64(32)).astype(np.uint32)[None, :]
        low = high = None
        for at in range(0, h.shape[1], self.CHUNK):
            x = _scrambled((h[:, at : at + self.CHUNK] ^ self.salt) * self.odd)
            a, b = x.min(axis=1), x.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return low, high

    def permuted(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """32-bit shingles of any shape under each permutation."""
        return (_scrambled((h ^ salt) * odd) for salt, odd in zip(self.salt[:, 0], self.odd[:, 0], strict=True))

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of the bands, the first half from minima, the rest from maxima; a key names its band, too."""
        low, high = self.signature(shingles)
        v = np.concatenate([low, high]).astype(U64).reshape(-1, self.rows)
        return mix64((mix64(v + self.place) * self.place).sum(axis=1, dtype=U64) ^ self.band).view(np.int64)


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a, b (the set's hash; null for an empty set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids, hashes = WordIds(), MinMax()
        for batch in slices(batches):
            n, a, b, bands = [], [], [], []
            for text in texts_as_bytes(batch.column("text")):
                s = shingle_set(text, ids, size)
                n.append(len(s))
                if len(s):
                    whole = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                    a.append(int(whole[0]))
                    b.append(int(whole[1]))
                    bands.append(hashes.bands(s))
                else:
                    a.append(None)
                    b.append(None)
                    bands.append(None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "a", "b", "bands"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, bands array<long>")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    found = materialise(signatures(documents, shingle), "signatures")
    classes = found.where("a IS NOT NULL AND doc_id IS NOT NULL").groupBy("a", "b")
    classes = materialise(classes.agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")
    buckets = materialise(shared_buckets(classes.select(F.explode("bands").alias("key"), "id", "size")), "buckets")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = materialise(group_join(texts, buckets.select("id").distinct(), "id", "left_semi"), "texts")

    def make_sets(t: pa.Table) -> list[np.ndarray]:
        ids = WordIds()
        return [shingle_set(x, ids, shingle) for x in texts_as_bytes(t.column("text"))]

    label = classes.join(linked(buckets, lambda tasks: tasks.join(texts.hint("merge"), "id"), make_sets, percent), F.col("id") == F.col("node"), "left")
    label = label.select("a", "b", F.coalesce("component", "id").alias("label"), "copies", "id").where("copies > 1 OR label <> id").select("a", "b", "label")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    out = found.select("doc_id", "n_shingles", "a", "b").join(label, ["a", "b"], "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
