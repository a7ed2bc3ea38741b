"""Language ID: blended-spectrum n-gram presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the sum over n = 1..4 of the cosine of the sets of byte n-grams (of the lower-case UTF-8) that each
holds, divided by four: presence, not counts, so long and short texts are alike. Sets are whole: every n-gram of a landmark counts, and a
text's set is as large as it is. Landmarks are some labelled texts. With C the kernel between landmarks, a text's Nystroem features are its
kernels with the landmarks times C**-1/2; ridge regression of one-versus-rest targets on them is solved once on the driver.
Batches of texts are scored by matrix products: presence by landmarks, in blocks of n-grams, then kernels by weights.

What is learned from: at most `per_language` labelled rows of each language and about `most_rows` in all, the ones with the smallest hash of doc_id, and of
them at most `landmarks` a language and `most_landmarks` in all (a bounded sample; the bounds are those parameters). The driver gets the landmarks' n-grams and the kernels of
the sample's rows with them, no texts. Everything else covers all rows, and each text is read whole.

Defined cases: a null text or one without any letter is `und` with score 0, whatever its length. Rows with null lang are not learned from, and rows with a null doc_id
neither; both are predicted. Repeated rows are each returned. Equal scores: the first language by name. Without any row to learn from, as in an empty table, every text is `und`
(`Model.languages` is then empty). Columns of `keep` named lang_pred or score raise ValueError; other columns are passed on where `keep` names them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from folioforge.llm.common import discard, materialise, own_names, release, slices, texts_as_bytes

GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Texts that are scored at once, and n-grams that a matrix product takes at once.
TEXTS, BLOCK = 256, 8192

_LETTERS = bytes(1 if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0 for b in range(256))


@dataclass(frozen=True)
class Settings:
    per_language: int = 400  # labelled rows learned from, of each language
    landmarks: int = 48  # of them landmarks, of each language
    most_rows: int = 20_000  # rows of all languages, but one of each at least
    most_landmarks: int = 512  # landmarks of all languages
    ridge: float = 1e-2

    def share(self, languages: int) -> tuple[int, int]:
        """Rows and landmarks of each of so many languages; 0 landmarks where not every language has one."""
        n = max(1, languages)
        return max(1, min(self.per_language, self.most_rows // n)), min(self.landmarks, self.most_landmarks // n)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if b"\x01" in text.translate(_LETTERS):
        return True
    return any(c.isalpha() for c in text.decode("utf-8"))


def lowered(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8").lower().encode("utf-8")


def gram_sets(text: bytes) -> list[np.ndarray]:
    """For each n the distinct n-grams of the lower-case text, sorted, as whole numbers of n bytes."""
    b = np.frombuffer(lowered(text), dtype=np.uint8)
    out, x = [], b.astype(np.uint32)
    for n in GRAMS:
        if n > 1:
            x = x[:-1] << np.uint32(8) | b[n - 1 :] if len(b) >= n else x[:0]
        if n <= 2 and len(x) > 256:
            seen = np.zeros(1 << 8 * n, dtype=bool)
            seen[x] = True
            out.append(np.flatnonzero(seen).astype(np.uint32))
        else:
            out.append(np.unique(x))
    return out


def held_out(doc_id: object) -> bool:
    """Rows by which accuracy is measured: crc32 of the id as text, mod 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


class Landmarks:
    """n-gram sets of texts, and the kernels of other texts with them."""

    def __init__(self, sets: list[list[np.ndarray]]):
        self.n = len(sets)
        self.grams, self.held, self.sizes = [], [], []
        for k in range(len(GRAMS)):
            own = [s[k] for s in sets]
            grams = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.uint32)
            held = np.zeros((len(grams), self.n), dtype=np.uint8)
            for i, g in enumerate(own):
                held[np.searchsorted(grams, g), i] = 1
            self.grams.append(grams)
            self.held.append(held)
            self.sizes.append(np.array([max(1, len(g)) for g in own], dtype=np.float32))

    def kernels(self, texts: list[bytes]) -> np.ndarray:
        """Texts x landmarks."""
        sets = [gram_sets(t) for t in texts]
        out = np.zeros((len(texts), self.n), dtype=np.float32)
        for k, (grams, held, sizes) in enumerate(zip(self.grams, self.held, self.sizes, strict=True)):
            if not len(grams):
                continue
            places = []
            for s in sets:
                at = np.searchsorted(grams, s[k])
                at[at == len(grams)] = 0
                places.append(at[grams[at] == s[k]])
            common = np.zeros_like(out)
            for lo in range(0, len(grams), BLOCK):
                seen = np.zeros((len(texts), min(BLOCK, len(grams) - lo)), dtype=np.float32)
                for i, at in enumerate(places):
                    a, z = np.searchsorted(at, [lo, lo + BLOCK])
                    seen[i, at[a:z] - lo] = 1
                common += seen @ held[lo : lo + BLOCK].astype(np.float32)
            own = np.array([max(1, len(s[k])) for s in sets], dtype=np.float32)
            out += common / np.sqrt(own[:, None] * sizes[None, :])
        return out / len(GRAMS)


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for at in range(0, len(known), TEXTS) if self.languages else ():
            part = known[at : at + TEXTS]
            made = self.landmarks.kernels([texts[i] for i in part]) @ self.weights
            best = made.argmax(axis=1)
            for i, b, s in zip(part, best.tolist(), made.max(axis=1).tolist(), strict=True):
                lang[i], score[i] = self.languages[b], min(1.0, max(0.0, s))
        return lang, score


def sample(documents: DataFrame, settings: Settings) -> DataFrame:
    """lang, key, text, rank, landmark: some rows of each language, none of them held out, smallest hash first.

    Counts by language give a threshold on the hash, under which about twice as many rows lie as are wanted; only
    those are ranked, so no language's rows meet in one task.
    """
    learn = "lang IS NOT NULL AND doc_id IS NOT NULL AND pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5) <> 0"
    df = documents.select("doc_id", "lang", "text").where(f"text IS NOT NULL AND {learn}")
    df = df.withColumn("key", F.xxhash64(F.lit(11), "doc_id"))
    counts = materialise(df.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    languages = counts.count()
    rows, landmarks = settings.share(languages)
    share = counts.withColumn("share", F.lit(2.6 * rows + 20) / F.col("n")).drop("n")
    # one row a language; a column of so many values that they don't fit is joined by a shuffle
    near = df.join(F.broadcast(share) if languages <= 100_000 else share, "lang").where(F.col("key") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key", F.xxhash64("text")))
    found = near.select("lang", "key", "text").withColumn("rank", rank).where(F.col("rank") <= rows)
    if landmarks:
        return found.withColumn("landmark", F.col("rank") <= landmarks)
    # more languages than landmarks: those of some languages, by hash
    return found.withColumn("landmark", (F.col("rank") == 1) & (F.pmod(F.xxhash64("lang", F.lit(12)), F.lit(languages)) < settings.most_landmarks))


def fit(documents: DataFrame, settings: Settings = Settings()) -> Model:
    rows = materialise(sample(documents, settings), "sample")
    names = [f"g{n}" for n in GRAMS]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [gram_sets(t) for t in texts_as_bytes(b.column("text")) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([m[k].tobytes() for m in made], pa.binary()) for k in range(len(GRAMS))], names)

    found = rows.where("landmark").select("lang", "rank", "text").mapInArrow(sets, ", ".join(f"{n} binary" for n in names)).collect()
    landmarks = Landmarks(sorted(([np.frombuffer(r[n], dtype=np.uint32) for n in names] for r in found), key=lambda s: [x.tobytes() for x in s]))
    shared = documents.sparkSession.sparkContext.broadcast(landmarks)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, TEXTS):
            texts = [(lang, t) for lang, t in zip(b.column("lang").to_pylist(), texts_as_bytes(b.column("text")), strict=True) if has_letter(t)]
            made = shared.value.kernels([t for _, t in texts])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts], pa.string()), pa.array([m.tobytes() for m in made], pa.binary())], ["lang", "kernels"])

    learned = rows.select("lang", "text").mapInArrow(kernels, "lang string, kernels binary").collect() if landmarks.n else []  # most_rows x most_landmarks numbers at most
    discard(rows)
    learned = sorted((r["lang"], bytes(r["kernels"])) for r in learned)
    return solve(landmarks, [x for x, _ in learned], np.array([np.frombuffer(k, dtype=np.float32) for _, k in learned], dtype=np.float64).reshape(len(learned), landmarks.n), settings)


def solve(landmarks: Landmarks, labels: list[str], kernels: np.ndarray, settings: Settings) -> Model:
    """kernels: rows x landmarks, of rows of these labels."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], landmarks, np.zeros((landmarks.n, 0), np.float32))
    between = np.zeros((landmarks.n, landmarks.n))
    for held, sizes in zip(landmarks.held, landmarks.sizes, strict=True):
        for lo in range(0, len(held), BLOCK):
            part = held[lo : lo + BLOCK].astype(np.float32)
            between += (part.T @ part) / np.sqrt(sizes[:, None] * sizes[None, :])
    values, vectors = np.linalg.eigh(between / len(GRAMS))
    good = values > values.max() * 1e-6
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    z = kernels @ root
    targets = np.array([[1.0 if x == language else 0.0 for language in languages] for x in labels])
    w = np.linalg.solve(z.T @ z + settings.ridge * len(labels) / len(languages) * np.eye(z.shape[1]), z.T @ targets)
    return Model(languages, landmarks, (root @ w).astype(np.float32))


def predictions(documents: DataFrame, keep: list[str] | None = None, settings: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """The kept columns, lang_pred, score. One scan to count, one to sample, one to predict; nothing of the size of the corpus is shuffled."""
    keep = ["doc_id"] if keep is None else keep
    own_names(keep, ["lang_pred", "score"])
    model = fit(documents, settings) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            lang, score = shared.value.predict(texts_as_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = StructType([documents.schema[c] for c in keep] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
