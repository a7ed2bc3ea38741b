"""Token counts: a scan of flat token files for their end-of-document ids, without any index.

A file is a row of little-endian token ids, each document followed by the end id, cut into blocks wherever they fall. Blocks are
scanned for the end id alone, by one vectorised comparison each. What a block can't know - how many tokens, documents and unended tokens come before
it - is an exclusive prefix scan over block summaries, made in two levels: inside runs of RUN blocks, then over the runs of a file, so
even a file with a third of all tokens has no step that takes all its blocks in one task.

Defined cases: a document of no tokens counts 0. Tokens after a file's last end id are a last document with ended = false. A
file without end ids is one such document; an empty file has none, as has an empty table. In `token_blocks`, a null or empty text is a document of no tokens, a null doc_id is
passed on, repeated rows are documents of their own, and a text of any length is cut into as many blocks as it needs. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.llm.common import materialise, slices
from folioforge.llm.tokens import ids_of, packed

#: Tokens in a block; blocks in a run. END is the first id after those of the vocabulary, so no text makes it.
BLOCK, RUN = 65_536, 256
END = 49_408

_BLOCKS = "file long, block long, ids binary, doc_ids array<long>"


def token_blocks(documents: DataFrame, tokenizer: str | None = None, end_id: int = END, block: int = BLOCK) -> DataFrame:
    """file, block, ids, doc_ids: one flat token file for each partition of documents, in blocks of `block` tokens.

    doc_ids, of the documents that end in the block, stand beside the tokens so that counts can be told by document; the scan doesn't read them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number, size = TaskContext.get().partitionId(), 0, 4 * block
        encode, end = ids_of(tokenizer), packed([end_id])
        held, ends, done, base = bytearray(), [], [], 0  # ends: where in the file, in bytes, each document of `done` ends

        def cut(n: int) -> pa.RecordBatch:
            nonlocal number, base
            k = next((i for i, e in enumerate(ends) if e > base + n), len(ends))
            row = [[file], [number], [bytes(held[:n])], [done[:k]]]
            del held[:n], ends[:k], done[:k]
            number, base = number + 1, base + n
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["file", "block", "ids", "doc_ids"])

        for b in slices(batches):
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                held += encode.of(text) + end
                ends.append(base + len(held))
                done.append(key)
                while len(held) >= size:
                    yield cut(size)
        if held:
            yield cut(len(held))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCKS)


def read_token_files(spark: SparkSession, path: str, width: int = 4, block: int = BLOCK) -> DataFrame:
    """The same rows (doc_ids null) from flat files of ids of `width` bytes under a path; a file is named by the hash of its path.

    Files of any size: their lengths are listed, each block is a row, and a task reads the byte ranges of its blocks alone. Files in a store that pyarrow
    doesn't open (`opened`) are read whole by Spark's binaryFile source, one a task, which takes 2 GB at most and raises beyond.
    """
    found = spark.read.format("binaryFile").load(path)
    first = found.select("path").first()
    if first and opened(first.path) is None:
        return found.select(F.xxhash64("path").alias("file"), "content").mapInArrow(_whole(width, block), _BLOCKS)
    size = width * block
    ranges = found.select("path", "length").where("length > 0").select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("block"))
    # neighbouring blocks of a file stay together, and a large file goes to many tasks
    ranges = ranges.repartitionByRange("path", "block").sortWithinPartitions("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = source = None
        for b in batches:
            for path, length, k, file in zip(*(b.column(c).to_pylist() for c in ("path", "length", "block", "file")), strict=True):
                if path != name:
                    if source:
                        source.close()
                    name, source = path, opened(path)
                source.seek(k * size)
                raw = source.read(min(size, length - k * size))
                yield _block(file, k, raw, width)
        if source:
            source.close()

    return ranges.select("path", "length", "block", F.xxhash64("path").alias("file")).mapInArrow(run, _BLOCKS)


def opened(path: str):
    """A file that can be read from any place; None for a store that only Spark's readers know."""
    from pyarrow import fs

    try:
        store, inside = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return store.open_input_file(inside)


def _block(file: int, k: int, raw: bytes, width: int) -> pa.RecordBatch:
    if len(raw) % width:
        raise ValueError(f"a token file's length is no multiple of {width} bytes")
    ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes()
    columns = [pa.array([file], pa.int64()), pa.array([k], pa.int64()), pa.array([ids], pa.binary()), pa.array([None], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["file", "block", "ids", "doc_ids"])


def _whole(width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(b.column("file").to_pylist()):
                raw = memoryview(b.column("content")[i].as_buffer())
                for k, at in enumerate(range(0, len(raw), width * block)):
                    yield _block(name, k, raw[at : at + width * block], width)

    return run


def scanned(blocks: DataFrame, end_id: int = END) -> DataFrame:
    """file, block, tokens, ends (places of the end id in the block), doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in b.column("ids")]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            columns = [b.column("file"), b.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.list_(pa.int64())), b.column("doc_ids")]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "tokens", "ends", "doc_ids"])

    return blocks.mapInArrow(run, "file long, block long, tokens long, ends array<long>, doc_ids array<long>")


def document_lengths(blocks: DataFrame, end_id: int = END, run: int = RUN) -> DataFrame:
    """file, document (its number in the file), start (in tokens), tokens (without the end id), ended, doc_id (null where unknown)."""
    x = materialise(scanned(blocks, end_id), "blocks").withColumn("run", F.floor(F.col("block") / run)).withColumn("k", F.size("ends"))
    x = x.withColumn("last", F.when(F.col("k") > 0, F.element_at("ends", -1)))
    inside = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    x = x.withColumn("off", before).withColumn("docs", F.coalesce(F.sum("k").over(inside), F.lit(0)))
    x = x.withColumn("at", F.col("off") + F.col("last")).withColumn("end", F.max("at").over(inside))
    runs = x.groupBy("file", "run").agg(F.sum("tokens").alias("run_tokens"), F.sum("k").alias("run_k"), F.max("at").alias("run_last"))
    across = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("run_off", F.coalesce(F.sum("run_tokens").over(across), F.lit(0))).withColumn("run_docs", F.coalesce(F.sum("run_k").over(across), F.lit(0)))
    runs = runs.withColumn("run_at", F.col("run_off") + F.col("run_last")).withColumn("run_end", F.max("run_at").over(across))
    y = x.join(runs.select("file", "run", "run_off", "run_docs", "run_end"), ["file", "run"])
    start = F.col("run_off") + F.col("off")
    y = y.where("k > 0").select(
        "file",
        (F.col("run_docs") + F.col("docs")).alias("first"),
        start.alias("base"),
        F.coalesce(F.col("run_off") + F.col("end"), "run_end", F.lit(-1)).alias("prev"),
        "ends",
        "doc_ids",
    )
    z = y.select("*", F.posexplode("ends").alias("i", "e"))
    begin = F.when(F.col("i") == 0, F.col("prev") + 1).otherwise(F.col("base") + F.expr("ends[greatest(i - 1, 0)]") + 1)
    ended = z.select(
        "file",
        (F.col("first") + F.col("i")).alias("document"),
        begin.alias("start"),
        (F.col("base") + F.col("e") - begin).alias("tokens"),
        F.lit(True).alias("ended"),
        F.expr("doc_ids[i]").alias("doc_id"),
    )
    whole = runs.groupBy("file").agg(F.sum("run_tokens").alias("n"), F.sum("run_k").alias("document"), F.coalesce(F.max("run_at"), F.lit(-1)).alias("z"))
    rest = whole.where("n - z - 1 > 0").select(
        "file", "document", (F.col("z") + 1).alias("start"), (F.col("n") - F.col("z") - 1).alias("tokens"), F.lit(False).alias("ended"), F.lit(None).cast("long").alias("doc_id")
    )
    return ended.unionByName(rest)
