"""Packing: vector bin packing of examples into training sequences, by the dot-product heuristic.

An example has a size in three dimensions: tokens, segments (1) and loss-bearing tokens; a sequence has a limit in each. Of the
examples in a window, the one that fits and has the largest dot product with what is left of the open sequence, both as shares
of the limits, is placed next. Where cutting is allowed and none fits, the example with the largest dot product is cut
so that it fills the sequence to a limit, and the rest goes back to the window. A sequence that ends before its token limit (its segments or
loss tokens are used up, or the examples are) is cut back to a power of two, a length that needs no padding, and what was cut
off goes on to the next one; the tail of a partition becomes the few powers of two that add up to it.

Each partition is packed for itself, in one pass that holds one window of examples: no shuffle, and no more than about
2 * WINDOW examples in memory. Sequence ids are the partition's number and a count in it, so the input's partitions fix them.

Defined cases: a null or empty text still has its end id, so it is one piece. Long texts are cut into as many pieces as they need.
Repeated rows are packed each; a doc_id of any type, or null, is passed on. Ties of the dot product: the example that came first. An empty table gives no pieces.
Other columns aren't read, so their names may clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from folioforge.llm.common import slices
from folioforge.llm.tokens import ids_of, packed

#: Examples that the heuristic chooses among.
WINDOW = 64
#: Pieces that leave a task at once: up to 8 KB each, and the worker and the JVM hold a copy each.
PIECES = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass(slots=True)
class Example:
    """What is left of an example: start tokens of it are placed already."""

    key: int
    tokens: int
    loss: int  # loss-bearing tokens of the rest; they stand at its end
    payload: object
    start: int = 0

    def loss_of(self, n: int) -> int:
        """Loss-bearing tokens among its next n tokens."""
        return max(0, n - (self.tokens - self.loss))


class Packer:
    """place() gets each (example, start, length, sequence, offset) as soon as its sequence is closed."""

    def __init__(self, place: Callable[[Example, int, int, int, int], None], limits: Limits, cut: bool = True, window: int = WINDOW):
        self.place, self.limits, self.cut, self.window = place, limits, cut, window
        self.pool: list[Example] = []
        self.sequence = 0
        self.open: list[tuple[Example, int, int]] = []  # example, start, length
        self.left = [limits.tokens, limits.segments, limits.loss]

    def add(self, x: Example) -> None:
        if not self.cut and (x.tokens > self.limits.tokens or x.loss > self.limits.loss):
            raise ValueError(f"an example of {x.tokens} tokens, {x.loss} loss-bearing, is larger than a sequence; allow cutting")
        full = self.limits.tokens
        # whole sequences of a long example need no choice
        while self.cut and x.tokens >= full and x.loss_of(full) <= self.limits.loss:
            self.place(x, x.start, full, self.sequence, 0)
            self.sequence += 1
            self.take(x, full)
        if x.tokens:
            self.pool.append(x)
            while len(self.pool) >= self.window:
                self.step()

    @staticmethod
    def take(x: Example, n: int) -> None:
        loss = x.loss_of(n)
        x.start, x.tokens, x.loss = x.start + n, x.tokens - n, x.loss - loss

    def most(self, x: Example) -> int:
        """Tokens of x that the open sequence can take."""
        n = min(x.tokens, self.left[0])
        return min(n, x.tokens - x.loss + self.left[2]) if self.left[1] else 0

    def step(self) -> None:
        """Place one example or part of one in the open sequence, or close it."""
        tokens = np.array([x.tokens for x in self.pool])
        loss = np.array([x.loss for x in self.pool])
        full = self.limits
        dot = tokens * (self.left[0] / full.tokens**2) + loss * (self.left[2] / full.loss**2) + self.left[1] / full.segments**2
        fits = (tokens <= self.left[0]) & (loss <= self.left[2]) & (self.left[1] > 0)
        if fits.any():
            i = int(np.argmax(np.where(fits, dot, -1.0)))
            x = self.pool.pop(i)
            self.put(x, x.tokens)
        elif self.cut and self.left[1] and (i := int(np.argmax(dot))) >= 0 and self.most(self.pool[i]):
            self.put(self.pool[i], self.most(self.pool[i]))
        else:
            self.close()
        if self.left[0] == 0:
            self.close()

    def put(self, x: Example, n: int) -> None:
        self.left[2] -= x.loss_of(n)
        self.left[0] -= n
        self.left[1] -= 1
        self.open.append((Example(x.key, n, x.loss_of(n), x.payload, x.start), x.start, n))
        self.take(x, n)

    def close(self) -> None:
        total = self.limits.tokens - self.left[0]
        goal = total if total == self.limits.tokens or not self.cut else 1 << (total.bit_length() - 1)
        back = []
        while total > goal:
            x, start, n = self.open.pop()
            over = min(n, total - goal)
            total -= over
            if over < n:
                self.open.append((x, start, n - over))
            rest = Example(x.key, n, x.loss, x.payload, start)
            self.take(rest, n - over)
            back.append(rest)
        offset = 0
        for x, start, n in self.open:
            self.place(x, start, n, self.sequence, offset)
            offset += n
        self.sequence += bool(self.open)
        self.open, self.left = [], [self.limits.tokens, self.limits.segments, self.limits.loss]
        self.pool += back

    def finish(self) -> None:
        while self.pool or self.open:
            if self.pool:
                self.step()
            else:
                self.close()


PIECE = [
    StructField("start", LongType()),
    StructField("length", LongType()),
    StructField("ids", BinaryType()),
    StructField("ids_crc32", LongType()),
    StructField("doc_tokens", LongType()),
    StructField("sequence_id", LongType()),
    StructField("offset", LongType()),
]


def packed_documents(documents: DataFrame, tokenizer: str | None = None, end_id: int = 1, limits: Limits = Limits(), with_ids: bool = True, cache: int = 1_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (packed, or null without with_ids), ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, without special tokens, then end_id; all bear loss. cache: entries that a worker keeps, by tokens.ids_of.
    """
    fields = [documents.schema["doc_id"], *PIECE]

    def examples(batches: Iterable[pa.RecordBatch]) -> Iterator[Example]:
        encode = ids_of(tokenizer, cache)
        end = packed([end_id])
        for b in slices(batches):
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode.of(text) + end
                yield Example(key, len(ids) // 4, len(ids) // 4, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def place(x: Example, start: int, n: int, sequence: int, offset: int) -> None:
            ids = x.payload[4 * start : 4 * (start + n)]
            rows.append((x.key, start, n, ids if with_ids else None, zlib.crc32(ids), len(x.payload) // 4, base + sequence, offset))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            types = list(to_arrow_schema(StructType(fields)).types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.name for f in fields])

        packer = Packer(place, limits)
        for x in examples(batches):
            packer.add(x)
            if len(rows) >= PIECES:
                yield batch()
        packer.finish()
        yield batch()

    return documents.select("doc_id", "text").mapInArrow(run, StructType(fields))


def instruction_examples(messages: DataFrame, tokenizer: str | None = None, answers: str = "assistant") -> DataFrame:
    """example_id, tokens, loss_tokens: one example an answer. Its prompt is the message before it, if any; the answer's tokens and an end token bear loss.

    example_id is conv_id * 2**20 + turn. Null texts are empty. Rows with null conv_id or turn, and other roles, are no examples. Rows that repeat a turn are each an answer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(tokenizer)
        for b in slices(batches):
            n = pa.array([len(encode.of(t)) // 4 for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), n], ["conv_id", "turn", "role", "n"])

    x = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").selectExpr("CAST(conv_id AS BIGINT) conv_id", "CAST(turn AS BIGINT) turn", "role", "text")
    x = x.mapInArrow(run, "conv_id long, turn long, role string, n long")
    x = x.withColumn("before", F.coalesce(F.lag("n").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(0)))
    own = F.col("n") + 1
    return x.where(F.col("role") == answers).select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("example_id"), (F.col("before") + own).alias("tokens"), own.alias("loss_tokens"))


def packed_examples(examples: DataFrame, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Instruction data: rows of example_id long, tokens long, loss_tokens long -> example_id, start, length, sequence_id, offset.

    Loss-bearing tokens stand at the end of an example. Without cutting, an example larger than a sequence raises ValueError.
    Null sizes count as 0, and an example of no tokens makes no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        packer = Packer(lambda x, start, n, sequence, offset: rows.append((x.key, start, n, base + sequence, offset)), limits, cut)
        names = ["example_id", "start", "length", "sequence_id", "offset"]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in slices(batches):
            for key, n, loss in zip(*(b.column(c).to_pylist() for c in ("example_id", "tokens", "loss_tokens")), strict=True):
                if n:
                    packer.add(Example(key, n, min(loss or 0, n), None))
            yield batch()
        packer.finish()
        yield batch()

    return examples.selectExpr("CAST(example_id AS BIGINT) example_id", "CAST(tokens AS BIGINT) tokens", "CAST(loss_tokens AS BIGINT) loss_tokens").mapInArrow(
        run, "example_id long, start long, length long, sequence_id long, offset long"
    )
