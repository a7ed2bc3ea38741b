"""What Python workers hold: one kept object at a time, and small batches in the pipeline."""

import gc
import weakref

import corpus_pipeline as cp
import pyarrow as pa
import pytest
from helpers import docs
from pyspark.sql import functions as F

from folioforge.llm import common, decontamination, language_id, packing, tokens

SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def bound(spark):
    before = spark.conf.get(SIZE)
    yield
    spark.conf.set(SIZE, before)


class Shared:
    value = [("a", b"one two three")]


def test_a_worker_keeps_what_one_operator_needs_and_no_more():
    ids = tokens.ids_of()
    assert tokens.ids_of() is ids
    gone, shared = weakref.ref(ids), Shared()
    del ids
    built = decontamination._built(shared, 13)
    gc.collect()
    assert gone() is None and decontamination._built(shared, 13) is built
    assert tokens.ids_of() is tokens.ids_of() and decontamination._built(shared, 13) is not built


def test_language_begins_without_what_other_operators_keep(spark):
    df = docs(spark, ["the and of that", "les et des que"], parts=1)

    def held(batches):
        tokens.ids_of(limit=1)
        run = made.func(batches)
        next(run)
        yield pa.RecordBatch.from_arrays([pa.array([len(common._KEPT)], pa.int64())], ["n"])

    class Caught:
        """The function that predictions() gives to mapInArrow."""

        def __init__(self, df):
            self.df, self.sparkSession, self.schema = df, df.sparkSession, df.schema

        def select(self, *columns):
            return Caught(self.df.select(*columns))

        def mapInArrow(self, func, schema):
            self.func = func
            return self

    made = Caught(df)
    made = language_id.predictions(made, model=language_id.Model([], language_id.Landmarks([]), None))
    func = made.func
    made = type("Made", (), {"func": staticmethod(func)})
    assert [r.n for r in df.select("doc_id", "text").mapInArrow(held, "n long").collect()] == [0]


def test_stages_send_small_batches(spark, bound):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("abcdefgh "), 400).alias("text"))
    df = docs(spark, ["some words", None])
    for _, stage in cp.STAGES:
        spark.conf.set(SIZE, "64m")
        stage(spark, df, "/root/testdata/sf0.001")
        got = rows.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 9000 and max(r.size for r in got) <= 1.1 * common.BATCH_BYTES
    spark.conf.set(SIZE, "1m")
    common.small_batches(spark)
    assert spark.conf.get(SIZE) == "1m"


def test_pieces_leave_in_small_batches(spark):
    func = []

    class Caught:
        schema = docs(spark, [None]).schema

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            func.append(f)

    packing.packed_documents(Caught())
    run = func[0]

    def sizes(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    df = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("tiny words "), 40).alias("text"))
    got = [r.n for r in df.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 6000 and max(got) <= 2 * packing.PIECES
