import math
import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm import neighbours as op
from folioforge.llm.queries import op6_neighbours
from folioforge.session import table


def brute(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = {}
    for q, a in queries.items():
        s = [(-sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))), i) for i, b in ok if i != q and len(a) == len(b)]
        out[q] = [(i, -s) for s, i in sorted(s)[:k]]
    return out


def rows_of(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def same(got, want):
    want = {q: v for q, v in want.items() if v}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q, v in got.items() for (_, a), (_, b) in zip(v, want[q], strict=True))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("clash")).withColumn("v", F.lit(0)).repartition(3)


def test_awkward_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(100, rows[7][1]), (101, rows[7][1]), (102, [0.0] * 8), (103, None), (104, [1.0, None] * 4), (105, [float("nan")] * 8), (106, [float("inf")] * 8), (None, rows[3][1]),
             (107, []), (110, [1.0, 2.0]), (111, [2.0, 1.0]), (120, [1e-30] * 8), (121, [1e30] * 8), (130, rows[7][1]), (130, rows[7][1])]
    same(rows_of(op.nearest(frame(spark, rows), 5, 10)), brute(rows, 5, 10))


def test_fewer_candidates_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0])]
    same(rows_of(op.nearest(frame(spark, rows), 5, 50)), brute(rows, 5, 50))
    assert op.nearest(frame(spark, rows[:1])).count() == 0
    assert op.nearest(frame(spark, rows).where("false")).count() == 0


def test_blocks_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(op, "QUERY_BLOCK", 16)
    monkeypatch.setattr(op, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(op, "TILE", 20)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 6)) * 2) / 2  # many ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    same_ties = brute(rows, 5, 5)
    got = rows_of(op.nearest(frame(spark, rows), 5, 5))
    for q, want in same_ties.items():
        assert [round(s, 12) for _, s in got[q]] == [round(s, 12) for _, s in want]


def test_error_bound_holds():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(50, 300)), rng.normal(size=(60, 300)) * 1e5
    (aq, as_, al, ar), (bq, bs, bl, br) = op.quantised(a), op.quantised(b)
    near = (aq @ bq.T) * as_[:, None] * bs
    true = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert (np.abs(near - true) <= al[:, None] * br + ar[:, None] * bl + ar[:, None] * br).all()


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    same(rows_of(op6_neighbours(spark, sf)), brute(rows, 5, 50))


def test_equal_vectors_and_extreme_lengths(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, (base * s).tolist()) for i, s in enumerate([1.0] * 300 + [1e-200, 1e200, 5e-300])]
    rows += [(1000 + i, rng.normal(size=16).tolist()) for i in range(50)] + [(7, base.tolist())] * 3
    got = {}
    for r in op.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), k=5, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 1000}
    assert [v for _, v, _ in sorted(got[0])] == [1, 2, 3, 4, 5] and [v for _, v, _ in sorted(got[50])] == [0, 1, 2, 3, 4]
    assert all(abs(s - 1) < 1e-9 for _, _, s in got[300]) and len(got[1000]) == 5


def test_first_of_equals():
    ids, v = np.array([9, 3, 5, 1, 7, 2]), np.array([[1.0, 2], [1, 2], [1, 2], [0, 1], [1, 2], [0, 1]])
    assert ids[op.first_of_equals(ids, v, 2)].tolist() == [3, 5, 1, 2]
