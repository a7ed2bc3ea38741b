"""Approximate nearest neighbours by a block matrix join, with the exact result.

Vectors are scaled to length one and quantised to int8. A task holds one block of queries and one block of candidates and
multiplies them tile by tile. The int8 products are summed exactly (in float32, where whole numbers below 2**24 are exact), and
Cauchy-Schwarz over the residues of quantisation bounds how far a product can be from the cosine. Of each query, candidates whose upper bound
reaches the k-th largest lower bound survive; their cosines are computed from the original vectors in double precision,
and a heap a query keeps the k nearest of the block. What the blocks have kept, k rows a query and block, is ranked once more.

Every candidate is screened by its bound, so recall is 1; nothing is fitted and nothing grows with the corpus but the number of blocks.

Of equal vectors in a block those with the k + 1 least ids are looked at: the others can't be among the k nearest of any query.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; very large and very small ones do, however long they are. An
empty table, or one without a query, gives no rows. Other columns aren't read, so their names may clash. Vectors of different length aren't compared. Ties go to the smaller vec_id. Rows that repeat a vec_id are each a
candidate of other queries, and together one query (the first by its components). Rows with a null vec_id take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a block of queries and of a block of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Candidates in a tile. Components multiplied at once, so that sums of int8 products stay below 2**24.
TILE, DEPTH = 2048, 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers -127..127 (as float32), the scale of each row, the length of the quantised row and of its residue.

    Row = scale * numbers + residue, where row is x at length one.
    """
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    slack = 1e-9  # covers rounding in these lengths
    return q.astype(np.float32), scale, np.sqrt((near * near).sum(axis=1)) + slack, np.sqrt(((unit - near) ** 2).sum(axis=1)) + slack


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither over- nor underflow; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def first_of_equals(ids: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` least ids of each vector: of equal vectors no others can be among the nearest, the query's own among them."""
    order = np.argsort(ids, kind="stable")
    _, kind = np.unique(np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")  # ids still rise inside each
    first = np.flatnonzero(np.r_[True, kind[by_kind][1:] != kind[by_kind][:-1]])
    rank = np.arange(len(by_kind)) - np.repeat(first, np.diff(np.r_[first, len(by_kind)]))
    return np.sort(order[by_kind[rank < most]])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of scaled rows, in double precision, summed component by component in their order."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        aa += a[:, k] * a[:, k]
        bb += b[:, k] * b[:, k]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def nearest_in_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine): the k nearest of each query in a block of candidates, itself left out."""
    q, own = scaled(q), first_of_equals(c_ids, c, k + 1)
    c_ids, c = c_ids[own], scaled(c[own])
    qn, qs, ql, qr = quantised(q)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]  # worst first: (cosine, -id)
    for at in range(0, len(c_ids), TILE):
        tile, ids = c[at : at + TILE], c_ids[at : at + TILE]
        cn, cs, cl, cr = quantised(tile)
        near = np.zeros((len(q), len(tile)))
        for d in range(0, q.shape[1], DEPTH):
            near += qn[:, d : d + DEPTH] @ cn[:, d : d + DEPTH].T
        near *= qs[:, None] * cs[None, :]
        error = ql[:, None] * cr[None, :] + qr[:, None] * cl[None, :] + qr[:, None] * cr[None, :] + 1e-9
        near[q_ids[:, None] == ids[None, :]] = -np.inf
        low = near - error
        n = min(k, low.shape[1])
        bar = -np.partition(-low, n - 1, axis=1)[:, n - 1]
        known = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        i, j = np.nonzero((near + error >= np.maximum(bar if n == k else -np.inf, known)[:, None]) & (near > -np.inf))
        for part in range(0, len(i), 65536):
            a, b = i[part : part + 65536], j[part : part + 65536]
            score = cosine(q[a], tile[b])
            order = np.lexsort((ids[b], -score, a))  # of each query the k nearest go to its heap
            first = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
            best = order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]
            for x, y, s in zip(a[best].tolist(), ids[b[best]].tolist(), score[best].tolist(), strict=True):
                h = heaps[x]
                if len(h) < k:
                    heapq.heappush(h, (s, -y))
                elif (s, -y) > h[0]:
                    heapq.heapreplace(h, (s, -y))
    return [(int(i), -y, s) for i, h in zip(q_ids, heaps, strict=True) for s, y in h]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), dim of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    x = x.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return x.where(F.exists("v", lambda e: e != 0)).withColumn("dim", F.size("v"))


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows whose vec_id is divisible by `every`, against all rows."""
    spark = embeddings.sparkSession
    x = usable(embeddings)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    n, m = embeddings.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c_blocks = max(-(-n // CANDIDATE_BLOCK), min(parts, -(-n // TILE)), 1)
    q_blocks = max(-(-m // QUERY_BLOCK), 1)
    block = lambda salt, blocks: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(blocks)).cast("int")
    # a candidate goes to a task with each block of queries, a query to one with each block of candidates
    cand = x.withColumn("cb", block(1, c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    first = x.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    quer = first.withColumn("qb", block(2, q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    key = ["dim", "qb", "cb"]

    def tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        rows: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            (qi, q), (ci, c) = ((t.column("vec_id").to_numpy(), matrix(t)) for t in (left, right))
            for at in range(0, len(qi), QUERY_BLOCK):  # hashing gives blocks of about that size
                rows += nearest_in_block(qi[at : at + QUERY_BLOCK], q[at : at + QUERY_BLOCK], ci, c, k)
        return pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names)

    found = quer.groupBy(key).cogroup(cand.groupBy(key)).applyInArrow(tiles, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return np.asarray(v.flatten()).reshape(len(v), -1)

