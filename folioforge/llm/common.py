"""Pieces shared by the operators: the scratch folder, distributed components, exact verification of candidate groups."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import shared_folder

U64 = np.uint64


# ---------------------------------------------------------------- scratch tables


#: Spark drops the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The shuffle files behind it go with the write. The table goes when it is discarded, or else when the driver's JVM ends, as the result of an
    operator may be reading it until then; one that a killed driver leaves is under folioforge/ in the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioforge/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch__ = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(t.scratch__)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- memory of Python workers

#: Bytes of texts that go to a worker at once. The JVM's copy, the worker's and that of the batch after it are held together, in each task that runs.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to workers in batches of BATCH_BYTES at most, but for single rows that are larger; Spark's own bound is 64 MB. A lower one stays."""
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


_KEPT: dict = {}


def kept(key: Hashable, make: Callable[[], object]):
    """make() of the first task of a Python worker that asks for key; later tasks get the same. A worker keeps one such object at a time, whichever operator made it."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what this Python worker keeps for an operator that ran before, and give the memory back to the system; Spark uses workers again."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few Python copies of texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts_as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without a decode."""
    return column.cast(pa.binary()).to_pylist()


def own_names(keep: list[str], made: list[str]) -> None:
    """Raise where a caller asks for columns to be passed on under names that the result needs."""
    if clash := sorted(set(keep) & set(made)):
        raise ValueError(f"columns to keep are named like columns that are made: {', '.join(clash)}; rename them first")


# ---------------------------------------------------------------- hashing

_C1, _C2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_S33 = U64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> _S33)
    x = x * _C1
    x ^= x >> _S33
    x = x * _C2
    x ^= x >> _S33
    return x


class WordIds(dict):
    """Word bytes -> 64-bit hash; emptied when it holds too many, as it is only a cache."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        v = xxhash.xxh64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = v
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


#: Odd multipliers for the positions in a shingle.
_POSITION = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(64)], dtype=U64)


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words along the last axis; of the whole sequence, where it is shorter; none for none. In text order."""
    n = ids.shape[-1]
    if n == 0:
        return ids
    size = min(size, n)
    out = ids[..., : n - size + 1] * _POSITION[0]
    for k in range(1, size):
        out = out + mix64(ids[..., k : n - size + 1 + k] ^ _POSITION[k]) * _POSITION[k]
    return mix64(out + U64(size))


def group_stream(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal key in batches that are sorted by it, each as one table. Holds one run at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(key)[-1] != b.column(key)[x]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- connected components


def _stars(e: DataFrame) -> bool:
    """Whether each node with an edge down has one only, to a node that has none."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).cast("long").alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).cast("long").alias("down"), F.lit(1).alias("up")))
    found = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return found.where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for the nodes of an edge list, component being the smallest node reachable.

    Alternating large-star and small-star steps. A step joins each edge with the least neighbour of its end, so a hub with any
    number of neighbours meets one row per neighbour, which the skew join of AQE can split; minima are summed before they are
    shuffled. Edges are written to the shared folder between rounds. Nodes: any orderable type.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    few = 2 * e.sparkSession.sparkContext.defaultParallelism  # files of a round's tables: they are many rounds, of few bytes a row
    e = materialise(e.coalesce(few), "edges")
    while not _stars(e):
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = e.unionByName(up).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # written, as the skew join splits a hub only where both sides come from shuffles of the join's own
        least = materialise(least.coalesce(few), "least")
        large = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, e = e, materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct().coalesce(few), "edges")
        discard(old, least)
    hubs = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)


# ---------------------------------------------------------------- exact links inside candidate groups


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, chunk: int = 1024) -> list[tuple[int, int]]:
    """Links between sets at 100 * intersection >= percent * union, less those that others already imply.

    left and right say on which side of the block pair a set stands; only pairs with one end on each side are looked at.
    Each set is sorted and distinct. Intersection sizes come from a product of presence matrices, column block by column
    block, over the elements that at least two of the sets hold; counts are exact, as float32 holds them below 2**24.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out, seen = [], Union(n)
    if n <= 12:
        for i in range(n):
            for j in range(i + 1, n):
                if (left[i] and right[j] or left[j] and right[i]) and seen.find(i) != seen.find(j):
                    a, b = sizes[i], sizes[j]
                    if 100 * min(a, b) >= percent * max(a, b):
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if both and 100 * both >= percent * (a + b - both):
                            seen.join(i, j)
                            out.append((i, j))
        return out
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    counts = np.diff(np.r_[first, len(flat)])
    cols = np.repeat(np.arange(len(first)), counts)
    keep = np.repeat(counts >= 2, counts)
    cols, rows = cols[keep], rows[keep]
    li, ri = np.flatnonzero(left), np.flatnonzero(right)
    at_l, at_r = np.full(n, -1), np.full(n, -1)
    at_l[li], at_r[ri] = np.arange(len(li)), np.arange(len(ri))
    common = np.zeros((len(li), len(ri)), dtype=np.float32)
    if len(cols):
        _, cols = np.unique(cols, return_inverse=True)
        cuts = np.searchsorted(cols, np.arange(0, cols[-1] + 1 + chunk, chunk))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            a, b = np.zeros((len(li), chunk), dtype=np.float32), np.zeros((len(ri), chunk), dtype=np.float32)
            r, c = rows[x:y], cols[x:y] - k * chunk
            m = at_l[r] >= 0
            a[at_l[r[m]], c[m]] = 1
            m = at_r[r] >= 0
            b[at_r[r[m]], c[m]] = 1
            common += a @ b.T
    for i in range(len(li)):
        both = common[i].astype(np.int64)
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[li[i]] + sizes[ri] - both))).tolist():
            x, y = int(li[i]), int(ri[j])
            if x != y and seen.join(x, y):
                out.append((x, y))
    return out


def verified_links(items: DataFrame, make_sets: Callable[[pa.Table], list[np.ndarray]], percent: int) -> DataFrame:
    """(u, v): links inside tasks, confirmed on full sets; their components are those of all links.

    items: rows of task, grp, lo, hi, mine, id (an item of block `mine` in the task of blocks lo and hi) with the columns from which make_sets makes the sets. Pairs are never emitted but where they link two components of a task.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = items.repartition(parts, "task").sortWithinPartitions("task", "grp", "lo", "hi", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_u: list[int] = []
        out_v: list[int] = []
        for t in group_stream(batches, "task"):
            key = np.stack([t.column(c).to_numpy() for c in ("grp", "lo", "hi")])
            same = bool((key == key[:, :1]).all())
            for p in [t] if same else [t.filter(pa.array((key == k[:, None]).all(axis=0))) for k in np.unique(key, axis=1).T]:
                mine, lo, hi, ids = (p.column(c).to_numpy() for c in ("mine", "lo", "hi", "id"))
                for a, b in spanning_links(make_sets(p), mine == lo, mine == hi, percent):
                    out_u.append(int(ids[a]))
                    out_v.append(int(ids[b]))
            if len(out_u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])
                out_u, out_v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return x.mapInArrow(run, "u long, v long")


#: Rows of fixed width (five longs at most, so 40 MB) up to which a table is sent to every task.
MOST_SENT = 1_000_000


def group_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with few, which has a short row of fixed width a key. few is counted: up to MOST_SENT rows go to every task, so that rows aren't
    dealt by key at all; more are joined by a shuffle, in which the skew join of AQE splits a hot key's rows.
    """
    few = materialise(few, "groups")
    return rows.join(F.broadcast(few) if few.count() <= MOST_SENT else few, key, how)


def shared_buckets(keys: DataFrame) -> DataFrame:
    """key, id, size, lead: the rows of band keys that several ids share, with the least of these. keys: key, id, size.

    Counts come from partial sums, so a key with a third of all rows is no more than a row a task. Of keys with the very same ids (by number, ends
    and two sums of hashes), as the bands of near copies often are, one stays.
    """
    sums = [F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 31))).alias("s")]
    found = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("n"), *sums).where("lead <> last")
    one = found.groupBy("lead", "last", "n", "x", "s").agg(F.min("key").alias("key")).select("key", "lead")
    return group_join(keys, one, "key")


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """members (grp, id, size) with block and blocks: large groups are cut by hash into as many blocks as `blocks`, of n members and z elements, says."""
    total = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("z")).select("grp", blocks.alias("blocks")).where("blocks > 1")
    x = group_join(members, total, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return x.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))


def linked(
    buckets: DataFrame, attach: Callable[[DataFrame], DataFrame], make_sets: Callable[[pa.Table], list[np.ndarray]], percent: int, most_items: int = 256, most_size: int = 250_000
) -> DataFrame:
    """(node, component) of the ids that have a link: components of all links inside buckets, each confirmed on full sets.

    buckets: of shared_buckets. attach adds to rows of task, grp, lo, hi, mine, id the columns from which make_sets makes the sets.

    First round: each id meets the least ids of its buckets, in tasks of a leader and about most_items of its followers (most_size elements), all of
    which are compared. Where a leader's followers are one task, all pairs of its buckets are; no task holds more, whatever the bucket's size. Second round: buckets of
    leaders with more followers whose members are not all in one component yet. There the members outside the bucket's largest component (the rest) meet each other and that component, in pairs of
    blocks; those inside needn't meet again. Nothing is compared that shares no bucket but by being in one task, so a chain of unlike members costs what
    its buckets cost, and a bucket's work grows with its size times the number of members that are apart.
    """
    blocks = lambda n, z: F.greatest(F.ceil(n / most_items), F.ceil(z / most_size)).cast("int")
    follow = buckets.where("id <> lead").select(F.col("lead").alias("grp"), "id", "size").distinct()
    x = materialise(_dealt(follow, blocks(F.col("n"), F.col("z"))).select("grp", "block", "id"), "followers")
    large = materialise(x.where("block > 0").select(F.col("grp").alias("lead")).distinct(), "large")
    x = x.unionByName(x.select("grp", "block", F.col("grp").alias("id")).distinct())
    own = F.col("block").alias
    first = x.select(F.xxhash64("grp", "block").alias("task"), "grp", own("lo"), own("hi"), own("mine"), "id")
    links = materialise(verified_links(attach(first), make_sets, percent), "links")
    done = components(links)
    if large.isEmpty():
        return done
    y = group_join(buckets, large, "lead", "left_semi")
    y = y.select(F.col("key").alias("grp"), "id", "size").join(done.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    y = materialise(y, "labels")
    mixed = y.groupBy("grp").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("grp")
    y = materialise(group_join(y, mixed, "grp"), "mixed")
    if y.isEmpty():
        return done
    most = y.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("most"))
    y = group_join(y, most, "grp").withColumn("apart", F.col("component") != F.col("most")).select("grp", "id", "size", "apart")
    size = y.groupBy("grp", "apart").agg(blocks(F.count("*"), F.sum("size")).alias("k"))
    size = size.groupBy("grp").agg(F.max(F.when(F.col("apart"), F.col("k"))).alias("rest"), F.max(F.when(~F.col("apart"), F.col("k"))).alias("same"))
    y = group_join(y, size, "grp")
    # blocks of the rest come first, then those of the largest component
    part = F.pmod(F.xxhash64("id", F.lit(8)), F.when(F.col("apart"), F.col("rest")).otherwise(F.col("same"))).cast("int")
    y = y.withColumn("mine", F.when(F.col("apart"), part).otherwise(F.col("rest") + part))
    to_both, to_rest = (F.sequence(F.lit(0), n - 1) for n in (F.col("rest") + F.col("same"), F.col("rest")))
    y = y.withColumn("other", F.explode(F.when(F.col("apart"), to_both).otherwise(to_rest)))
    y = y.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    second = y.select(F.xxhash64("grp", "lo", "hi").alias("task"), "grp", "lo", "hi", "mine", "id")
    return components(links.unionByName(verified_links(attach(second), make_sets, percent)))


__all__ = ["WordIds", "components", "discard", "group_join", "group_stream", "kept", "linked", "materialise", "mix64", "own_names", "release", "shared_buckets", "shingle_hashes", "slices", "small_batches", "spanning_links", "texts_as_bytes", "verified_links"]
