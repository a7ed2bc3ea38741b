import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, clashing, docs

from folioforge.llm import common
from folioforge.llm import minhash as op
from folioforge.llm.common import U64, WordIds, components, group_stream, spanning_links
from folioforge.llm.queries import op10_minhash
from folioforge.session import shared_folder, table


def shingles(text, k):
    w = op.word_list(None if text is None else text.encode())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(ids, texts, k, percent=80):
    sets = [shingles(t, k) for t in texts]
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(ids[i]), find(ids[j])
                comp[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def mutated(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "one", "One two", "a b c d", "a b c d e", LONG, LONG + " tail", "é É", "x\x0by", "x y"]
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        out += [mutated(rng, base, n) for n in (0, 0, 1, 2, 3, 4, 6)]
    passage = " ".join(f"p{i}" for i in range(60))
    out += [" ".join(f"q{rng.randrange(10**6)}" for _ in range(90)) + " " + passage for _ in range(30)]
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    texts = corpus()
    ids = [1000 - i for i in range(len(texts))]
    got = op.near_duplicates(clashing(docs(spark, texts, ids=ids, parts=5)), shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(ids, texts, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], ids=[5, 5, None])
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in op.near_duplicates(df).collect()) == [(-1, -1, True), (5, 5, True), (5, 5, True)]
    assert op.near_duplicates(df.where("false")).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    """A group far larger than a block, some of whose members link with few others."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [mutated(rng, base, rng.randint(0, 5)) for _ in range(150)]
    whole = op.linked
    monkeypatch.setattr(op, "linked", lambda *a: whole(*a, most_items=16, most_size=2000))
    got = op.near_duplicates(docs(spark, texts), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(list(range(len(texts))), texts, 4)


def test_chain_of_unlike_members_costs_what_its_buckets_cost(spark, monkeypatch):
    """Buckets that overlap in a chain are never one group: rows that go to comparing tasks grow as the chain does."""
    rng = random.Random(3)
    sets = {i: np.array(sorted(rng.sample(range(10**9), 20)), dtype=U64) for i in range(400)}
    keys = spark.createDataFrame([(k, i, 20) for k in range(399) for i in (k, k + 1)], "key long, id long, size long")
    seen = []

    def attach(tasks):
        seen.append(tasks.count())
        rows = [(i, s.tobytes()) for i, s in sets.items()]
        return tasks.join(spark.createDataFrame(rows, "id long, shingles binary"), "id")

    unpacked = lambda t: [np.frombuffer(x.as_buffer(), dtype=U64) for x in t.column("shingles")]
    monkeypatch.setattr(common, "MOST_SENT", 10)  # by the shuffle, too
    assert common.linked(common.shared_buckets(keys), attach, unpacked, 80, most_items=16).count() == 0
    assert len(seen) == 1 and max(seen) <= 4 * 399


def test_buckets_with_the_same_members_are_one(spark):
    rows = [(k, i, 1) for k in range(5) for i in (3, 4, 9)] + [(7, 3, 1), (7, 9, 1), (8, 1, 1)]
    got = common.shared_buckets(spark.createDataFrame(rows, "key long, id long, size long")).collect()
    assert sorted((r.key, r.id, r.lead) for r in got) == [(0, 3, 3), (0, 4, 3), (0, 9, 3), (7, 3, 3), (7, 9, 3)]


def test_scratch_folder_is_never_local_on_a_cluster():
    class Conf:
        get = staticmethod(lambda k: None)

    class Context:
        master, getCheckpointDir, getConf = "spark://host:7077", staticmethod(lambda: None), staticmethod(Conf)

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_signature_values_agree_as_often_as_the_sets():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 900).astype(U64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(U64)])
    h = op.MinMax(600, 1)
    x, y = (np.concatenate(h.signature(s)) for s in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.05


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 21), (21, 22), (22, 20), (30, 30)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 4 for n in range(4, 10)} | {20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(50)}


def test_spanning_links_both_ways_agree():
    rng = random.Random(1)
    ids = WordIds()
    base = [f"w{i}".encode() for i in range(80)]
    sets = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"z{rng.random()}".encode()
        sets.append(np.unique(op.shingle_hashes(ids.of(w), 4)))
    left = np.ones(40, bool)

    def groups(links):
        up = list(range(40))
        for _ in range(40):
            for i, j in links:
                up[i] = up[j] = min(up[i], up[j])
        return up

    every = [(i, j) for i in range(40) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    assert groups(spanning_links(sets, left, left, 80, chunk=16)) == groups(every)


def test_group_stream_joins_runs_across_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [], [2, 2], [2, 3])]
    assert [t.column("k").to_pylist() for t in group_stream(iter(batches), "k")] == [[1, 1], [2, 2, 2, 2], [3]]


def test_query(spark, sf):
    rows = table(spark, sf, "documents").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash(spark, sf).collect()}
    assert got == brute([r.doc_id for r in rows], [r.text for r in rows], 4)
