import struct

import numpy as np
from helpers import LONG, clashing, docs

from folioforge.llm import token_counts as op
from folioforge.llm.queries import op2_token_counts
from folioforge.llm.tokens import Ids
from folioforge.session import table

IDS = Ids()


def n_tokens(text):
    return len(IDS.of(text)) // 4


def brute(ids, end):
    """(document, start, tokens, ended)"""
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


def blocks(spark, files, size):
    rows = [(f, k, bytearray(np.array(ids[at : at + size], "<u4").tobytes()), None) for f, ids in files.items() for k, at in enumerate(range(0, len(ids), size))]
    return spark.createDataFrame(rows, "file long, block long, ids binary, doc_ids array<long>").repartition(3)


def test_scan_against_brute_force(spark):
    rng = np.random.default_rng(1)
    files = {f: rng.choice([0, 1, 2, 9], p=[0.5, 0.3, 0.15, 0.05], size=n).tolist() for f, n in enumerate((1, 7, 64, 333, 1000))}
    files |= {10: [9, 9, 9], 11: [1] * 50, 12: [1] * 100 + [9], 13: [9]}
    for size, run in ((1, 2), (7, 3), (64, 256)):
        got = op.document_lengths(blocks(spark, files, size), end_id=9, run=run).collect()
        expect = sorted((f, *r) for f, ids in files.items() for r in brute(ids, 9))
        assert sorted((r.file, r.document, r.start, r.tokens, r.ended) for r in got) == expect


def test_documents_of_any_kind(spark):
    texts = [None, "", "one two", LONG, "x", None] + ["same words here"] * 20
    got = op.document_lengths(op.token_blocks(clashing(docs(spark, texts)), block=50)).collect()
    assert sorted((r.doc_id, r.tokens) for r in got) == [(i, n_tokens(t)) for i, t in enumerate(texts)]
    assert op.document_lengths(op.token_blocks(docs(spark, ["a"]).where("false"))).count() == 0


def test_flat_files(spark, tmp_path):
    ids = [5, 6, 7, 0, 8, 0, 0, 9]
    (tmp_path / "a.bin").write_bytes(struct.pack("<8H", *ids))
    got = op.document_lengths(op.read_token_files(spark, str(tmp_path), width=2, block=3), end_id=0).collect()
    assert sorted((r.document, r.start, r.tokens, r.ended) for r in got) == brute(ids, 0)


def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    files = {f"f{i}.bin": rng.integers(0, 50, n).tolist() for i, n in enumerate((0, 1, 99, 100, 101, 5000))}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
    want = sorted(r for ids in files.values() for r in brute(ids, 0))
    read = lambda: op.read_token_files(spark, str(tmp_path), block=100)
    assert read().count() == 1 + 1 + 1 + 2 + 50 and max(len(r.ids) for r in read().collect()) == 400
    assert sorted((r.document, r.start, r.tokens, r.ended) for r in op.document_lengths(read(), end_id=0).collect()) == want
    assert op.opened("viewfs://nowhere/x") is None
    monkeypatch.setattr(op, "opened", lambda path: None)
    assert sorted((r.document, r.start, r.tokens, r.ended) for r in op.document_lengths(read(), end_id=0).collect()) == want


def test_null_ids_and_repeats(spark):
    got = op.document_lengths(op.token_blocks(docs(spark, ["a b", "a b", "a b"], ids=[4, 4, None]))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "None"] and len({(r.file, r.document) for r in got}) == 3


def test_query(spark, sf):
    got = {r.doc_id: r.n_tokens for r in op2_token_counts(spark, sf).collect()}
    assert got == {r.doc_id: n_tokens(r.text) for r in table(spark, sf, "documents").collect()}
