import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import LONG, clashing, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioforge.llm import packing as op
from folioforge.llm.queries import instruct_pack, op8_pack
from folioforge.llm.tokens import Ids
from folioforge.session import table

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


CACHED = Ids()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["It's", "WE'LL", "don't", "Été", "straße", "<|endoftext|>", "<|x", " ", "\n", "\t", "\x85", "　", "x2", "²", "ΑΣ", "é", "…", "--", "İ", "漢字", "\x1c", "'S"]), max_size=12).map("".join)))
def test_ids_are_those_of_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(CACHED.of(text), "<u4").tolist() == ids(text)


def check(rows, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        want, at = ids(texts[d]) + [1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_documents(spark):
    texts = [None, "", "one", "a b c " * 5000, LONG, "été <|endoftext|> x"] + ["tiny"] * 700
    check(op.packed_documents(clashing(docs(spark, texts))).collect(), dict(enumerate(texts)))
    assert op.packed_documents(docs(spark, ["a"]).where("false")).count() == 0


def test_query(spark, sf):
    check(op8_pack(spark, sf).collect(), {r.doc_id: r.text for r in table(spark, sf, "documents").collect()})


@pytest.mark.parametrize("cut", [True, False])
def test_limits_hold_in_every_dimension(cut):
    rng = random.Random(3)
    limits = op.Limits(tokens=128, segments=5, loss=40)
    sizes = [(n := rng.randint(1, 60 if not cut else 700), rng.randint(0, min(n, 40) if not cut else n)) for _ in range(400)]
    rows = []
    p = op.Packer(lambda x, start, n, seq, off: rows.append((x.key, start, n, seq, off)), limits, cut)
    for i, (n, loss) in enumerate(sizes):
        p.add(op.Example(i, n, loss, None))
    p.finish()
    by_seq, by_key = defaultdict(list), defaultdict(list)
    for key, start, n, seq, off in rows:
        by_seq[seq].append((off, n, sum(start + j >= sizes[key][0] - sizes[key][1] for j in range(n))))
        by_key[key].append((start, n))
    for pieces in by_seq.values():
        assert sum(n for _, n, _ in pieces) <= 128 and len(pieces) <= 5 and sum(x for _, _, x in pieces) <= 40
    for key, (n, _) in enumerate(sizes):
        at = 0
        for start, k in sorted(by_key[key]):
            assert start == at
            at += k
        assert at == n
        assert cut or len(by_key[key]) == 1


def test_examples(spark):
    df = spark.createDataFrame([(i, 100 + i, 50) for i in range(50)] + [(99, 0, 0), (98, None, None)], "example_id long, tokens long, loss_tokens long")
    got = op.packed_examples(df).collect()
    assert sorted(r.example_id for r in got) == list(range(50)) and all(r.start == 0 for r in got)


def test_instruction_data_fills_three_limits(spark):
    """Limits hold in every sequence, each example's tokens are placed once and in order, and loss-bearing ones are those of the answers."""
    d = "/root/testdata/sf0.01"
    limits = op.Limits(tokens=2048, segments=24, loss=1024)
    turns = op.instruction_examples(table(spark, d, "conversations")).collect()
    want = {r.example_id: (r.tokens, r.loss_tokens) for r in turns}
    assert len(want) == len(turns) == table(spark, d, "conversations").where("role = 'assistant'").count() and any(t > n for t, n in want.values())
    parts, sequences = {}, {}
    for r in instruct_pack(spark, d).collect():
        parts.setdefault(r.example_id, []).append((r.start, r.length))
        prompt = want[r.example_id][0] - want[r.example_id][1]
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, max(0, r.start + r.length - max(r.start, prompt))))
    assert {k: sum(n for _, n in v) for k, v in parts.items()} == {k: t for k, (t, _) in want.items()}
    for v in parts.values():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
    for v in sequences.values():
        assert len(v) <= limits.segments and sum(n for _, n, _ in v) <= limits.tokens and sum(x for *_, x in v) <= limits.loss
    loss, tokens = (sum(x) for x in zip(*[(x, n) for v in sequences.values() for _, n, x in v], strict=True))
    ideal = max(loss / limits.loss, tokens / limits.tokens, len(want) / limits.segments)
    assert len(sequences) <= 1.3 * ideal + 40


def test_any_doc_id(spark):
    df = docs(spark, ["a b", None]).selectExpr("concat('k', doc_id) doc_id", "text")
    assert {r.doc_id for r in op.packed_documents(df).collect()} == {"k0", "k1"}
