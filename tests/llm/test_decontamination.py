import hashlib
import re

from helpers import LONG, clashing, docs
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioforge.llm import decontamination as op
from folioforge.llm.queries import op1_decontaminate
from folioforge.session import table

ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(13, len(v))
        for a in range(max(1, len(v) - 12) if v else 0):
            win = v[a : a + k]
            for i in range(len(w) - k + 1):
                if w[i : i + k] == win:
                    hit.update(range(i, i + k))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)


ITEM = "One two Three four five six seven eight nine ten eleven twelve thirteen fourteen, fifteen"
BENCH = [(1, ITEM), (10, "Été café"), (2, ITEM), (3, None), (4, "?!"), (None, "lone nullid"), (10, "Été café")]
TEXTS = [None, "", "...", ITEM.upper(), "x " * 300 + ITEM, "so Été-CAFÉ, a", "été café", "lone nullid", "two three four", ITEM + " " + ITEM, LONG + " Été café"]


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect())


def test_cases_against_brute_force(spark):
    d, b = clashing(docs(spark, TEXTS)), spark.createDataFrame(BENCH, ITEMS)
    expect = sorted((i, n, h, tuple(ids), bad) for i, t in enumerate(TEXTS) for n, h, ids, bad in [brute(t, BENCH)])
    assert rows(op.contamination(d, b)) == expect
    assert rows(op.contamination(d, b, block_bytes=60)) == expect  # several automata


def test_spans_are_of_the_original(spark):
    text = "Ü, " + ITEM.upper() + "! rest"
    r = op.contamination(docs(spark, [text]), spark.createDataFrame(BENCH, ITEMS)).first()
    assert [text[s.start : s.end] for s in r.spans] == [ITEM.upper()]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert rows(op.contamination(docs(spark, ["a b"]), none)) == [(0, 2, 0, (), False)]
    assert op.contamination(docs(spark, ["a"]).where("false"), spark.createDataFrame(BENCH, ITEMS)).count() == 0


def test_query(spark, sf):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = {r.doc_id: r for r in op1_decontaminate(spark, sf).collect()}
    docs_ = table(spark, sf, "documents").collect()
    assert len(got) == len(docs_)
    for r in docs_[:40]:
        n, h, ids, bad = brute(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, h, len(ids), bad)
        assert g.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_kept_columns_that_clash_are_refused(spark):
    import pytest

    items = spark.createDataFrame([("a", "x")], "item_id string, text string")
    for name in ("items", "runs__", "n_hit"):
        with pytest.raises(ValueError, match=name):
            op.contamination(docs(spark, ["x"]).selectExpr("*", f"1 AS {name}"), items, ["doc_id", name])
