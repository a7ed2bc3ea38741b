"""The awkward rows that every operator on documents takes: nulls, empty and very long texts, ties, repeats, no rows, clashing names."""

import pytest
from helpers import LONG, clashing, docs

from folioforge.llm import decontamination, language_id, licences, minhash, packing, paragraphs, secrets, token_counts

TEXTS = [None, "", " \n", "a", "the same words in a row", "the same words in a row", "the same words in a row", LONG + " " + LONG, 'key: "Zk3vQ9xP0aLm7TtRw2Yc"', "Released under the MIT License.", "漢字 é\x0b\x00"]
IDS = [1, 2, 3, 4, 5, 5, None, 6, 7, None, 8]


def benchmark(spark):
    return spark.createDataFrame([("x", "same words in"), (None, "a"), ("y", None), ("x", "same words in")], "item_id string, text string")


#: name -> (what makes the rows, whether each document has one)
OPERATORS = {
    "decontamination": (lambda spark, df: decontamination.contamination(df, benchmark(spark)), True),
    "token_counts": (lambda spark, df: token_counts.document_lengths(token_counts.token_blocks(df)), True),
    "language_id": (lambda spark, df: language_id.predictions(df), True),
    "paragraphs": (lambda spark, df: paragraphs.repeated_passages(df), False),
    "secrets": (lambda spark, df: secrets.findings(df), True),
    "licences": (lambda spark, df: licences.licences(df), False),
    "packing": (lambda spark, df: packing.packed_documents(df), False),
    "minhash": (lambda spark, df: minhash.near_duplicates(df), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    make, whole = OPERATORS[name]
    df = clashing(docs(spark, TEXTS, ids=IDS, parts=3))
    rows = make(spark, df).collect()
    found = sorted(str(r.doc_id) for r in rows)
    if whole:
        assert found == sorted(map(str, IDS))
    elif name == "packing":
        assert set(found) == set(map(str, IDS)) and sum(r.length for r in rows if r.doc_id == 1) == 1
    elif name == "licences":
        assert found == ["None"] and rows[0].licence == "MIT"
    else:
        assert found == []  # what repeats here stands under one id or none
    assert make(spark, df.where("false")).count() == 0
