import corpus_pipeline as cp
from helpers import clashing, docs
from pyspark.sql import functions as F
from test_decontamination import brute as contaminated
from test_minhash import brute as groups
from test_packing import check

from folioforge.llm import language_id, secrets
from folioforge.session import table


def test_run_against_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    kept = {d: t for d, t in rows.items() if language_id.has_letter((t or "").encode())}
    comp = groups(list(kept), list(kept.values()), 5)
    kept = {d: t for d, t in kept.items() if comp[d][1] == d}
    kept = {d: t for d, t in kept.items() if not contaminated(t, items)[3]}
    novelty = secrets.Novelty()
    kept = {d: secrets.redacted(t, [(s, e) for s, _, e, _ in secrets.scan(t, t.encode(), novelty)], cp.MARK) for d, t in kept.items()}
    check(cp.run(spark, sf).collect(), kept)


def test_stages_return_the_columns_of_documents(spark, sf):
    df = clashing(docs(spark, [None, "", "the and of that", "the and of that", "another text", "12 34", 'the token = "' + "ab12" * 8 + '" and of'], ids=[1, 2, 3, 3, 3, 4, None]))
    out = {}
    for name, stage in cp.STAGES[:-1]:
        made = stage(spark, df, sf)
        assert made.columns == cp.COLUMNS and [f.dataType for f in made.schema] == [df.schema[c].dataType for c in cp.COLUMNS]
        out[name] = sorted(((r.doc_id, r.text, r.n_chars) for r in made.collect()), key=str)
        assert stage(spark, df.where("false"), sf).count() == 0
    assert len(out["language"]) == 4
    assert len(out["near_duplicates"]) == 6 and {t for d, t, _ in out["near_duplicates"] if d == 3} == {"the and of that", "another text"}
    assert len(out["decontamination"]) == 7
    assert (None, "the [secret]\" and of", 20) in out["secrets"]
    pieces = cp.pack(spark, df, sf)
    assert pieces.count() == 7 and sorted(str(r.doc_id) for r in pieces.collect()) == ["1", "2", "3", "3", "3", "4", "None"] and cp.pack(spark, df.where("false"), sf).count() == 0


def test_predicted_languages_take_effect_and_nothing_is_lost_without_labels(spark):
    train = table(spark, "/root/testdata/sf0.01", "documents").select(cp.COLUMNS)
    truth = {r.doc_id: r.lang for r in train.collect()}
    hidden = train.withColumn("lang", F.when(F.col("doc_id") % 5 == 1, None).otherwise(F.col("lang")))
    got = {r.doc_id: r.lang for r in cp.language(spark, hidden, "").collect()}
    told = [d for d in got if d % 5 == 1 and truth[d]]
    assert len(told) > 100 and sum(got[d] == truth[d] for d in told) >= 0.98 * len(told)
    bare = docs(spark, [None, "", "12", "some words", "des mots"], lang=None)
    assert sorted((r.text, r.lang) for r in cp.language(spark, bare, "").collect()) == [("des mots", None), ("some words", None)]


def test_identifiers_beside_sensitive_words_are_left_alone(spark):
    text = "set the private key in customer_registration_identifier_v2 or monthly_active_users_2024_report of /usr/local/share/applications/python3"
    assert [r.text for r in cp.redact_secrets(spark, docs(spark, [text]), "").collect()] == [text]


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"] and cp.ORACLE_SQL is None
