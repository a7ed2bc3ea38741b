"""The queries opN_<name> of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontamination as op1
from folioforge.llm import language_id as op3
from folioforge.llm import licences as op7
from folioforge.llm import minhash as op10
from folioforge.llm import neighbours as op6
from folioforge.llm import packing as op8
from folioforge.llm import paragraphs as op4
from folioforge.llm import quotations as op9
from folioforge.llm import secrets as op5
from folioforge.llm import token_counts as op2
from folioforge.session import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op2.document_lengths(op2.token_blocks(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.col("tokens").alias("n_tokens"), "file", "document", "start")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3.predictions(table(spark, sf_dir, "documents"))
    held = F.expr("coalesce(pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5) = 0, false)")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.repeated_passages(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op5.findings(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(findings, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in op5.KINDS[:3]),
        F.expr(f"sha2(CAST({joined.format("filter(findings, x -> x.kind <> 'novel')")} AS BINARY), 256)").alias("base_sha256"),
        F.expr(joined.format("findings")).alias("spans"),
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.licences(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.packed_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def instruct_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of instruction data: each answer of a conversation after the turn before it, with loss on the answer alone, under limits that all bind."""
    turns = op8.instruction_examples(table(spark, sf_dir, "conversations"))
    return op8.packed_examples(turns, op8.Limits(tokens=2048, segments=24, loss=1024), cut=True)


def op9_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.conversations(table(spark, sf_dir, "conversations"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and "_" in k and callable(v)} | {"instruct_pack": instruct_pack}


def oracle_sql() -> dict[str, str]:
    return SQL


#: Words of a text, as the contract has them.
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS g(i) WHERE len(w) > 0
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM d, ks, unnest(generate_series(1, greatest(0, len(w) - k + 1))) AS g(i)
),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + k - 1)) AS g(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op10_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS sh
  FROM d, unnest(generate_series(1, greatest(1, len(w) - 3))) AS g(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT DISTINCT u AS root, u AS node FROM e UNION SELECT root, v FROM reach JOIN e ON e.u = node),
comp AS (SELECT root, min(node) AS c FROM reach GROUP BY root)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON root = d.doc_id
""",
    "op6_neighbours": """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS l FROM e),
q AS (SELECT vec_id, arg_min(v, v) AS v, arg_min(l, v) AS l FROM n WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.l * c.l) AS score
  FROM q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
""",
}
