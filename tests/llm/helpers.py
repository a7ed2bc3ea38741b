"""Small tables with the awkward cases that every operator has to take."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def docs(spark, texts, lang="en", ids=None, parts=2):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def clashing(df):
    """Extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["key", "id", "u", "v", "grp", "size", "n", "rank", "score", "items", "runs__", "findings", "task", "component", "start", "kept"]
    return df.select("*", *(F.lit(1).alias(n) for n in names if n not in df.columns))


LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
