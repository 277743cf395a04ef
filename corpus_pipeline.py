"""From raw documents to packed token sequences: five stages, each over all that the one before it kept.

Each stage takes (spark, documents, folder of the tables) and returns documents (the last one: pieces of sequences),
which are written and read again before the next. Rows with nulls in any column, empty tables and extra columns pass
through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import ngram_join, packing, pii, quality_rules, suffix_dedup
from tracewell.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    weights = quality_rules.weights(docs, quality_rules.trusted_ids(spark, sf_dir))
    # numbered rows keep the filter above the verdict's steps; pushed below them, it would work each out many times over
    judged = quality_rules.judge(docs, weights).withColumn("_row", F.monotonically_increasing_id())
    return judged.where("_kept and _row >= 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one of least id.

    Every row is a document of its own, also where its id is null or repeated: a row without an id comes after those
    with one, and of rows of one id the least by hash of the text stays. A text without words is linked with nothing,
    and stays.
    """
    facts = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if facts.n == facts.ids:
        groups = ngram_join.similar_groups(docs, width=5, percent=80)
        return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    key = "_key"
    while key in docs.columns:
        key += "_"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    groups = ngram_join.similar_groups(rows, width=5, percent=80, id_col=key).select(key, "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("h"), key)
    least = rows.select(key, order.alias("o")).join(groups, key).groupBy("component_id").agg(F.min("o").alias("o"))
    return rows.join(least.select(F.col(f"o.{key}")), key, "left_semi").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that occur before."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("PII", personal_data), ("packing", pack)]

#: SQL can't express suffix sorting of bytes, the field's spans or the tokenizer; tests hold it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
