"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams under a trusted and a raw corpus.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. In each language (a null one is a language
of its own), bucket counts over the trusted texts and over all texts give two smoothed multinomials, so a language's share
of the trusted text has no say; a document's score is the sum of its language's log ratios over its n-grams divided by
their number, and it is kept if that reaches the threshold. All on the JVM side; nothing but counts of rows comes to the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
BUCKETS = 16384
#: Ids of trusted documents are broadcast up to this many (16 bytes each).
BROADCAST_IDS = 2_000_000
#: Weights are broadcast up to this many languages (8 bytes for each bucket of each: 17 MB at BUCKETS).
BROADCAST_LANGS = 128
#: N-grams dealt as in all documents that are added to those of the trusted ones, in each language. No weight is below
#: log(PRIOR / (T + PRIOR)) with T trusted n-grams, so at THRESHOLD no text is rejected by score until T is above 8,328.
PRIOR = 100_000
#: Least mean log ratio of a kept document.
THRESHOLD = -0.08


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _triples(hashes: Column) -> Column:
    """A hash for each window of three words."""
    return F.when(F.size(hashes) >= 3, F.transform(F.slice(hashes, 1, F.size(hashes) - 2), lambda h, k: F.xxhash64(h, F.get(hashes, k + 1), F.get(hashes, k + 2)))).otherwise(F.array().cast("array<bigint>"))


def _grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    n = F.lit(buckets)
    pairs = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, k: F.pmod(F.xxhash64(h, F.get(hashes, k + 1)), n).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, n).cast("int")), pairs)


def _hashes(docs: DataFrame, text_col: str, keep: list) -> DataFrame:
    """``keep`` and the words' hashes."""
    return docs.select(*keep, F.transform(_words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w)).alias("_hashes"))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_base``: a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and the words' hashes. A null text has no words, characters, symbols or lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    docs = docs.withColumn("_parts", F.split(text, _SPACE)).withColumn("_hashes", F.transform(F.filter("_parts", lambda w: w != ""), lambda w: F.xxhash64(w)))
    docs = docs.withColumn("_triples", _triples(F.col("_hashes"))).withColumn("_lines", lines)
    # windows found twice or more, sorted by hash: those equal to a neighbour; then their places in order
    found = F.sort_array(F.transform("_triples", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    docs = docs.withColumn("_sorted", F.when(F.size(F.array_distinct("_triples")) < F.size("_triples"), found).otherwise(F.array().cast("array<struct<h:bigint,k:int>>")))
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
    docs = docs.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["k"])))
    places = F.col("_places")
    repeats = F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.size("_hashes").cast("bigint")
    base = F.struct(
        n.alias("n_words"),
        (F.length(text) - F.size("_parts") + 1).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.col("_hashes").alias("hashes"),
    )
    docs = docs.withColumn("_base", base).drop("_parts", "_triples", "_lines", "_sorted", "_places", "_hashes")
    return docs.withColumn("_base", F.col("_base").withField("base_failed", (F.col("_base.n_words") < 50) | (100 * F.col("_base.n_repeat_words") > 50 * F.col("_base.n_words"))))


def _lang(docs: DataFrame, lang_col: str) -> Column:
    """The language; null for all rows where there is no such column."""
    return (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string")


def _key(lang: Column) -> Column:
    """Names a language in joins; the null one too."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_quality_key, _quality_weights): for each language with trusted documents (those with an id in ``trusted``), the log ratio of each
    bucket's probability among n-grams of its trusted documents to that among n-grams of all its documents. The trusted
    counts get PRIOR n-grams dealt as in all documents of the language, so that little trusted text gives ratios near 1;
    a bucket without n-grams has weight 0. A written table, a row of ``buckets`` numbers for each language."""
    marks = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(1))
    if marks.count() <= BROADCAST_IDS:  # else the documents' hashes are shuffled by id
        marks = F.broadcast(marks)
    docs = docs.select(F.col(id_col).alias("_id"), _key(_lang(docs, lang_col)).alias("_quality_key"), F.col(text_col).alias("_text"))
    langs = written(docs.join(marks, "_id", "left_semi").select("_quality_key").distinct(), "quality-langs")
    few = langs.count() <= BROADCAST_LANGS
    docs = docs.join(F.broadcast(langs) if few else langs, "_quality_key", "left_semi")
    rows = _hashes(docs, "_text", ["_id", "_quality_key"]).join(marks, "_id", "left")
    rows = rows.select("_quality_key", F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(_grams(F.col("_hashes"), buckets)).alias("bucket"))
    found = rows.groupBy("_quality_key", "bucket").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    every = langs.select("_quality_key", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("t"))
    counts = found.unionByName(every).groupBy("_quality_key", "bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    w = Window.partitionBy("_quality_key")  # a row for each bucket
    share = F.col("n") / F.greatest(F.sum("n").over(w), F.lit(1))
    ratio = F.ln((F.col("t") + PRIOR * share) / (F.sum("t").over(w) + PRIOR)) - F.ln(share)
    weighed = counts.select("_quality_key", "bucket", F.when(F.col("n") > 0, ratio).otherwise(0.0).alias("w"))
    table = weighed.groupBy("_quality_key").agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("x"))
    return written(table.select("_quality_key", F.col("x.w").alias("_quality_weights")), "quality-weights")


def judge(docs: DataFrame, bucket_weights: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``_base``, ``_score`` (mean log ratio; 0 without words or where the language has no weights) and
    ``_kept``. The weights of up to BROADCAST_LANGS languages are broadcast, more are joined by shuffle."""
    table = F.broadcast(bucket_weights) if bucket_weights.count() <= BROADCAST_LANGS else bucket_weights
    out = base_counts(docs, text_col).withColumn("_quality_key", _key(_lang(docs, lang_col))).join(table, "_quality_key", "left")
    total = F.aggregate(_grams(F.col("_base.hashes"), buckets), F.lit(0.0), lambda a, g: a + F.get("_quality_weights", g))
    n = F.greatest(2 * F.size("_base.hashes") - 1, F.lit(1))  # words, and pairs of neighbours
    out = out.withColumn("_score", F.when(F.col("_quality_weights").isNotNull(), F.round(total / n, 9)).otherwise(0.0)).drop("_quality_key", "_quality_weights")
    return out.withColumn("_kept", ~F.col("_base.base_failed") & (F.col("_score") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr) of every document.

    ``trusted`` names the trusted documents by id. A null or empty text has no words, so it fails the base rules. Null
    ids and repeated rows are judged like others (a null id is never trusted). Rows of a null language are judged
    among themselves; without the column, all rows are. Other columns are left out. In a language with no trusted document
    all ratios are even, with up to 8,328 trusted n-grams (at the usual PRIOR and threshold) they reject nothing, so that
    the base rules alone act, and an empty table gives none.
    """
    docs = docs.select(id_col, text_col, *{lang_col} & set(docs.columns))
    out = judge(docs, weights(docs, trusted, buckets, id_col, text_col, lang_col), threshold, text_col, lang_col, buckets)
    base = [F.col(f"_base.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return out.select(id_col, *base, F.col("_kept").alias("kept"), F.col("_score").alias("llr"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label says that they are good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_ids(spark, sf_dir))
