"""Source divergence audit: how far the sources of a language are from each other, term by term.

The counts of a term in two sources are a cell of their joint histogram. Few different cells hold all terms of a
vocabulary, so the histogram of each pair of sources is tallied first, with the cells in which one count or both are
zero, which no row of the counts names; the divergence is worked out once for each cell and multiplied.

Terms are counted in the tasks that read the texts and summed by one shuffle on (language, term). Terms with the same
counts in all sources are one row before pairs are made, and a row holds at most ``BLOCK`` sources: larger languages
meet block by block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .terms import LETTERS, counted, strings, texts

#: Terms in fewer documents of a language are left out.
LEAST_DOCS = 3
#: Terms reported for each group.
TOP_TERMS = 200
#: Sources of a language in one row.
BLOCK = 32
#: Counted terms that a task holds before it passes them on.
HELD = 300_000
#: The scale of probabilities.
SCALE = 1_000_000_000


def _named(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def _rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (uses, docs) in held.items():
        n = len(uses)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), strings(list(uses)), pa.array(uses.values(), pa.int64()), pa.array([docs[t] for t in uses], pa.int64())], ["lang", "source", "term", "uses", "docs"])


def tallies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, uses, docs): partial counts of each task, some rows for the same key. Each row is a document
    of its own; a null text has no terms, a null lang or source is ''."""

    def tally(batches):
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            lang, source, text = batch.columns
            for key in zip(lang.to_pylist(), source.to_pylist(), texts(text), strict=True):
                found = counted(key[2], LETTERS)
                uses, seen = held[key[:2]]
                before = len(uses)
                uses.update(found)
                seen.update(found.keys())
                size += len(uses) - before
                if size > HELD:
                    yield from _rows(held)
                    held.clear()
                    size = 0
        yield from _rows(held)

    return docs.select(_named("lang"), _named("source"), "text").mapInArrow(tally, "lang string, source string, term string, uses bigint, docs bigint")


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, uses, total, lead) of terms in at least ``least`` documents of their language; ``total`` is
    the count in the language, ``lead`` marks one row of each (lang, term)."""
    dealt = tallies(docs).repartition("lang", "term")  # what follows needs no other shuffle; tasks have summed before
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    counts = counts.withColumn("all", F.sum("docs").over(w)).withColumn("total", F.sum("uses").over(w)).withColumn("lead", F.row_number().over(w.orderBy("source")) == 1)
    return counts.where(F.col("all") >= least).select("lang", "source", "term", "uses", "total", "lead")


def group_figures(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, k, n, v, n_lang, sources) of every group, also without terms: its number in the language, its count
    over kept terms, the language's kept terms, count and groups."""
    sums = kept.groupBy("lang", "source").agg(F.sum("uses").alias("n"), F.sum(F.col("lead").cast("long")).alias("v"))
    every = docs.select(_named("lang"), _named("source")).distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "v"])
    w = Window.partitionBy("lang")  # a row for each group
    return every.select("lang", "source", (F.row_number().over(w.orderBy("source")) - 1).alias("k"), "n", F.sum("v").over(w).alias("v"), F.sum("n").over(w).alias("n_lang"), F.count("*").over(w).alias("sources"))


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE (count + 1) / (n + v)), exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast({n} + {v} as decimal(20, 0))")


def joint_counts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, terms): of groups numbered a < b, how many terms have these counts, both above 0."""
    rows = kept.join(groups.select("lang", "source", "k"), ["lang", "source"])
    cells = rows.groupBy("lang", "term", F.floor(F.col("k") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", "uses"))).alias("x"))  # BLOCK entries at most
    same = cells.groupBy("lang", "block", "x").agg(F.count("*").alias("terms"))
    inner = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a["k"].alias("a"), b["k"].alias("b"), a["uses"].alias("ca"), b["uses"].alias("cb")))))
    within = same.where(F.size("x") > 1).select("lang", "terms", F.explode(inner).alias("c"))
    large = cells.join(groups.where(F.col("sources") > BLOCK).select("lang").distinct(), "lang", "left_semi")
    other = large.select("lang", "term", F.col("block").alias("block2"), F.col("x").alias("y"))
    met = large.join(other, ["lang", "term"]).where("block < block2").groupBy("lang", "x", "y").agg(F.count("*").alias("terms"))
    outer = F.flatten(F.transform("x", lambda a: F.transform("y", lambda b: F.struct(a["k"].alias("a"), b["k"].alias("b"), a["uses"].alias("ca"), b["uses"].alias("cb")))))
    across = met.select("lang", "terms", F.explode(outer).alias("c"))
    return within.unionByName(across).groupBy("lang", "c.a", "c.b", "c.ca", "c.cb").agg(F.sum("terms").alias("terms"))


def cells(kept: DataFrame, groups: DataFrame, joint: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, terms): ``joint`` with the cells in which a count is zero. A source's terms that the other
    lacks are all its terms less those they share, and what neither has is the rest of the vocabulary."""
    own = kept.join(groups.select("lang", "source", "k"), ["lang", "source"]).groupBy("lang", "k", "uses").agg(F.count("*").alias("terms"))
    left, right = (groups.select("lang", F.col("k").alias(c), "v") for c in "ab")
    pairs = left.join(right.drop("v"), "lang").where("a < b")  # as many as the result has rows
    by_a = pairs.join(own.select("lang", F.col("k").alias("a"), "uses", "terms"), ["lang", "a"]).select("lang", "a", "b", F.col("uses").alias("ca"), F.lit(0).cast("long").alias("cb"), "terms")
    by_b = pairs.join(own.select("lang", F.col("k").alias("b"), "uses", "terms"), ["lang", "b"]).select("lang", "a", "b", F.lit(0).cast("long").alias("ca"), F.col("uses").alias("cb"), "terms")
    zero = F.lit(0).cast("long")

    def moved(df: DataFrame, ca: Column, cb: Column, terms: Column) -> DataFrame:
        return df.select("lang", "a", "b", ca.alias("ca"), cb.alias("cb"), terms.alias("terms"))

    n = F.col("terms")
    parts = [joint, by_a, by_b, moved(pairs, zero, zero, F.col("v")), moved(by_a, zero, zero, -n), moved(by_b, zero, zero, -n), moved(joint, F.col("ca"), zero, -n), moved(joint, zero, F.col("cb"), -n), moved(joint, zero, zero, n)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("terms").alias("terms")).where("terms > 0")


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def pair_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the divergence of each group from each other source of its language."""
    joint = written(joint_counts(kept, groups), "divergence-joint")
    side = groups.select("lang", "k", "source", "n", "v")
    a = side.select("lang", F.col("k").alias("a"), F.col("source").alias("source_a"), F.col("n").alias("n_a"), "v")
    b = side.select("lang", F.col("k").alias("b"), F.col("source").alias("source_b"), F.col("n").alias("n_b"))
    c = cells(kept, groups, joint).join(a, ["lang", "a"]).join(b, ["lang", "b"])
    c = c.withColumn("p", share("ca", "n_a", "v")).withColumn("q", share("cb", "n_b", "v"))
    sums = c.groupBy("lang", "source_a", "source_b").agg(F.sum(F.expr("terms * ((p - q) * (p - q) div q)")).alias("ab"), F.sum(F.expr("terms * ((p - q) * (p - q) div p)")).alias("ba"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("ba").alias("value")))).alias("x")).select("lang", "x.*")
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the result's rows
    return _ranked(every.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"]))


def term_part(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms that a group has more of than its language."""
    t = kept.join(groups.select("lang", "source", "n", "v", "n_lang"), ["lang", "source"])
    t = t.withColumn("p", share("uses", "n", "v")).withColumn("q", share("total", "n_lang", "v")).where("p > q")
    return _ranked(t.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))).where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(lang, source, text)``: part ``pair`` has all other sources of the
    language, ``term`` the terms most overused. Values descend by rank, equal ones ascend by item.

    Nulls count as ''; repeated rows count each; ids and other columns are not looked at; a language without kept terms
    has pairs of value 0; an empty table has no rows. A document of any length is cut a slice at a time.
    """
    kept = written(kept_counts(docs, least), "divergence-counts")
    groups = written(group_figures(docs, kept), "divergence-groups")
    pairs, terms = pair_part(kept, groups), term_part(kept, groups, top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = "1 + (1000000000 * ({} + 1)::HUGEINT) // ({} + {})"
OP13_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT t.lang, t.source, t.term, count(*) AS uses, any_value(k.total) AS total FROM t JOIN keep k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
g AS MATERIALIZED (SELECT s.lang, s.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(m, 0) AS m FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, source, sum(uses) AS n FROM c GROUP BY 1, 2) x USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS m FROM keep GROUP BY 1) y USING (lang)),
e AS MATERIALIZED (SELECT g.lang, g.source, k.term, {_P.format("coalesce(uses, 0)", "g.n", "g.v")} AS p FROM g JOIN keep k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM (SELECT c.lang, c.source, term, {_P.format("uses", "n", "v")} AS p, {_P.format("total", "m", "v")} AS q FROM c JOIN g ON g.lang = c.lang AND g.source = c.source) WHERE p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200"""
