"""Repeated rows, rows without ids and many languages: bounds that hold, and results that stay right."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import ngram_join, pii, quality_rules, suffix_dedup, toxicity, url_filters


def test_training_samples_are_bounded_by_ids(spark, monkeypatch):
    """20,000 rows of one id give one row to each sample."""
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 5)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 7)
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("scum trash mail me at a@b.example +1 555 0100 "), "id").alias("text"))
    rest = spark.range(2, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), "id").alias("text"))
    docs, labels = hot.unionByName(rest), spark.range(1, 40).select(F.col("id").alias("doc_id"), (F.col("id") < 20).cast("int").alias("toxic"))
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: seen.append((len(p), len(u))) or fit(p, u, prior))
    w, b = toxicity.train(docs, labels)
    assert seen == [(5, 7)] and len(w) == toxicity.FEATURES
    texts = []
    monkeypatch.setattr(pii, "fit", lambda t: texts.extend(t))
    pii.train(docs, most=3)
    assert len(texts) == 1 and "a@b.example" in texts[0]


def test_parts_of_texts_are_bounded():
    text = ("word " * 1000 + "call +1 555 0100 now " + "x" * 9000 + " ") * 200 + "\nshort 12 line\n\nno marks"
    parts = pii.marked_parts(text)
    assert len(parts) <= pii.PARTS * (2 * pii.PART_CHARS + 1) and "+1 555 0100" in parts
    assert pii.marked_parts("a\nmail x@y.z\nb\n7") == "mail x@y.z\n7" and pii.marked_parts("") == ""


def test_rows_without_ids_link_others(spark):
    a = [f"w{k}" for k in range(60)]
    m = a[:58] + ["m1", "m2"]
    c = a[2:58] + ["m1", "m2", "c1", "c2"]
    for ids, want in (((1, 2, 3), [1, 1, 1]), ((1, None, 3), [1, 1, 1]), ((None, None, None), [None] * 3), ((None, 2, None), [2, 2, 2])):
        docs = spark.createDataFrame(list(zip(ids, map(" ".join, (a, m, c)), strict=True)), "doc_id bigint, text string")
        got = [r.component_id for r in ngram_join.similar_groups(docs, 3, 85).collect()]
        assert got == want, ids


def test_a_third_without_ids_and_repeated_ids(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(50)]
        for _ in range(5):
            texts.append(" ".join(base))
            base = base.copy()
            base[rng.randrange(50)] = f"n{rng.randrange(9)}"
    texts += ["", None, "two words"] * 3
    ids = [None if k % 3 == 0 else k // 4 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id bigint, text string, k int").repartition(5)
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.similar_groups(docs, 3, 90).collect()), key=repr)

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = defaultdict(list)
    for x in range(len(texts)):
        least[find(x)].append(ids[x])
    want = sorted(((ids[x], min((i for i in least[find(x)] if i is not None), default=None)) for x in range(len(texts))), key=repr)
    assert got == want


@pytest.mark.parametrize("most", [0, suffix_dedup.MOST_CONTEXTS])
def test_ranges_do_not_grow_with_copies(spark, most):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh", k=900))
    sizes = []
    for m in (30, 60):
        rows = [(None, text)] * m + [(1, "zz" + text[100:700] + "yy"), (2, text[:450]), (3, text[300:]), (4, "q" * 250)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        keyed = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
        sizes.append(suffix_dedup.repeated_runs(keyed, 100, most).agg(F.max(F.size("runs")), F.sum(F.size("runs"))).first())
    assert sizes[0] == sizes[1]


def test_refinement_equals_brute_force(spark):
    """Every bucket is refined by tables until its strings are whole."""
    rng = random.Random(10)
    passage = "".join(rng.choices("abcd ", k=260))
    rows = [(k, "".join(rng.choices("abcd ", k=rng.randint(0, 150))) + passage[rng.randrange(60) :] + "".join(rng.choices("xyz", k=rng.randint(0, 90)))) for k in range(25)] + [(30, "e" * 400), (31, None), (32, "e" * 150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: suffix_dedup.removed_spans(r.runs, 100) for r in suffix_dedup.repeated_runs(keyed, 100, 0).collect()}
    seen, want = set(), {}
    for d, text in rows:
        raw = (text or "").encode()
        marks = [k for k in range(len(raw) - 99) if raw[k : k + 100] in seen or seen.add(raw[k : k + 100])]
        spans = suffix_dedup.removed_spans([{"a": k, "b": k + 1} for k in marks], 100)
        if spans:
            want[d] = spans
    assert got == want


def test_many_languages(spark):
    """A thousand languages, more than are broadcast; the weights of one are those it has alone."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 1000).cast("string")).alias("lang"), F.concat_ws(" ", F.lit("one two three"), (F.col("id") % 7).cast("string")).alias("text"))
    trusted = docs.where("doc_id < 1000").select("doc_id")
    table = quality_rules.weights(docs, trusted, buckets=64)
    assert table.count() == 1000 > quality_rules.BROADCAST_LANGS and table.where("size(_quality_weights) <> 64").count() == 0
    got = {r.doc_id: r.llr for r in quality_rules.quality_rules(docs, trusted, buckets=64).where("doc_id % 1000 = 7").collect()}
    alone = docs.where("lang = 'l7'")
    want = {r.doc_id: r.llr for r in quality_rules.quality_rules(alone, trusted, buckets=64).collect()}
    assert got == want and len(got) == 3


def test_of_equally_long_rules_the_first_counts(spark):
    rules = (("block", "com/ab/"), ("allow", "b.com/a"))
    for r, verdict in ((rules, "block"), (rules[::-1], "allow")):
        df = spark.createDataFrame([("b.com", "/ab/x")], "host string, path string")
        assert df.select(url_filters.rule_of(F.col("host"), F.col("path"), r).alias("x")).first().x.verdict == verdict
