import random

import brute
import corpus_pipeline
from tracewell.llm import pii, quality_rules
from test_text_ops import sentence


def test_stages_equal_their_plain_versions(spark, tmp_path):
    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(60, 150)) for _ in range(30)]
    texts += [" ".join([*texts[k].split()[:-1], "changed"]) for k in range(6)] + [texts[7]] * 4
    passage = sentence(rng, 45)
    texts += [f"{sentence(rng, 70)} {passage} {sentence(rng, 60)}" for _ in range(5)]
    texts += ["ring " * 80, "few words", None, "", f"{sentence(rng, 80)} mail bo@mail.example.com or 10.1.2.3"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = quality_rules.quality_rules(docs, quality_rules.trusted_ids(spark, str(tmp_path)))
    keep = {r.doc_id for r in judged.collect() if not brute.quality(texts[r.doc_id])[5] and r.llr >= quality_rules.THRESHOLD}
    assert keep >= set(range(30))
    left = [(d, texts[d]) for d in sorted(keep)]
    left = [(d, t) for (d, t), (_, _, c) in zip(left, brute.groups(left, 5, 80)) if d == c]
    want, seen = {}, set()
    for d, t in left:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        want[d] = bytes(b for b, g in zip(raw, gone) if not g).decode()

    d = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        d = spark.read.parquet(f"{tmp_path}/stage{k}")
    got = {r.doc_id: r.text for r in d.collect()}
    assert got == want and sum(map(len, got.values())) < sum(len(t) for _, t in left)
    weights = pii.train(d)
    clean = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, d, str(tmp_path)).collect()}
    assert {k: r.text for k, r in clean.items()} == {k: pii.redacted(t, weights) for k, t in want.items()}
    assert all(r.n_chars == len(r.text) for r in clean.values()) and "[EMAIL]" in clean[len(texts) - 1].text
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(want) and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_rows_without_ids_and_repeated_rows(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "other " + text[::-1]), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, (r.text or "")[:5]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "word0"), (None, "other"), (3, "")], key=str)


def test_rows_without_ids_go_only_with_an_equal_set(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (None, text), (None, "other words that stand for themselves here"), (None, None), (2, text + " eight")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, text), (None, "other words that stand for themselves here"), (None, None), (2, text + " eight")], key=str)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    docs = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (4, texts[1] + " end"), (None, texts[2]), (None, texts[2]), (None, texts[2] + " end"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, (r.text or "")[:1]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, "a"), (4, "b"), (None, "c"), (None, "")], key=str)


def test_stages_of_nothing_and_of_extra_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, cls int, start string, _key int"
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(70)), None, None, None, "h", 1, "s", 2) for k in range(3)]
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for d, n in ((spark.createDataFrame([], schema), 0), (spark.createDataFrame([*rows, rows[0]], schema), 3)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == [c.split()[0] for c in schema.split(", ")]
            d.write.parquet(f"{tmp_path}/{n}-{name}")
            d = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert d.count() == n and corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).select("doc_id").distinct().count() == n
