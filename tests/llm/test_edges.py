"""Null and repeated ids, repeated rows, empty tables, and texts longer than any chunk at the usual settings."""

import random
from hashlib import sha256

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from tracewell.llm import bpe_coding, packing, pii, quality_rules, suffix_dedup, token_counts, toxicity, url_filters

SCHEMA = "doc_id bigint, text string, n_tokens string, score string"
MAIL = "write to bo@mail.example.com, 10.1.2.3 or 4111 1111 1111 1111"
ROWS = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "other words"), (None, None), (2, ""), (3, MAIL), (3, MAIL), (None, MAIL)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return sorted(map(str, rows))


def test_codes_and_counts(docs, empty):
    words, bytes_ = (Tokenizer.from_file(public_tokenizers.path(p)) for p in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    want = counted((d, len(words.encode(t or "", add_special_tokens=False).ids)) for d, t in ROWS)
    assert counted((r.doc_id, r.n_tokens) for r in bpe_coding.encode_decode(docs).collect()) == want
    want = counted((d, len((t or "").encode()), len(bytes_.encode(t or "", add_special_tokens=False).ids)) for d, t in ROWS)
    assert counted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect()) == want
    assert bpe_coding.encode_decode(empty).count() == token_counts.token_counts(empty).count() == 0


def test_personal_data(docs, empty):
    weights = pii.train(docs)
    got = counted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(docs, weights).collect())
    assert got == counted((d, *((1, 1, 1, 0) if t == MAIL else (0, 0, 0, 0))) for d, t in ROWS)
    assert pii.find(empty, pii.train(empty)).count() == pii.redact(empty, weights).count() == 0
    clean = pii.redact(docs, weights)
    assert clean.columns == docs.columns and clean.where("text like '%[EMAIL]%[IP]%[CARD]%'").count() == 3 and clean.where("text is null").count() == 1


def test_pieces(docs, empty):
    got = packing.pack(docs).toPandas()
    assert packing.pack(empty).count() == 0
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert got.length.sum() == sum(len(words.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == np.concatenate([[0], seq.length.cumsum()[:-1]])).all()


def test_quality(spark, docs, empty):
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")
    got = counted((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(docs, trusted).collect())
    assert got == counted((d, len((t or "").split()), True, False) for d, t in ROWS)
    assert quality_rules.quality_rules(empty, trusted).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1), (3, 1), (1, 0), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and len({round(r.score, 12) for r in got if r.doc_id == 3}) == 1
    assert toxicity.train(empty, labels) is None and toxicity.score(empty, model).count() == 0 and toxicity.train(docs, labels.limit(0)) is None


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/x"), (None, None), (2, "no url")], "page_id bigint, url string")
    got = counted(tuple(r)[:5] for r in url_filters.judge(pages, url_filters.listed_urls(pages)).collect())
    assert len(got) == 5 and sum("a.com" in g for g in got) == 3 and len(set(got)) == 4


def test_long_texts(spark):
    rng = random.Random(7)
    base = "".join(rng.choices("abcdefgh ", k=70_000))
    texts = [base, base[:200] + "x" * 70_000, "no-blank" * 9_000, base[5_000:30_000], "é한" * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got == {k: len(tokens.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: words.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {k: len(v) + 1 for k, v in ids.items()}
    codes = {r.doc_id: r.ids_sha256 for r in bpe_coding.encode_decode(docs, digests=True).collect()}
    assert codes == {k: sha256(" ".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}
    kept = {r[0]: tuple(r[1:5]) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert kept == brute.without_repeats(list(enumerate(texts)))
