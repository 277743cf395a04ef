import random
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import brute
from tracewell.llm import bpe_coding, ngram_join, packing, pii, quality_rules, suffix_dedup, token_counts, url_filters

WORDS = "the of and ingle tion herea onan sht blere whor".split()


def sentence(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 2))) for _ in range(n))


ODD = [
    None, "", "   ", "a", "A b", "it's 'tis we'll\x1cx", "İstanbul ΑΣ. é\u0301 <|endoftext|>x<|startoftext|>", "12½ ２３ \xa0 z 한국 '''s !'re", "x" * 700,
    " a  b\n\n c\t\td   \n e \u3000f", "tab\x0bvt\x0cff", "😀 emoji 👍🏽",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(60)]
    for k in range(25):
        base = texts[k].split()
        base[rng.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
    passage = sentence(rng, 40)
    texts += [f"{sentence(rng, 30)}\n{passage} {sentence(rng, 20)}" for _ in range(12)] + texts[:8] + [texts[3]] * 5 + [sentence(rng, 3000)]
    return [(k, t) for k, t in enumerate(texts + ODD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", -1) for d, t in rows], "doc_id bigint, text string, n_tokens string, cls int").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def nameless(spark):
    return spark.createDataFrame([(None, "a b c"), (None, None), (1, "a b c"), (1, "a b c"), (1, "x y z w"), (None, "q" * 300), (2, "q" * 300)], "doc_id bigint, text string")


def test_bpe_equals_the_library(docs, rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe_coding.encode_decode(docs).collect()}
    short = {r.doc_id: r for r in bpe_coding.encode_decode(docs, digests=True).collect()}
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded == t.decode(ids, skip_special_tokens=False)
        assert short[d].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[d].decoded_sha256 == sha256(got[d].decoded.encode()).hexdigest()


def test_token_counts_equal_the_library_at_any_chunk(docs, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows}
    for chunk in (1, 5, 65536):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, chunk=chunk).collect()}
        assert got == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in token_counts.token_counts(docs).collect())


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_groups_equal_brute_force(docs, rows, width, percent):
    got = {tuple(r) for r in ngram_join.similar_groups(docs, width, percent).collect()}
    assert got == set(brute.groups(rows, width, percent))


def test_groups_of_many_near_copies(spark):
    rng = random.Random(5)
    base = sentence(rng, 60).split()
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(1000)}"
        rows.append((k, " ".join(own)))
    got = {tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == set(brute.groups(rows, 3, 90))


def test_groups_without_ids_and_of_nothing(nameless, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(nameless, 3, 90).collect()), key=str)
    assert got == sorted([(None, 1, 1), (None, 0, None), (1, 1, 1), (1, 1, 1), (1, 2, 1), (None, 1, 2), (2, 1, 2)], key=str)
    assert ngram_join.similar_groups(empty).count() == 0


@pytest.mark.parametrize(("most", "hot"), [(5000, 1000), (1, 1000), (5000, 1e9)])
def test_repeats_equal_brute_force(docs, rows, most, hot, monkeypatch):
    """Also where every bucket is refined to the end before it is sorted, and where every key counts as hot."""
    monkeypatch.setattr(suffix_dedup.repeated_runs, "__defaults__", (most,))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute.without_repeats(rows)


def test_repeats_without_ids_and_of_nothing(nameless, empty):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(nameless).collect() if r.n_bytes == 300]
    assert sorted(got, key=str) == [(2, 300, 299), (None, 300, 300)]
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.without_repeats(nameless).where("text is null").count() == 1


def test_rows_of_one_id_have_marks_of_their_own(spark):
    rng = random.Random(8)
    passage = sentence(rng, 40)
    texts = [f"{sentence(rng, k)} {passage}" for k in (5, 9, 13)]
    docs = spark.createDataFrame([(d, t) for t in texts for d in (None, 7)][1:], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    size = len(passage)
    assert len(got) == 5 and all(got[None, len(t)] == len(t) for t in texts[1:])
    assert got[7, len(texts[0])] < got[7, len(texts[1])] <= size + 3 and size <= got[7, len(texts[2])] <= size + 3


def test_quality_counts_equal_brute_force(docs, rows, spark, empty):
    trusted = spark.createDataFrame([(k,) for k in range(40)] + [(None,)], "doc_id bigint")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, trusted).collect()}
    for d, text in rows:
        assert tuple(got[d])[1:7] == brute.quality(text), text
        assert got[d].kept is False or not got[d].base_failed
    assert quality_rules.quality_rules(empty, trusted).count() == 0


def test_quality_ratio_equals_brute_force(spark):
    import math

    rows = [(k, f"good words here {k % 3} " * 20) for k in range(6)] + [(k, "bad $$$ stuff ||| " * 20) for k in range(6, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    trusted = spark.createDataFrame([(k,) for k in range(5)], "doc_id bigint")
    h = {r.w: r.h for r in docs.select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    pair = {(r.a, r.b): r.h for r in spark.createDataFrame([(x, y) for x in h.values() for y in h.values()], "a bigint, b bigint").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}

    def grams(text):
        w = [h[x] for x in text.split()]
        return [x % 64 for x in w] + [pair[a, b] % 64 for a, b in zip(w, w[1:])]

    n, t = [0] * 64, [0] * 64
    for d, text in rows:
        for g in grams(text):
            n[g] += 1
            t[g] += d < 5
    prior = quality_rules.PRIOR
    ratio = [math.log((y + prior * x / sum(n)) / (sum(t) + prior) / (x / sum(n))) if x else 0 for x, y in zip(n, t)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, trusted, buckets=64).collect()}
    for d, text in rows:
        g = grams(text)
        assert got[d].llr == pytest.approx(sum(ratio[x] for x in g) / len(g), abs=1e-8)
    assert got[0].llr > 0 > got[9].llr


def test_clean_texts_of_a_language_that_is_trusted_less_are_kept(spark):
    rng = random.Random(5)
    rows, clean, trusted = [], set(), set()
    # texts that are good, of these trusted, and junk
    for lang, good, known, bad in (("en", 200, 160, 30), ("de", 200, 80, 30), (None, 60, 40, 10), ("fi", 20, 0, 20)):
        for k in range(good + bad):
            d = len(rows)
            rows.append((d, " ".join(f"{lang}{'junk' * (k >= good)}{rng.randrange(40)}" for _ in range(400)), lang))
            clean |= {d} if k < good else set()
            trusted |= {d} if k < known else set()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame([(d,) for d in trusted], "doc_id bigint")).collect()}
    want = brute.quality_scores(rows, trusted, quality_rules.PRIOR, quality_rules.BUCKETS)
    assert all(got[d].llr == pytest.approx(want[d], abs=1e-8) for d, _, _ in rows)
    assert {d for d, _, lang in rows if got[d].kept} == clean | {d for d, _, lang in rows if lang == "fi"}
    assert {got[d].llr for d, _, lang in rows if lang == "fi"} == {0.0}


def test_scores_reject_only_beyond_the_prior(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(f"{'junk' * (k >= 40)}w{rng.randrange(40)}" for _ in range(400)), "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    # 799 n-grams a text: below and above 8,328 trusted ones
    for known, rejected in ((range(10), set()), (range(30), set(range(40, 60)))):
        got = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame([(k,) for k in known], "doc_id bigint")).collect()}
        want = brute.quality_scores(rows, set(known), quality_rules.PRIOR, quality_rules.BUCKETS)
        assert all(got[d].llr == pytest.approx(want[d], abs=1e-8) for d, _, _ in rows)
        assert {d for d in got if not got[d].kept} == {d for d in got if want[d] < quality_rules.THRESHOLD} == rejected
        assert not any(r.base_failed for r in got.values())


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    cases = ["".join(rng.choices("ab1.2@9+- ()4", k=rng.randint(1, 60))) for _ in range(3000)] + ["4111 1111 1111 1111, +1 (428) 555-5743 x.y@z.example.com 10.0.0.256 1.2.3.4.5.6.7.8", "a" * 5000 + "@", "1" * 5000]
    order = pii._order
    for text in cases:
        assert sorted(pii.base_spans(text), key=order) == sorted(brute.base_pii(text), key=order), text


def test_field_adds_disguised_spans_and_leaves_plain_numbers(spark, docs):
    rows = [(k, f"the of and {k} call +1 ({k + 200}) 555-{k + 1000} or mail x{k}@mail.example.com now {k}.2.3.4 and 4111111111111111") for k in range(60)]
    weights = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert pii.all_spans("call (428) 555-5743 now", weights) == ([], [("phone", 5, 19)])
    assert pii.all_spans("in 1999-2000 and 12345 of 678.901, 2024-01-15", weights) == ([], [])
    assert pii.redacted("mail a@b.example.com, +1 428 555 5743", weights) == "mail [EMAIL], [PHONE]"
    got = {r.doc_id: r for r in pii.find(docs, weights).collect()}
    assert len(got) == docs.count() and all(r.spans == ",".join(f"{f.kind}:{f.start}:{f.end}" for f in r.found) for r in got.values())


def test_field_sums_over_all_segmentations():
    rng = np.random.default_rng(0)
    text = "x 12-34 5 @ 77"
    run = next(pii.regions(text))
    table = pii.segments(text, run)
    w = rng.normal(size=(len(pii.KINDS), len(pii.FEATURES)))
    gold = {(table[-1][0][0], len(table) - 1, 1)}
    value, grad = pii.gradient(table, gold, w)
    near = np.zeros_like(w)
    for k in np.ndindex(*w.shape):
        step = np.zeros_like(w)
        step[k] = 1e-5
        near[k] = (pii.gradient(table, gold, w + step)[0] - pii.gradient(table, gold, w - step)[0]) / 2e-5
    assert np.allclose(grad, near, atol=1e-5)


def test_packing_keeps_every_id_once(docs, rows, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs, size=64, with_ids=True).toPandas()
    for d, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist()
        assert ids == t.encode(rows[d][1] or "", add_special_tokens=False).ids + [1]
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and (own.doc_tokens == len(ids)).all()
    assert set(got.doc_id) == {d for d, _ in rows}
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
        assert own.length.sum() in (1, 2, 4, 8, 16, 32, 64)
    assert packing.pack(empty).count() == 0


def test_hilbert_keys_are_a_curve():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_url_rules_and_list(spark):
    urls = ["https://WWW.Example.com/en/1?x#y", "http://a.example.com/en/2", "https://b.example.net/es/3", "x.net/fr/", None, "", "http://spam.org/a/?utm_x=1&b=2&a=1#f", "ftp://www.spam.org/a?a=1&b=2", "http://notexample.com/en/", "http://com", "http://com/", "a://b://c/d", "http://h?q://z/", "http://spam.org/other"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(None, "http://spam.org/a?a=1&b=2", "")], "page_id bigint, url string, host string")
    listed = spark.createDataFrame([("spam.org/a?a=1&b=2",), (None,), ("",)], "url string")
    got = {r.page_id: tuple(r)[1:5] for r in url_filters.judge(pages, listed).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[2] == ("b.example.net", "/es/3", "net/es/", "block")
    assert got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == got[7][2:] == got[None][2:] == (None, "block")
    assert got[8] == ("notexample.com", "/en/", "com/", "allow")
    assert got[9] == ("com", "", None, "allow") and got[10] == ("com", "/", "com/", "allow")
    assert got[11] == ("b:", "//c/d", None, "allow") and got[12] == ("h", "", None, "allow") and got[13][3] == "allow"
    table = pages.where("page_id is not null").select("page_id", "url").toPandas()
    con = duckdb.connect()
    con.register("pages", table)
    want = {r[0]: r[1:] for r in con.execute(url_filters.OP1_SQL).fetchall()}
    again = {r.page_id: tuple(r)[1:] for r in url_filters.judge(pages.where("page_id is not null"), url_filters.listed_urls(pages)).collect()}
    assert again == want


def test_url_filter_beyond_the_broadcast(spark, monkeypatch):
    urls = [f"http://h{k % 7}.org/{k}" for k in range(60)] + [None, "x"] * 20
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    listed = spark.createDataFrame([(f"h{k % 7}.org/{k}",) for k in range(0, 90, 3)], "url string")
    want = sorted(map(tuple, url_filters.judge(pages, listed).collect()))
    monkeypatch.setattr(url_filters, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, url_filters.judge(pages, listed).collect())) == want
    assert [r[0] for r in want if r[5]] == list(range(0, 60, 3))


def test_url_filter_without_list_or_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filters.judge(none, none.select("url")).count() == 0
    assert isinstance(url_filters.judge(none, none.select("url")).schema, T.StructType)


def test_pairs_of_near_copies_grow_with_the_rows(spark, monkeypatch):
    """Groups of near copies of one text, most of them too far changed to be alike: twice the rows, about twice the pairs."""
    rng = random.Random(8)
    base = sentence(rng, 200).split()
    counted = []
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest, was=ngram_join.verified: (counted.append(pairs.count()), was(pairs, *rest))[1])
    total = {}
    for m in (100, 200):
        rows = []
        for k in range(m):
            own = list(base)
            for place in rng.sample(range(len(own)), k % 8):
                own[place] = f"w{rng.randrange(10**6)}"
            rows.append((k, " ".join(own)))
        got = {tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()}
        assert got == set(brute.groups(rows, 5, 80))
        total[m] = sum(counted)
        counted.clear()
    assert total[200] <= 3 * total[100] and total[200] < 200 * 20


def test_word_hashes_stand_for_words():
    import pyarrow as pa

    from tracewell.llm import common

    rng = random.Random(1)
    texts = [None, "", "  ", "a", "A b", "x" * 5000, "y" * 3000 + " z" * 3000] + ["".join(rng.choices("ab C\n\té한", k=rng.randint(0, 60))) for _ in range(500)]
    known = {}
    for width in (1, 3, 5):
        for text, found in zip(texts[1:], common.shingle_sets(pa.array(texts).slice(1), width), strict=True):
            want = brute.shingle_set(text, width)
            assert len(want) == len(found) and (found[1:] > found[:-1]).all()
            assert known.setdefault((width, frozenset(found.tolist())), want) == want


def test_long_texts_are_hashed_in_slices(monkeypatch):
    import pyarrow as pa

    from tracewell.llm import common

    text = pa.array(["one two three four five six", "x" * 50 + " three four five six"])
    want = [x.tolist() for x in common.shingle_sets(text, 3)]
    for size in (7, 16):
        monkeypatch.setattr(common, "SLICE", size)
        common._powers.cache_clear()
        assert [x.tolist() for x in common.shingle_sets(text, 3)] == want
    common._powers.cache_clear()


def test_batches_of_words_equal_the_library(monkeypatch):
    import pyarrow as pa

    from tracewell.llm import bpe, common

    rng = random.Random(4)
    letters = "abcßéÀΣσς한글ñ'’.,-–!?<|>0123½²  \t\n\xa0　\x1ćİ"
    texts = [None, "", "ΣΑΣ ΟΔΟΣ", "x" * 5000, "aaa" * 40, "it's we'll 'S <|endoftext|>a<|endoftext|> <|start"] + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(400)] + [sentence(rng, 300)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    coder = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for limit, size in ((800_000, 1 << 20), (3, 200)):
        monkeypatch.setattr(bpe.WordTable, "limit", limit)
        monkeypatch.setattr(common, "SLICE", size)
        common._powers.cache_clear()
        table = bpe.IdTable(coder)
        for _ in range(2):
            assert [x.tolist() for x in table.texts(pa.array(texts))] == want
    common._powers.cache_clear()
    assert [coder.text(x or "") for x in texts] == want
