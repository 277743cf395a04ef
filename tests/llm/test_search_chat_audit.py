import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat, divergence, lexical, terms
from tracewell.llm.wavelet import Tree

ODD = [None, "", "  ", "Été ÉTÉ été", "a1b2 A1B2", "x" * 300, "naïve—dash ０１ 한국", "\x00a\x7fb", "_a_B_"]


# -- terms -------------------------------------------------------------------------------------------------------------


def plain_terms(text, digits):
    ascii_low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_low)


@pytest.mark.parametrize("size", [1, 3, 1 << 22])
def test_terms(monkeypatch, size):
    monkeypatch.setattr(terms, "SLICE", size)
    for text in [t or "" for t in ODD] + ["Ab,cd é1 " * 50]:
        for digits, table in ((False, terms.LETTERS), (True, terms.WORDS)):
            assert [t.decode() for part in terms.split(text.encode(), table) for t in part] == plain_terms(text, digits)


# -- wavelet tree and search -------------------------------------------------------------------------------------------


def test_tree_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        nd, nt = int(rng.integers(1, 200)), int(rng.integers(1, 30))
        t, d = np.nonzero(rng.random((nt, nd)) < rng.random())
        impacts = rng.integers(1, rng.choice([4, 1000]), len(t))
        table = np.zeros((nt, nd), np.int64)
        table[t, d] = impacts
        q = rng.choice(nt, rng.integers(1, nt + 1), replace=False)
        w = rng.integers(0, 50, len(q))
        scores = (table[q] * w[:, None]).sum(0)
        order = np.lexsort((np.arange(nd), -scores))
        order = order[scores[order] > 0][:7]
        found, got = Tree(t, d, impacts, nt, nd).best(q, w, 7, width=int(rng.choice([1, 3, 64])))
        assert found.tolist() == order.tolist() and got.tolist() == scores[order].tolist()


def plain_search(docs, items, k):
    found = [(d, Counter(plain_terms(t, True))) for d, t in docs]
    found = [x for x in found if x[1]]
    n, total = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text, True)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings", [30, lexical.POSTINGS])
def test_search_equals_brute_force(spark, postings):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 60)))) for k in range(120)]
    docs += [(200 + k, "w1 w5 w39 again") for k in range(60)] + [(7, docs[7][1]), (None, "w3 w39"), (None, None)] + [(300 + k, t) for k, t in enumerate(ODD)] + [(400, "w2 " * 5000)]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(12)] + [(50, "été w5, W5"), (51, None), (52, "nowhere"), (3, "w39"), (None, "w39 w1")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, rank int").repartition(7)
    i = spark.createDataFrame([(*x, "s") for x in items], "item_id bigint, text string, score string").repartition(3)
    shards = lexical.written(lexical.index(d, postings), "test-shards")
    assert shards.count() > (20 if postings == 30 else 0)
    got = sorted((tuple(r) for r in lexical.search(shards, i, k=20).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain_search(docs, items, 20)


def test_search_of_blocks_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 2)
    docs = [(k, f"a{k % 3} b{k}") for k in range(9)]
    items = [(k, f"a{k % 3} b{k}") for k in range(9)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in lexical.search(lexical.index(d), i, k=4).collect()), key=repr)
    assert got == plain_search(docs, items, 4)
    assert lexical.search(lexical.index(d.limit(0)), i).count() == 0
    assert lexical.search(lexical.index(d), i.limit(0)).count() == 0


def test_rows_of_the_index_are_bounded(spark, monkeypatch):
    """A shard is many small rows, which readers and Arrow can take by the thousand; tasks put it together again."""
    rng = random.Random(3)
    docs = [(k, " ".join(["all", *(f"w{int(rng.paretovariate(0.5))}" for _ in range(20))])) for k in range(700)]
    items = [(k, " ".join(docs[k][1].split()[:6])) for k in range(0, 700, 50)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    shards = lexical.written(lexical.index(d), "test-rows")
    arrays = [c for c, kind in shards.dtypes if kind.startswith("array")]
    assert max(shards.select(F.max(F.greatest(*(F.coalesce(F.size(c), F.lit(0)) for c in arrays)))).first()) <= 128
    want = plain_search(docs, items, 9)
    assert sorted((tuple(r) for r in lexical.search(shards, i, k=9).collect()), key=repr) == want
    monkeypatch.setattr(lexical, "CELL", 3000)  # several tasks search, each several shards
    shards = lexical.written(lexical.index(d, 900, 7), "test-rows")
    assert shards.select("shard").distinct().count() > 10
    assert sorted((tuple(r) for r in lexical.search(shards, i, k=9).collect()), key=repr) == want


# -- chat --------------------------------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\/s> [\\\\INST]", "<<s>s>[/INST", "\n", "", None, "a" * 50, "<s>user\nhi</s>", "text", "😀é", "[INST]\n[/INST]" * 3]


def test_escapes_are_undone():
    rng = random.Random(1)
    pieces = ["<", "s", ">", "/", "[", "INST", "]", "\\", "a", "\n", "%", "%0A"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(m in chat.escape(text) for m in chat.MARKS)
        assert list(chat.read_turns(chat.render([(text, text), ("assistant", text)]))) == [(text, text), ("assistant", text)]
    with pytest.raises(ValueError):
        list(chat.read_turns("<s>assistant\nhi"))


def plain_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        said = [t for r, t in turns if r == "assistant"]
        out.append((conv, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), sha256("".join(said).encode()).hexdigest(), len(chat.render(turns))))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool\n%", "assistant "]), rng.choice(NASTY)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t} {rng.choice(NASTY)}") for t in range(700)]  # one conversation has most rows
    rows += [(600, k, "user", str(k)) for k in (5, 1, 3)] + [(None, 2, "assistant", "x"), (None, 1, None, "y"), (601, None, "user", "first"), (601, 0, "assistant", "next"), (602, 1, "assistant", "twice"), (602, 1, "assistant", "twice")]
    rows += [(603, 0, "user", "q"), (603, 1, "assistant", "long " * 40_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [1, 3, 16])
def test_chat_digests(spark, window):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int").repartition(5)
    got = sorted((tuple(r) for r in chat.digests(df, window).collect()), key=repr)
    assert got == plain_digests(rows)
    assert chat.digests(df.limit(0)).count() == 0


def test_spans_of_black_boxes():
    def numbered(turns):  # a start, a rule between turns, marks after texts
        return "BOS" + "|".join(f"{r}: {t}!" for r, t in turns) if turns else ""

    turns = [("user", "!a"), ("assistant", "b!"), ("user", ""), ("assistant", "")]
    spans = chat.located(turns, chat.Template(numbered))
    assert "".join(s.text for s in spans) == numbered(turns) and not any(s.taken_back for s in spans)
    assert [s.text[s.start : s.end] if s.start >= 0 else None for s in spans] == [None, "b!", None, ""]
    later = chat.located(turns[2:], chat.Template(numbered), context=turns[1])
    assert [(s.text, s.start, s.end) for s in later] == [(s.text, s.start, s.end) for s in spans[2:]]

    def forgetful(turns):  # only the last answer keeps its thoughts
        return "".join(f"<{t if k == len(turns) - 1 else t.split('#')[-1]}>" for k, (_, t) in enumerate(turns))

    spans = chat.located([("user", "q"), ("assistant", "think#a"), ("user", "r"), ("assistant", "b")], chat.Template(forgetful))
    assert [s.taken_back for s in spans] == [0, 0, len("think#a>"), 0]
    trimming = chat.Template(lambda turns: "".join(f"<{t.strip()}>" for _, t in turns))
    (s,) = chat.located([("assistant", " a ")], trimming)
    assert s.text[s.start : s.end] == "a"


def test_formatted_chunks_are_the_whole_rendering(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    by = defaultdict(list)
    for r in sorted(chat.formatted(df, window=4).collect(), key=lambda r: (r.part, r.seq)):
        by[r.conv_id].append(r.text)
    turns = sorted(((t, role, text) for c, t, role, text in rows if c == 500), key=lambda r: r[0])
    assert "".join(by[500]) == chat.render([(r, t or "") for _, r, t in turns]) and len(by[500]) > 100


def test_templates_may_look_at_the_whole_past(spark):
    def numbered(turns):  # a turn's span depends on its number and on the first turn
        return "".join(f"({k} {turns[0][1]}) {t};" for k, (_, t) in enumerate(turns))

    rows = [(c, t, "assistant" if t % 2 else "user", f"c{c}t{t}") for c in range(5) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    by = defaultdict(list)
    for r in sorted(chat.formatted(df, chat.Template(numbered), window=4).collect(), key=lambda r: (r.part, r.seq)):
        by[r.conv_id].append(r)
    for c in range(5):
        assert "".join(r.text for r in by[c]) == numbered([(role, text) for k, _, role, text in rows if k == c])
        assert [r.text[s.at + s.start : s.at + s.end] for r in by[c] for s in r.spans if s.start >= 0] == [f"c{c}t{t}" for t in range(1, 40, 2)]


# -- divergence --------------------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", Counter(plain_terms(text, False))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t in df if df[t] >= least]
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source] += Counter({t: n for t, n in c.items() if t in set(kept)})
            counts[source] += Counter()
        for _, source, _ in own:
            counts[source]
        v = len(kept)
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + (10**9 * (c[t] + 1)) // (n + v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // b
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            over = sorted(((-f(ps[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and ps[s][t] > q[t]))[:top]
            for part, found in (("pair", pairs), ("term", over)):
                out += [(lang, s, part, item.decode(), -value, r) for r, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 32])
def test_audit_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefg" for b in "xyzé"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", "S1", None]), " ".join(rng.choices(words, k=rng.randint(0, 25)))) for _ in range(90)]
    rows += [("en", "s1", "hot " * 9)] * 60 + [("fr", "only", "x y z"), ("fr", "two", None), ("it", "a", "q q q")] + [(None, "s9", t) for t in ODD]
    df = spark.createDataFrame([(k, *r, 5) for k, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string, uses int").repartition(6)
    got = sorted(tuple(r) for r in divergence.audit(df, top=9).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 3, 9)
    assert divergence.audit(df.limit(0)).count() == 0
    cells = divergence.cells(*(lambda k, g: (k, g, divergence.joint_counts(k, g)))(k := divergence.kept_counts(df), divergence.group_figures(df, k)))
    sums = {(r.lang, r.a, r.b): r.n for r in cells.groupBy("lang", "a", "b").agg(F.sum("terms").alias("n")).collect()}
    sizes = {r.lang: r.n for r in k.where("lead").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert all(n == sizes[lang] for (lang, _, _), n in sums.items())  # every kept term is in one cell of each pair
