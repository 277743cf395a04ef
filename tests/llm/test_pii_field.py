"""The semi-Markov field: its best labelling against all labellings, and what it finds of planted disguised forms."""

import random

import numpy as np

from tracewell.llm import pii


def labellings(table, at=0):
    """All sets of segments that do not overlap, as (segments with features) lists."""
    if at >= len(table):
        yield []
        return
    yield from labellings(table, at + 1)
    for end in range(at, len(table)):
        for i, f in table[end]:
            if i == at:
                for rest in labellings(table, end + 1):
                    yield [(i, end, f), *rest]


def test_best_is_the_best_of_all_labellings():
    rng = np.random.default_rng(2)
    texts = ["call 555 0100 or 7", "a (at) b (dot) com 12", "id 1234-5678 x@y z 9"]
    for text in texts:
        for run in pii.regions(text):
            table = pii.segments(text, run[:6])
            for _ in range(20):
                weights = rng.normal(size=(len(pii.KINDS), len(pii.FEATURES)))
                margin = float(rng.random())
                value = lambda found: sum(float((weights[:, f].sum(axis=1) - margin).max()) for _, _, f in found)
                most = max(map(value, labellings(table)))
                got = pii.best(table, weights, margin)
                features = {(i, j): f for j, here in enumerate(table) for i, f in here}
                assert abs(sum(float((weights[:, features[i, j]].sum(axis=1) - margin)[k]) for i, j, k in got) - most) < 1e-9
                assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


def document(rng):
    word = lambda: "".join(rng.choices("aeioustrnl", k=rng.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    mail = f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"
    phone = f"+1 {rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
    return f"{some(8)} {mail} {some(6)}\n{some(5)} {phone} {some(4)} {rng.randint(1, 2000)} {some(3)}"


def test_planted_disguised_forms_are_found():
    """Forms of held-out texts that the base patterns miss: at least 0.9 are found with their exact bounds, and at least
    0.9 of what is added is one of them; texts without any get nothing."""
    rng = random.Random(3)
    weights = pii.fit([document(rng) for _ in range(150)])
    planted = found = added = 0
    for _ in range(100):
        text = document(rng)
        hidden, spans = pii._disguised(text, pii.base_spans(text))
        own = set(spans) - set(pii.base_spans(hidden))
        got = set(pii.all_spans(hidden, weights)[1])
        planted, found, added = planted + len(own), found + len(own & got), added + len(got)
    assert planted >= 150 and found / planted >= 0.9 and found / added >= 0.9
    clean = [" ".join(f"w{rng.randint(1, 99)}" if rng.random() < 0.1 else "word" for _ in range(60)) for _ in range(50)]
    assert not any(pii.all_spans(t, weights)[1] for t in clean)
