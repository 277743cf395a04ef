"""Plain, slow versions of the operators, for small tables."""

import math
import re
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingle_set(text, width):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def groups(rows, width, percent):
    """rows: (doc_id, text) -> list of (doc_id, n, component)."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for k, s in enumerate(sets):
        for x in s:
            seen.setdefault(x, []).append(k)
    pairs = {(a, b) for places in seen.values() for i, a in enumerate(places) for b in places[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(d, least.get(find(k), d))
    return [(d, len(sets[k]), least[find(k)]) for k, (d, _) in enumerate(rows)]


def without_repeats(rows, length=100):
    """rows: (doc_id, text), ids distinct -> {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen[s] = True
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(raw), sum(gone), spans, sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for t in triples:
        count[t] = count.get(t, 0) + 1
    marked = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n)


def quality_scores(rows, trusted, prior, buckets):
    """Mean log ratio of each of ``rows`` (id, text, language), one language after the other."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long = lambda v, seed: xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
    word = lru_cache(None)(lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42)))
    pair = lru_cache(None)(lambda a, b: signed(long(b, long(a, 42))))
    out = {}
    for lang in {x for _, _, x in rows}:
        grams = {}
        for d, text, x in rows:
            if x == lang:
                h = [word(w) for w in WORD.findall(text or "")]
                grams[d] = [g % buckets for g in h + [pair(a, b) for a, b in zip(h, h[1:])]]
        n, t = Counter(), Counter()
        for d, g in grams.items():
            n.update(g)
            t.update(g if d in trusted else ())
        a, b = n.total(), t.total()
        ratio = {g: math.log((t[g] + prior * c / a) / (b + prior) / (c / a)) for g, c in n.items()}
        out |= {d: sum(ratio[x] for x in g) / max(1, len(g)) for d, g in grams.items()}
    return out


def base_pii(text):
    """By the contract's patterns, one by one."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out
