"""Personal data in texts: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole segments: a segment of up to MAX_WORDS words gets a weight for each feature of the span as a
whole (its shape, digit count, check sum, what stands before it) under each kind, and dynamic programming over a region
chooses boundaries and kinds together; words outside a segment score 0. Regions are runs of words around digits and
``@``, so that texts without either cost one scan. Weights are trained by gradient on the segment likelihood of a bounded
sample: lines whose spans the base patterns mark, as they are and rewritten in forms that the patterns miss.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_WORDS = 8
#: Bound of the training sample, in documents.
MAX_TRAIN = 400
#: Most regions of them that are used.
MAX_REGIONS = 1500
#: Parts of a document, and characters of a part, that come to the driver.
PARTS, PART_CHARS = 64, 2000
#: Lines with numbers that are no personal data, learnt beside the sample.
DECOYS = (
    "1999-2000 12345", "on 2024-01-15 10:30 to 11:45", "10-20 30-40 50-60", "version 1.2.3.4.5", "no. 12345678", "0123456789", "id 1234567890123456",
    "3.1415926535", "pages 100-200, 300-400", "1 000 000 000", "2001 2002 2003 2004", "ISBN 978-3-16-148410-0", "deadbeef0123456789abcdef", "$1.234.567,89", "12:34:56.789012",
)
#: A span is added where its segment's weight is above that of leaving the words alone by this much.
MARGIN = 1.0

_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check sum of a row of digits is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards, so that long runs cost no more than their length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in re.finditer("[0-9]+", m.group())]
        for k in range(0, len(parts) - 3, 4):
            if all(len(v.lstrip("0")) <= 3 and int(v.lstrip("0") or 0) <= 255 for _, _, v in parts[k : k + 4]):
                out.append(("ip", parts[k][0], parts[k + 3][1]))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- the semi-Markov field ---------------------------------------------------------------------------------------------

_WORDS = re.compile(r"[^\s]+")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]", re.IGNORECASE)
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:!?|", "\"'>]},;:!?.|"
FEATURES = (
    "bias", "extra word", "digits 7-9", "digits 10-15", "digits 16-19", "digits other", "only digits and separators", "groups 3-3-4", "leading +", "parenthesis first",
    "separator dashes", "separator dots", "separator blanks", "no separator", "check sum", "four parts to 255", "four parts", "one @ with dotted end", "says at and dot", "@ else", "letters among digits", "long hex",
)
_AT_DOT = re.compile(r"[\w.%+-]+\s?[(\[{]\s?at\s?[)\]}]\s?[\w-]+(?:\s?[(\[{]\s?dot\s?[)\]}]\s?[\w-]+)+", re.IGNORECASE)
_FULL_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SHAPE = re.compile(r"[0-9\x20().+-]+")


def features(span: str, words: int) -> list[int]:
    """Numbers of the features that hold for a span as a whole."""
    digits = re.sub("[^0-9]", "", span)
    n, only = len(digits), bool(_SHAPE.fullmatch(span))
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    out = [0, *[1] * (words - 1), 2 if 7 <= n <= 9 else 3 if 10 <= n <= 15 else 4 if 16 <= n <= 19 else 5]
    parts = span.split(".")
    holds = (
        (6, only), (7, only and groups[-3:] == [3, 3, 4] and len(groups) <= 4), (8, span[:1] == "+"), (9, span[:1] == "(" and only), (10, only and "-" in span),
        (11, only and "." in span), (12, only and " " in span), (13, span.isdigit()), (14, only and 16 <= n <= 19 and luhn(digits)),
        (15, len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)), (16, len(parts) == 4 and all(p.isdigit() for p in parts)),
        (17, bool(_FULL_MAIL.fullmatch(span))), (18, bool(_AT_DOT.fullmatch(span))), (19, "@" in span and not _FULL_MAIL.fullmatch(span)),
        (20, n > 0 and any(c.isalpha() for c in span)), (21, len(span) > 19 and bool(re.fullmatch("[0-9a-f]+", span))),
    )
    out += [k for k, yes in holds if yes]
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words (start, end; punctuation at the ends trimmed) around digits and @; nothing between them can be a segment.
    A run never crosses a line end, and takes in words next to a trigger that join parts of one address."""
    at = 0
    while m := _TRIGGER.search(text, at):
        first = max(at, m.start() - 160)
        first = max(first, text.rfind("\n", first, m.start()) + 1)
        run: list[tuple[int, int]] = []
        last, before = m.start(), m.start()
        for w in _WORDS.finditer(text, first):
            if w.start() > last + 60 or w.start() > before and "\n" in text[before : w.start()]:
                break
            before = max(before, w.end())
            if w.end() <= m.start() - 40 and not _DIGIT.search(w.group()):
                continue
            if _TRIGGER.search(w.group()):
                last = max(last, w.end())
            a, b = w.span()
            while a < b and text[a] in _TRIM_LEFT:
                a += 1
            while b > a and text[b - 1] in _TRIM_RIGHT:
                b -= 1
            if a < b:
                run.append((a, b))
        if run:
            yield run
        at = max(m.end(), run[-1][1] if run else 0)


def segments(text: str, run: list[tuple[int, int]]) -> list[list[tuple[int, list[int]]]]:
    """For each end, the segments (first word, features) that can be one: they hold a digit or @, and no more than MAX_WORDS."""
    out = []
    for j in range(len(run)):
        here = []
        for i in range(max(0, j - MAX_WORDS + 1), j + 1):
            span = text[run[i][0] : run[j][1]]
            if len(span) <= 120 and _TRIGGER.search(span):
                here.append((i, features(span, j - i + 1)))
        out.append(here)
    return out


def best(table: list, weights: np.ndarray, margin: float) -> list[tuple[int, int, int]]:
    """Segments (first word, last word, kind) of the labelling of largest weight."""
    score, back = [0.0], []
    for j, here in enumerate(table):
        top, how = score[j], None
        for i, f in here:
            each = weights[:, f].sum(axis=1) - margin
            k = int(each.argmax())
            if score[i] + each[k] > top:
                top, how = score[i] + each[k], (i, j, k)
        score.append(top)
        back.append(how)
    out, j = [], len(table) - 1
    while j >= 0:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j])
            j = back[j][0] - 1
    return out[::-1]


class Sample:
    """Regions with their gold segments, laid out so that one step of the sums takes the same word of all regions.

    Regions are ranked by length, longest first, so those that reach word j are the first ``active[j]``. Sums at word t
    are an array for the regions of t words or more.
    """

    def __init__(self, seen: list[tuple[list, set[tuple[int, int, int]]]]):
        ranked = sorted((s for s in seen if s[0]), key=lambda s: -len(s[0]))
        lengths = np.array([len(table) for table, _ in ranked], np.int64)
        self.active = [int((lengths > j).sum()) for j in range(int(lengths.max(initial=0)))]
        self.first = np.concatenate([[0], np.cumsum([len(ranked), *self.active])]).astype(np.int64)
        rows, at, held, gold = [], [], [], []
        for rank, (table, marked) in enumerate(ranked):
            for j, here in enumerate(table):
                for i, f in here:
                    at += [len(rows)] * len(f)
                    held += f
                    rows.append((rank, i, j))
                    gold.append([(i, j, k) in marked for k in range(len(KINDS))])
        self.rank, self.i, self.j = np.array(rows, np.int64).reshape(-1, 3).T
        self.gold = np.array(gold, bool).reshape(-1, len(KINDS))
        self.counts = np.zeros((len(rows), len(FEATURES)))
        np.add.at(self.counts, (np.array(at, np.int64), np.array(held, np.int64)), 1)

    def gradient(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Log likelihood of the gold segments, and its gradient, by forward and backward sums over all segmentations."""
        each, active, n = self.counts @ weights.T, self.active, len(self.active)
        sums = np.full((int(self.first[-1]), MAX_WORDS), -np.inf)  # by last word and number of words before it
        sums[self.first[self.j + 1] + self.rank, self.j - self.i] = np.logaddexp.reduce(each, axis=1)
        ending = [sums[self.first[j + 1] : self.first[j + 2]] for j in range(n)]
        forward = [np.zeros(int(self.first[1]) if n else 0)]
        for j in range(n):
            terms = [forward[j - k][: active[j]] + ending[j][:, k] for k in range(min(MAX_WORDS, j + 1))]
            forward.append(np.logaddexp.reduce([forward[j][: active[j]], *terms]))
        backward = [np.zeros(len(f)) for f in forward]
        for i in range(n - 1, -1, -1):
            total = backward[i + 1].copy()
            for k in range(min(MAX_WORDS, n - i)):
                on = active[i + k]
                total[:on] = np.logaddexp(total[:on], backward[i + k + 1] + ending[i + k][:, k])
            backward[i][: active[i]] = total
        whole, before, after = backward[0], np.concatenate(forward), np.concatenate(backward)
        around = before[self.first[self.i] + self.rank] + after[self.first[self.j + 1] + self.rank] - whole[self.rank]
        p = np.exp(each + around[:, None])
        return float(each[self.gold].sum() - whole.sum()), (self.gold - p).T @ self.counts


def gradient(table: list, gold: set[tuple[int, int, int]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The same of one region."""
    return Sample([(table, gold)]).gradient(weights)


def _disguised(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with its spans in other forms: a phone number without its country, an address with (at) and (dot)."""
    out, found, at = [], [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        value = text[a:b]
        if kind == "phone":
            value = re.sub(r"^\+[0-9]+[\x20.-]?", "", value)
        elif kind == "email":
            name, _, host = value.partition("@")
            value = f"{name} (at) {host.replace('.', ' (dot) ')}"
        out += [text[at:a], value]
        start = sum(map(len, out)) - len(value)
        found.append((kind, start, start + len(value)))
        at = b
    return "".join([*out, text[at:]]), found


def fit(texts: list[str], rounds: int = 100, rate: float = 1.0, decay: float = 1e-3) -> np.ndarray:
    """Weights (kinds x features) by gradient ascent over the regions of ``texts`` and the decoys; without texts, no kind
    is ever found."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -3.0
    seen: list[tuple[list, set]] = [(segments(t, run), set()) for t in DECOYS for run in regions(t)] * 6
    for text in texts:
        if len(seen) >= MAX_REGIONS:
            break
        spans = base_spans(text)
        for t, marked in ((text, spans), _disguised(text, spans)):
            where = {(a, b): KINDS.index(k) for k, a, b in marked}
            for run in regions(t):
                table = segments(t, run)
                seen.append((table, {(i, j, where[run[i][0], run[j][1]]) for j, here in enumerate(table) for i, _ in here if (run[i][0], run[j][1]) in where}))
    seen = seen[:MAX_REGIONS]
    sample = Sample(seen)
    for r in range(rounds):
        weights += rate / (1 + 0.1 * r) * (sample.gradient(weights)[1] / len(seen) * 20 - decay * weights)
    return weights


def all_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds: segments that touch no base span; both by kind, then start."""
    base = base_spans(text)
    added = []
    taken = sorted((a, b) for _, a, b in base)
    starts, longest = [a for a, _ in taken], max((b - a for a, b in taken), default=0)
    for run in regions(text) if _TRIGGER.search(text) else ():
        for i, j, k in best(segments(text, run), weights, margin):
            a, b = run[i][0], run[j][1]
            if all(y <= a for _, y in taken[bisect_left(starts, a - longest) : bisect_left(starts, b)]):
                added.append((KINDS[k], a, b))
    return base, sorted(set(added), key=_order)


def _order(span: Span) -> tuple:
    return KINDS.index(span[0]), span[1], span[2]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def marked_parts(text: str) -> str:
    """The lines of a text (of long lines pieces of PART_CHARS characters or a word more) with digits or @, PARTS at most."""
    out: list[str] = []
    for line in re.finditer(r"[^\n]+", text):
        at = line.start()
        while at < line.end() and len(out) < PARTS:
            cut = re.compile(r"\s").search(text, min(at + PART_CHARS, line.end()), line.end())
            end = min(cut.start() if cut else line.end(), at + 2 * PART_CHARS)
            if _TRIGGER.search(text, at, end):
                out.append(text[at:end])
            at = end
        if len(out) == PARTS:
            break
    return "\n".join(out)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> np.ndarray:
    """Weights from at most ``most`` documents that hold personal data's marks, those of least hashed id first; of the texts
    of one id, the one of least hash. Of a document, its ``marked_parts`` come to the driver."""
    text = F.col(text_col)
    ids = docs.where(text.rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]{8}|[0-9]\.[0-9]+\.[0-9]")).select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).where("text is not null").join(F.broadcast(ids), "id", "left_semi")
    rows = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", F.udf(marked_parts, "string", useArrow=True)("text").alias("text"))
    return fit([r.text for r in rows.orderBy("id").limit(most).collect() if r.text])


def find(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) of every document.

    Counts and the digest are of base spans; ``spans`` has all as kind:start:end in code points, by kind and start, and
    ``found`` the same as structs. A null or empty text has none. Null ids and repeated rows are kept; other columns
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, joined, found = [], [], []
            for value in batch.column(1):
                base, added = all_spans(value.as_py() or "", weights)
                for c, kind in zip(counts, KINDS, strict=True):
                    c.append(sum(s[0] == kind for s in base))
                spans = sorted([*base, *added], key=_order)
                digests.append(sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(joined), pa.array(found, kind)], names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>")


def redacted(text: str | None, weights: np.ndarray) -> str | None:
    """The text with every span as its kind in brackets; of spans that overlap, the one that starts first counts."""
    if not text or not _TRIGGER.search(text):
        return text
    base, added = all_spans(text, weights)
    out, at = [], 0
    for kind, a, b in sorted([*base, *added], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        elif b <= at:
            continue
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with each text as ``redacted`` gives it; a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(x.as_py(), weights) for x in batch.column(at)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, train(docs)).drop("found")
