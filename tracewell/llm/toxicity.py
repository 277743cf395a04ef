"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic texts (P) and unlabelled texts (U), with
a risk corrected by the class prior: prior * R+(P) + max(0, R-(U) - prior * R-(P)). Where the second term is negative on
a batch, its gradient is reversed, so that it cannot run below zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FEATURES = 1 << 18
#: Bounds of the training sample: confirmed toxic texts, unlabelled texts.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
#: Least ratio of a word's share of positive texts to its share of unlabelled texts.
LIFT = 2.5
_TRIM = ".,;:!?\"'()[]{}#*$%&|<>"
_UPPER = {c: c + 32 for c in range(65, 91)}


class WordHashes(dict):
    """word -> 64-bit hash as a signed int, computed once for each word; emptied when full."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        h = h - (1 << 64) if h >> 63 else h
        self[word] = h
        return h


WORD_HASHES = WordHashes()


def lower_ascii(text: str) -> str:
    """``text`` with A-Z lower-cased and nothing else."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words of a whole text (A-Z lower-cased, punctuation at the ends trimmed) and their values:
    log(1 + count)."""
    words = [w.strip(_TRIM) for w in lower_ascii(text).split()] if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.int64, len(words)) & (FEATURES - 1)
    found, counts = np.unique(hashes, return_counts=True)
    return found, np.log1p(counts)


Features = tuple[np.ndarray, np.ndarray]


def _matrix(texts: list[Features]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols, values = [], [], []
    for k, (c, v) in enumerate(texts):
        rows.append(np.full(len(c), k))
        cols.append(c)
        values.append(v)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def fit(positive: list[Features], unlabelled: list[Features], prior: float, rounds: int = 60, batches: int = 8, rate: float = 0.05, decay: float = 2e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias from the features of texts. The loss is the logistic one; the optimiser is Adam with decoupled decay, over ``batches`` parts of P and U a
    round. Words that fewer than three, or fewer than 1 %, of the positive texts hold keep weight 0, as do those below LIFT."""
    rng = np.random.default_rng(seed)
    xp, xu = _matrix(positive), _matrix(unlabelled)
    in_p, in_u = np.bincount(xp[1], minlength=FEATURES), np.bincount(xu[1], minlength=FEATURES)
    used = np.flatnonzero((in_p >= max(3, 0.01 * len(positive))) & (in_p * len(unlabelled) >= LIFT * in_u * len(positive)))
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))

    def narrowed(x: tuple) -> tuple:
        keep = place[x[1]] >= 0
        return x[0][keep], place[x[1][keep]], x[2][keep]

    xp, xu = narrowed(xp), narrowed(xu)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0
    part_p, part_u = rng.permutation(len(positive)) % batches, rng.permutation(len(unlabelled)) % batches

    def margins(x: tuple, n: int) -> np.ndarray:
        return np.bincount(x[0], x[2] * w[x[1]], minlength=n) + b

    for _ in range(rounds):
        for k in rng.permutation(batches):
            fp, fu = margins(xp, len(positive)), margins(xu, len(unlabelled))
            sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
            mp, mu = part_p == k, part_u == k
            np_, nu = max(1, mp.sum()), max(1, mu.sum())
            rest = np.logaddexp(0, fu[mu]).sum() / nu - prior * np.logaddexp(0, fp[mp]).sum() / np_
            g_plus, g_minus_p, g_minus_u = -prior * (1 - sp) * mp / np_, -prior * sp * mp / np_, su * mu / nu
            gp, gu = (g_plus + g_minus_p, g_minus_u) if rest >= 0 else (-g_minus_p, -g_minus_u)
            grad = np.empty(len(used) + 1)
            grad[:-1] = np.bincount(xp[1], xp[2] * gp[xp[0]], minlength=len(used)) + np.bincount(xu[1], xu[2] * gu[xu[0]], minlength=len(used))
            grad[-1] = gp.sum() + gu.sum()
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w * (1 - rate * decay * 50) - move[:-1], b - move[-1]
    out = np.zeros(FEATURES)
    out[used] = w
    return out, b


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float] | None:
    """The classifier, from rows that are not held out; None without any confirmed toxic text.

    P: documents with label toxic = 1, at most MAX_POSITIVE; U: all documents, labelled or not, at most MAX_UNLABELLED;
    both those of least hashed id; of the texts of one id, the one of least hash. What comes to the driver is the features
    of these texts, FEATURES numbers a text at most. The prior is the share of toxic rows among the labels that may be used.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("text").isNotNull())
    marks = labels.select(F.col(id_col).alias("id"), "toxic").where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("id")))
    counts = marks.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("p")).first()
    if not counts.p:
        return None
    order = [F.xxhash64("id"), "id"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["id", "places", "uses"])

    kind = texts.schema["id"].dataType.simpleString()

    def sample(ids: DataFrame, most: int) -> list[Features]:
        ids = ids.select("id").distinct().orderBy(*order).limit(most)
        rows = texts.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        found = rows.mapInArrow(encoded, f"id {kind}, places array<bigint>, uses array<double>").orderBy(*order).limit(most).toArrow()
        return [(np.array(c, np.int64), np.array(v)) for c, v in zip(found["places"].to_pylist(), found["uses"].to_pylist(), strict=True)]

    positive, unlabelled = sample(marks.where("toxic = 1"), MAX_POSITIVE), sample(texts, MAX_UNLABELLED)
    if not positive:
        return None
    return fit(positive, unlabelled or [features(None)], min(0.9, max(1e-4, counts.p / counts.n)))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    The score is the logistic of the classifier's margin over the whole text; an empty or null text has the bias alone.
    Null ids and repeated rows are kept; other columns are left out. Without a classifier every score is 0.
    """
    if model is not None:
        w, b = model
        places = np.flatnonzero(w)
        held = docs.sparkSession.sparkContext.broadcast((places, w[places], b))  # at most FEATURES numbers

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.zeros(FEATURES)
        if model is not None:
            weights[held.value[0]] = held.value[1]
        for series in texts:
            out = np.zeros(len(series))
            if model is not None:
                for k, text in enumerate(series):
                    c, v = features(text)
                    out[k] = 1 / (1 + np.exp(-np.clip(weights[c] @ v + held.value[2], -500, 500)))
            yield pd.Series(out)

    scored = F.pandas_udf(run, "double")
    out = docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), scored(text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
