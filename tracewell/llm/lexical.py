"""Ranked lexical search: exact best documents of each query by a sum of integer term impacts.

``index`` makes shards of documents in the tasks that read them; a shard is its inverted lists, in rows of bounded size,
and counts over all shards give the collection's figures. ``search`` brings a shard's rows and the queries together,
gives the lists to a wavelet tree ordered by impact (see ``wavelet.py``), once for all queries of a block, and finds the
shard's best documents of every query by best-first search; what is shuffled after that is k rows of a shard and query at
most. What a task holds is one shard, its tree and a block's queries, however many shards it reads.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .terms import WORDS, counted, strings, texts
from .wavelet import Tree

#: Postings of a shard (a single larger document is a shard of its own): a tree takes about 8 bytes a posting and level.
POSTINGS = 1 << 19
#: Postings, or documents, of a row of the index: readers and Arrow take thousands of rows at a time.
PIECE = 128
#: Postings that a task searches, about.
CELL = 4 * POSTINGS
#: Terms of a block's queries.
BLOCK = 1 << 18
TOP = 50
#: Stands in for a null id: such a document comes after others of its score.
NO_ID = (1 << 63) - 1

SHARD = "shard bigint, n int, terms array<string>, counts array<int>, docs array<int>, uses array<int>, doc_ids array<bigint>, lengths array<bigint>"
_SHARD = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("uses", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


class _Shard:
    """Documents of a shard in the making."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.uses: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, found: Counter) -> None:
        names = self.terms
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(found.total())
        self.found.append(np.array([names.setdefault(t, len(names)) for t in found], np.int64))
        self.uses.append(np.array(list(found.values()), np.int64))
        self.size += len(found)

    def rows(self, shard: int, piece: int) -> Iterator[pa.RecordBatch]:
        """Documents, numbered by id, and lists by term; a list's documents ascend."""
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        docs, terms, uses = np.repeat(place, [len(x) for x in self.found]), np.concatenate(self.found), np.concatenate(self.uses)
        order = np.lexsort((docs, terms))
        docs, terms, uses = docs[order], terms[order], uses[order]
        runs = np.flatnonzero((np.arange(len(terms)) % piece == 0) | np.append(True, terms[1:] != terms[:-1]))

        def batch(size: int, **columns: tuple[pa.Array, np.ndarray]) -> pa.RecordBatch:
            """Rows of lists: of all values, and where each row's begin."""
            ends = np.append(np.arange(0, size, piece), size)
            made = {"shard": pa.array(np.full(len(ends) - 1, shard)), "n": pa.array(np.diff(ends), pa.int32())}
            made |= {k: pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends), pa.int32()), v) for k, (v, at) in columns.items()}
            return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(ends) - 1, f.type)) for f in _SHARD], schema=_SHARD)

        each = np.arange(len(ids))
        yield batch(len(ids), docs=(pa.array(each, pa.int32()), each), doc_ids=(pa.array(ids[by_id]), each), lengths=(pa.array(lengths[by_id]), each))
        each, names = np.arange(len(docs)), strings(list(self.terms)).take(pa.array(terms[runs]))
        counts = pa.array(np.diff(np.append(runs, len(docs))), pa.int32())
        yield batch(len(docs), terms=(names, runs), counts=(counts, runs), docs=(pa.array(docs, pa.int32()), each), uses=(pa.array(uses, pa.int32()), each))


def index(docs: DataFrame, postings: int = POSTINGS, piece: int = PIECE) -> DataFrame:
    """Shards of ``docs(doc_id, text)``, in rows of ``piece`` entries (``n``) at most. A row is a stretch of the inverted
    lists: ``terms``, how many entries (``counts``) of each, the numbers of the shard's documents that hold them (``docs``)
    and how often (``uses``); a long list goes on in further rows. Or it has the ids of some documents and their
    ``lengths`` in terms, by number. Documents without terms are in no shard; each row of the table is a document of its
    own, whatever its id."""

    def made(batches) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, text = batch.columns
            for doc_id, raw in zip(ids.to_pylist(), texts(text), strict=True):
                found = counted(raw, WORDS)
                if found:
                    shard.add(doc_id, found)
                if shard.size >= postings:
                    yield from shard.rows(number, piece)
                    shard, number = _Shard(), number + 1
        if shard.size:
            yield from shard.rows(number, piece)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(made, SHARD)


def weighted_queries(items: DataFrame, shards: DataFrame, n: int) -> DataFrame:
    """(key, item_id, term, weight) of ``items(key, item_id, text)``: each item's terms that some document holds, once,
    with floor(1000 ln((2 n + 2) / (2 df + 1)))."""

    def split(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, item, text = batch.columns
            found = [sorted(counted(raw, WORDS)) for raw in texts(text)]
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key.to_numpy(), sizes), pa.int64()), item.take(pa.array(np.repeat(np.arange(len(found)), sizes))), strings([t for f in found for t in f])], ["key", "item_id", "term"])

    terms = written(items.select("key", F.col("item_id").cast("bigint"), "text").mapInArrow(split, "key bigint, item_id bigint, term string"), "lexical-terms")
    held = shards.where("lengths is null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    held = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")))
    return terms.join(held.select("term", weight.alias("weight")), "term").select("key", "item_id", "term", "weight")


FOUND = "key bigint, item_id bigint, doc_id bigint, score bigint"


def _shards(batches) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard from batches ordered by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        edges = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
            if b > a and held and held[0].column("shard")[0].as_py() != shard[a]:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy().astype(np.int64)


class _Queries:
    """Queries of rows (key, item_id, term, weight)."""

    def __init__(self, rows: pa.Table) -> None:
        key = rows["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        coded = rows["term"].combine_chunks().dictionary_encode()
        self.vocabulary = coded.dictionary
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        self.keys, self.items = key[order][first].tolist(), rows["item_id"].take(pa.array(order[first])).to_pylist()
        self.terms, self.weights = (np.split(x[order], first[1:]) for x in (coded.indices.to_numpy(), rows["weight"].to_numpy()))


def _tree(rows: pa.Table, n: int, total: int) -> tuple[Tree, pa.Array, np.ndarray]:
    """A shard's tree, its terms by number, its documents' ids."""
    lone = pc.is_valid(rows["lengths"])
    own, lists = rows.filter(lone), rows.filter(pc.invert(lone))
    back = np.argsort(_flat(own["docs"]))
    ids, lengths = _flat(own["doc_ids"])[back], _flat(own["lengths"])[back]
    m = 50 + np.array([50 * x * n // total for x in lengths.tolist()], np.int64)
    coded = pc.list_flatten(lists["terms"]).combine_chunks().dictionary_encode()
    terms = np.repeat(coded.indices.to_numpy().astype(np.int64), _flat(lists["counts"]))
    docs, uses = _flat(lists["docs"]), _flat(lists["uses"])
    return Tree(terms, docs, 1_000_000_000 * uses // (1000 * uses + 20 * m[docs]), len(coded.dictionary), len(ids)), coded.dictionary, ids


def _searched(batches, n: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each shard's k best documents of each query; the queries come first, as shard -1. The k-th score of a shard holds
    for what follows in the task: that many documents are as good already."""
    queries, least = None, {}
    for shard, rows in _shards(batches):
        if shard < 0:
            queries = _Queries(rows)
            continue
        if queries is None:
            return
        tree, names, ids = _tree(rows, n, total)
        number = pc.fill_null(pc.index_in(queries.vocabulary, value_set=names), -1).to_numpy()
        out: list[tuple] = []
        for key, item, terms, weights in zip(queries.keys, queries.items, queries.terms, queries.weights, strict=True):
            own = number[terms]
            some = own >= 0
            found, scores = tree.best(own[some], weights[some], k, least.get(key, 1))
            if len(scores) == k:
                least[key] = max(least.get(key, 1), int(scores[-1]))
            if len(scores):
                out.append((np.full(len(found), key), [item] * len(found), ids[found], scores))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out]), pa.int64()), pa.array([v for x in out for v in x[1]], pa.int64()), pa.array(np.concatenate([x[2] for x in out]), pa.int64()), pa.array(np.concatenate([x[3] for x in out]), pa.int64())], ["key", "item_id", "doc_id", "score"])


def search(shards: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of ``items(item_id, text)`` over shards of ``index`` (a written table): each item's
    k documents of highest score above 0, equal scores by id, documents without id last.

    An item that is repeated, or has no id, is a query of its own; an item without terms, or whose terms no document
    holds, has no rows, nor has any item if no document has a term.
    """
    lone = F.col("lengths").isNotNull()
    facts = shards.agg(F.sum(F.when(lone, F.col("n"))).alias("n"), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("total"), F.sum(F.when(~lone, F.col("n"))).alias("postings")).first()
    n, total = facts.n or 0, facts.total or 1
    items = written(items.select("item_id", "text").withColumn("key", F.monotonically_increasing_id()), "lexical-items")
    queries = written(weighted_queries(items, shards, n), "lexical-queries")
    blocks, cells = max(1, -(-queries.count() // BLOCK)), max(1, -(-(facts.postings or 0) // CELL))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # a task's shards and the tasks' first shards go to cells by multiples of two fractions, which leave no cell crowded
    dealt = F.shiftright((F.shiftright("shard", 32) * 1_621_087_444 + F.col("shard").bitwiseAND((1 << 32) - 1) * 1_223_722_706) % (1 << 31) * cells, 31).cast("int")
    # a block's queries go to every cell, a cell's shards to every block
    asked = queries.select(F.lit(-1).cast("bigint").alias("shard"), "*", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), every(cells).alias("cell"))
    met = shards.drop("n").select("*", dealt.alias("cell"), every(blocks).alias("block")).unionByName(asked, allowMissingColumns=True)
    met = met.repartitionById(blocks * cells, F.col("block") * cells + F.col("cell")).drop("block", "cell").sortWithinPartitions("shard")
    found = met.mapInArrow(lambda batches: _searched(batches, n, total, k), FOUND)
    by = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = written(index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lexical-shards")
    return search(shards, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest({_TERMS}) AS term FROM d) GROUP BY 1, 2, 3),
l AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT row_number() OVER () AS key, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
q AS MATERIALIZED (SELECT key, item_id, x.term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT key, item_id, unnest(terms) AS term FROM i) x JOIN df ON df.term = x.term CROSS JOIN s),
f AS (SELECT key, item_id, p.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM q JOIN p ON p.term = q.term JOIN l ON l.r = p.r CROSS JOIN s GROUP BY 1, 2, 3, 4)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0) WHERE rank <= 50"""
