"""BPE encoding and decoding of a text column, and its query."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordBpe, WordTable

WORD_FILE = "word_bpe_49k.json"
#: Texts whose results are held at once.
ROWS = 500
_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """The coder of ``path``, made once in each Python worker."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


class Strings:
    """Ids as text and decoded text of whole columns of texts, put together from those of their words."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.words = WordTable(self._made, self._clear)
        self._clear()

    def _clear(self) -> None:
        self.ids: list[str] = []
        self.decoded: list[str] = []
        self.n = array("q")

    def _made(self, words: list[str]) -> None:
        for word in words:
            ids = self.bpe.text(word)
            self.ids.append(" ".join(map(str, ids)))
            self.decoded.append(self.bpe.decode(ids))
            self.n.append(len(ids))

    def texts(self, column: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by one space, decoded text) of each text."""
        for bounds, places in self.words.texts(column):
            size = np.frombuffer(self.n, np.int64)[places]
            if len(size) and not size.min():  # words without ids (of odd white space alone)
                keep = size > 0
                bounds, places, size = np.concatenate([[0], np.cumsum(keep)])[bounds], places[keep], size[keep]
            n = np.concatenate([[0], np.cumsum(size)])
            found = places.tolist()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = found[a:b]
                yield int(n[b] - n[a]), " ".join(map(self.ids.__getitem__, own)), " ".join(map(self.decoded.__getitem__, own))


_tables: dict[str, Strings] = {}


def strings(path: str) -> Strings:
    if path not in _tables:
        _tables[path] = Strings(coder(path))
    return _tables[path]


def encode_decode(docs: DataFrame, path: str | None = None, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's BPE ids and the text they decode to: (id, n_tokens, ids, decoded), or with ``digests`` the
    SHA-256 of both instead.

    A null text is an empty one: no ids, empty decoded text. Null ids and repeated rows are kept as they are, one
    result for each row. Other columns are left out. Texts of any length are encoded whole; memory grows with one
    batch of texts and with the bounded word table.
    """
    path = path or public_tokenizers.path(WORD_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, len(whole), ROWS)):
            rows = list(strings(path).texts(batch.column(1)))
            n = pa.array([r[0] for r in rows], pa.int64())
            if digests:
                tail = [pa.array([sha256(r[k].encode("utf-8", "surrogatepass")).hexdigest() for r in rows], pa.string()) for k in (1, 2)]
            else:
                tail = [pa.array([[int(x) for x in r[1].split()] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *tail], names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = docs.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded string"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {tail}")


def op2_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
