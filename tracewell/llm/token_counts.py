"""Token counts from a tokenizer compiled to deterministic transducers.

Within a piece, states are prefixes met so far (compiled as they are met, numbered, and reused by every piece that
shares them); a transition reads one byte and carries the change of the number of emitted tokens, so the sum along a
path is the piece's count. The last token of a prefix's encoding is the longest vocabulary entry that ends there and
may follow the last token of what precedes it; whether two tokens may stand side by side is found once by merging.

Across a text, a chunk's effect on the state is a map. White space after something else always starts a new piece, so
the part of a chunk before the first such place is the only part that depends on the entering state: the map is
(open start, count, open end), and maps compose associatively, whatever the chunks' length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACES, byte_symbols, merge, read_pairs

BYTE_FILE = "byte_bpe_50k.json"
#: White space (if any) and what follows it up to the next white space: units that no piece crosses.
UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Where a piece always starts: white space after something else.
SYNC = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")


class Transducer:
    """Counts of tokens for one byte-level tokenizer file."""

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: States and known units kept; when full, the tables start anew.
    max_states, max_units = 500_000, 400_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, self.pairs = spec["model"]["vocab"], read_pairs(spec["model"])
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {bytes([byte_of[c] for c in s]): i for s, i in vocab.items() if s not in special}
        self.raw = {i: b for b, i in self.tokens.items()}
        self.single = [self.tokens[bytes([b])] for b in range(256)]
        self.tree: dict[int, int] = {}  # node << 8 | byte -> node: the vocabulary read from its entries' ends
        self.ends = [-1]
        for raw, token in self.tokens.items():
            node = 0
            for byte in reversed(raw):
                key = node << 8 | byte
                if key not in self.tree:
                    self.tree[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.tree[key]
            self.ends[node] = token
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self.made = {v >> 32 & 0xFFFFF: (v >> 52, k >> 20, k & 0xFFFFF) for k, v in self.pairs.items()}  # token -> rank, parts
        self._beside: dict[int, bool] = {}
        self._self: dict[int, bool] = {}
        self._units: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        self.last, self.emitted = [-1], [0]  # by state: the last token, tokens so far

    def _alone(self, token: int) -> bool:
        """Whether merging the bytes of ``token`` gives just it."""
        return merge([self.single[b] for b in self.raw[token]], self.pairs) == [token]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` may stand side by side in an encoding; a is -1 at a piece's start.

        The merges that made both are undone latest first; the pair at the seam must at no time have had a merge that
        comes before the next one on either side (equal ranks go leftmost first).
        """
        k = a << 20 | b
        if (found := self._beside.get(k)) is not None:
            return found
        if len(self._beside) > self.max_states:
            self._beside.clear()
        found = self._alone(b) if b not in self._self else self._self[b]
        self._self[b] = found
        if found and a >= 0:
            made, limit = self.made, 1 << 60
            x, y = a, b
            while True:
                rank = self.pairs.get(x << 20 | y)
                if rank is not None and rank >> 52 < limit:
                    found = False
                    break
                (left_rank, _, x_end), (right_rank, y_start, _) = made.get(x, (-1, 0, 0)), made.get(y, (-1, 0, 0))
                if left_rank < 0 and right_rank < 0:
                    break
                if left_rank > right_rank:
                    limit, x = left_rank, x_end
                else:
                    limit, y = right_rank + 1, y_start
        self._beside[k] = found
        return found

    def _compile(self, piece: bytes, end: int, path: list[int]) -> int:
        """The new state after ``piece[:end]``; ``path[k]`` is the state after k bytes."""
        node, k, tree, ends, found = 0, end, self.tree, self.ends, []
        while k:
            k -= 1
            node = tree.get(node << 8 | piece[k])
            if node is None:
                break
            if ends[node] >= 0:
                found.append((path[k], ends[node]))
        for before, token in reversed(found):
            if self._may_follow(self.last[before], token):
                self.last.append(token)
                self.emitted.append(self.emitted[before] + 1)
                return len(self.last) - 1
        raise AssertionError("single bytes are tokens, so some token ends here")

    def piece(self, piece: bytes) -> int:
        """Tokens of one piece: the sum of what its path emits."""
        if len(self.last) + len(piece) > self.max_states and len(self.last) > 1:
            self._reset()
        state, step, path = 0, self.step, [0]
        for end, byte in enumerate(piece, 1):
            key = state << 8 | byte
            nxt = step.get(key)
            if nxt is None:
                nxt = step[key] = self._compile(piece, end, path)
            state = nxt
            path.append(state)
        return self.emitted[state]

    def unit(self, unit: str) -> int:
        """Tokens of a unit: white space, if any, and what follows it."""
        found = self._units.get(unit)
        if found is None:
            found = sum([self.piece(p.encode("utf-8", "surrogatepass")) for p in self.PIECES.findall(unit)])
            if len(self._units) < self.max_units and len(unit) <= 64:
                self._units[unit] = found
        return found

    # -- chunk maps: (open start, count, open end); count None: no place where a piece surely starts ----------------

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        first = SYNC.search(chunk)
        if first is None:
            return chunk, None, ""
        units = UNIT.findall(chunk, first.start())
        tail = units.pop()
        return chunk[: first.start()], sum(map(self.unit, units)), tail

    def then(self, a: tuple, b: tuple) -> tuple:
        """The map of a chunk and the one after it."""
        if a[1] is None:
            joined = self.chunk_map(a[0] + b[0])
            if b[1] is None:
                return joined
            if joined[1] is None:
                return joined[0], b[1], b[2]
            return joined[0], joined[1] + self._between(joined[2]) + b[1], b[2]
        if b[1] is None:
            joined = self.chunk_map(a[2] + b[0])
            return (a[0], a[1], joined[0]) if joined[1] is None else (a[0], a[1] + self._between(joined[0]) + joined[1], joined[2])
        return a[0], a[1] + self._between(a[2] + b[0]) + b[1], b[2]

    def _between(self, text: str) -> int:
        """Tokens of what lies between two places where pieces surely start."""
        return sum(map(self.unit, UNIT.findall(text)))

    def scan(self, maps: list[tuple]) -> tuple:
        """All maps composed, in pairs of neighbours, then pairs of those, and so on."""
        while len(maps) > 1:
            maps = [self.then(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int) -> int:
        """Tokens of ``text``; special strings count one token each, and what is between them stands alone."""
        total, at = 0, 0
        ends = [m.span() for m in self._special.finditer(text)] if self._special and "<|" in text else []
        for a, b in [*ends, (len(text), len(text))]:
            part = text[at:a]
            total, at = total + (b > a), b
            if len(part) <= chunk:
                total += self._between(part)
            elif part:
                start, count, end = self.scan([self.chunk_map(part[k : k + chunk]) for k in range(0, len(part), chunk)])
                total += self._between(start) + (count or 0) + self._between(end)
        return total


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, chunk: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text.

    A null text is an empty one: 0 bytes, 0 tokens. Null ids and repeated rows are kept, one result each; other
    columns are left out. ``chunk`` is the number of characters whose state map is made at once.
    """
    path = path or public_tokenizers.path(BYTE_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.count(x.as_py() or "", chunk) for x in batch.column(2)], pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(id_col, F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
