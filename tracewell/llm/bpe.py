"""Byte-pair encoding of word pieces: a priority queue of merge ranks over a doubly linked symbol list.

``WordBpe`` reads a tokenizer file whose text is NFC-normalised, has white space dropped, is lower-cased and split into
pieces, and whose last symbol of a piece carries a word-end mark. Words are encoded once and kept in a bounded table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex

from .common import word_hashes

#: Unicode White_Space, which the tokenizer file's \s means (Python's \s also has 1C to 1F).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN_SPLIT = re.compile(f"[{SPACES}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    table = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [table[b] for b in range(256)]


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Apply merges to ``symbols`` (changed in place) lowest rank first, leftmost first among equals.

    ``pairs`` maps ``left << 20 | right`` to ``rank << 52 | merged id << 32``; an entry of the queue is that value
    plus the index of the left symbol. The list is doubly linked by index; an entry whose pair has changed since is
    stale and skipped when it comes up.
    """
    get = pairs.get
    queue, left = [], symbols[0]
    for k in range(1, len(symbols)):
        right = symbols[k]
        if found := get(left << 20 | right):
            queue.append(found + k - 1)
        left = right
    if not queue:
        return symbols
    n = len(symbols)
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        top = heappop(queue)
        k = top & 0xFFFFFFFF
        j = after[k]
        if j >= n or symbols[k] < 0 or get(symbols[k] << 20 | symbols[j]) != top - k:
            continue
        symbols[k], symbols[j] = new, _ = top >> 32 & 0xFFFFF, -1
        after[k] = i = after[j]
        if i < n:
            before[i] = k
            if found := get(new << 20 | symbols[i]):
                heappush(queue, found + k)
        i = before[k]
        if i >= 0 and (found := get(symbols[i] << 20 | new)):
            heappush(queue, found + i)
    return [s for s in symbols if s >= 0]


def read_pairs(model: dict) -> dict[int, int]:
    vocab, pairs = model["vocab"], {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs[vocab[a] << 20 | vocab[b]] = rank << 52 | vocab[a + b] << 32
    return pairs


class WordBpe:
    """Encoder and decoder for one word-piece tokenizer file."""

    #: Most pieces kept with their ids.
    limit = 300_000
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.pairs = read_pairs(model)
        signs = byte_symbols()
        self.inner, self.last = [vocab[s] for s in signs], [vocab[s + end] for s in signs]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self._pieces: dict[str, list[int]] = {}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def split(self, word: str) -> Sequence[str]:
        """Pieces of one raw word (no white space, no special string)."""
        if word.isascii() or unicodedata.is_normalized("NFC", word) and "\u03a3" not in word:  # a final sigma would depend on its neighbours
            word = word.lower()
        else:
            word = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
        if word.isalpha():
            return (word,)
        end = word[-1]
        if end.isascii() and not end.isalnum() and word[:-1].isalpha():  # letters and one sign
            return word[:-1], end
        return self.PIECES.findall(word)

    def word(self, word: str) -> list[int]:
        """Ids of one raw word."""
        ids: list[int] = []
        pieces = self._pieces
        for piece in self.split(word):
            if (found := pieces.get(piece)) is None:
                found = self.piece(piece)
                if len(pieces) >= self.limit:
                    pieces.clear()
                if len(piece) <= 64:
                    pieces[piece] = found
            ids += found
        return ids

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        inner = self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merge(symbols, self.pairs)

    def units(self, text: str) -> Iterator[str | int]:
        """Raw words of a text, and the id of each special string between them."""
        parts = self._special.split(text) if self._special and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part]
            else:
                yield from filter(None, _PLAIN_SPLIT.split(part))

    def text(self, text: str) -> list[int]:
        """Ids of a text of any content."""
        ids: list[int] = []
        for unit in self.units(text):
            ids += [unit] if isinstance(unit, int) else self.word(unit)
        return ids

    def decode(self, ids) -> str:
        """The vocabulary strings of ``ids``, one after the other, joined as the tokenizer file (which names no decoder) has it."""
        return " ".join([self.strings[i] for i in ids])


class Merger:
    """The merges of ``merge`` for many pieces at once, in numpy: in each round every piece that has a pair of known
    rank merges its leftmost pair of least rank."""

    NONE = np.int64((1 << 62) - 1)

    def __init__(self, bpe: WordBpe):
        order = np.argsort(np.array(list(bpe.pairs), np.int64))
        self.keys = np.array(list(bpe.pairs), np.int64)[order]
        self.values = np.array([v >> 52 << 20 | v >> 32 & 0xFFFFF for v in bpe.pairs.values()], np.int64)[order]  # rank, merged id
        self.inner, self.last = np.array(bpe.inner, np.int64), np.array(bpe.last, np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their number in each piece)."""
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = sizes.cumsum() - 1
        symbol = self.inner[raw]
        symbol[ends] = self.last[raw[ends]]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        value = np.full(len(symbol), self.NONE)
        value[:-1] = self.of(symbol[:-1], symbol[1:])
        value[ends] = self.NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            least = np.minimum.reduceat(value, first)
            size = np.diff(first, append=len(piece))
            live = np.repeat(least < self.NONE, size)
            if not live.all():
                done.append((piece[~live], symbol[~live]))
                piece, symbol, value, least = piece[live], symbol[live], value[live], np.repeat(least, size)[live]
                if not len(symbol):
                    break
            else:
                least = np.repeat(least, size)
            at = np.flatnonzero(value == least)
            at = at[np.diff(piece[at], prepend=-1) != 0]
            symbol[at] = value[at] & 0xFFFFF
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after the right symbols have gone
            piece, symbol, value = piece[keep], symbol[keep], value[keep]
            for k in (at - 1, at):
                k = k[k >= 0]
                k, end = k[k + 1 < len(piece)], k[k + 1 == len(piece)]
                value[k] = np.where(piece[k] == piece[k + 1], self.of(symbol[k], symbol[k + 1]), self.NONE)
                value[end] = self.NONE
        piece, symbol = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(piece, kind="stable")
        return symbol[order], np.bincount(piece, minlength=len(pieces))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then starts[1] ..."""
    ends = sizes.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordTable:
    """Places of words in a table that ``made`` fills, for whole columns of texts: every different word is looked up
    once a slice. The table starts anew when it holds ``limit`` words or ``limit_bytes`` of them."""

    limit, limit_bytes = 800_000, 1 << 25

    def __init__(self, made: Callable[[list[str]], None], clear: Callable[[], None]):
        self.made, self.clear = made, clear
        self.places: dict[int, int] = {}
        self.size = 0

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bounds, places) of a few texts at a time, in order: text k has the words places[bounds[k]:bounds[k + 1]],
        split at ASCII white space. What ``made`` has kept holds until the next item is asked for."""
        for _, _, bounds, hashes, starts, ends, raw in word_hashes(column, fold=False):
            if len(self.places) > self.limit or self.size > self.limit_bytes:
                self.places.clear()
                self.size = 0
                self.clear()
            coded = pa.array(hashes.view(np.int64)).dictionary_encode()
            kinds, which = coded.dictionary.to_numpy().tolist(), coded.indices.to_numpy()
            found = list(map(self.places.get, kinds))
            if None in found:
                body = raw.tobytes()
                first = np.empty(len(kinds), np.int64)
                first[which[::-1]] = np.arange(len(which))[::-1]
                new = [k for k, place in enumerate(found) if place is None]
                at = first[new]
                self.made([body[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                self.size += int((ends[at] - starts[at]).sum())
                for k in new:
                    found[k] = self.places[kinds[k]] = len(self.places)
            yield bounds, np.array(found, np.int64)[which]


class IdTable:
    """Ids of whole columns of texts, as 16-bit arrays."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.merger = bpe, Merger(bpe)
        self.words = WordTable(self._made, self._clear)
        self._clear()

    def _clear(self) -> None:
        # ids of words one after the other, where each begins, and the same of pieces
        self.pool, self.starts = np.empty(0, np.uint16), np.zeros(1, np.int64)
        self.piece_pool, self.piece_starts = np.empty(0, np.uint16), np.zeros(1, np.int64)
        self.pieces: dict[str, int] = {}

    def _made(self, words: list[str]) -> None:
        pieces, fresh, places, counts = self.pieces, [], [], []
        for word in words:
            n = 0
            for unit in (word,) if word.isascii() and "<" not in word else self.bpe.units(word):
                for piece in (unit,) if isinstance(unit, int) else self.bpe.split(unit):
                    place = pieces.get(piece)
                    if place is None:
                        place = pieces[piece] = len(pieces)
                        fresh.append(piece)
                    places.append(place)
                    n += 1
            counts.append(n)
        if fresh:
            plain = [k for k, p in enumerate(fresh) if isinstance(p, str) and len(p) <= 64]
            sizes = np.zeros(len(fresh), np.int64)
            other = {k: [p] if isinstance(p, int) else self.bpe.piece(p) for k, p in enumerate(fresh) if isinstance(p, int) or len(p) > 64}
            ids = np.empty(0, np.int64)
            if plain:
                ids, sizes[plain] = self.merger.ids([fresh[k].encode("utf-8", "surrogatepass") for k in plain])
            for k, own in other.items():
                sizes[k] = len(own)
            out = np.empty(sizes.sum(), np.uint16)
            at = sizes.cumsum() - sizes
            out[ranges(at[plain], sizes[plain])] = ids
            for k, own in other.items():
                out[at[k] : at[k] + len(own)] = own
            self.piece_pool = np.concatenate([self.piece_pool, out])
            self.piece_starts = np.concatenate([self.piece_starts, self.piece_starts[-1] + sizes.cumsum()])
        places = np.array(places, np.int64)
        at = self.piece_starts[places]
        size = self.piece_starts[places + 1] - at
        ends = np.concatenate([[0], size.cumsum()])[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        self.pool = np.concatenate([self.pool, self.piece_pool[ranges(at, size)]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for bounds, places in self.words.texts(column):
            at = self.starts[places]
            size = self.starts[places + 1] - at
            ids = self.pool[ranges(at, size)]
            cut = np.concatenate([[0], size.cumsum()])[bounds]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield ids[a:b]
