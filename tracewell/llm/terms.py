"""Terms of texts: the maximal runs of some ASCII characters and of all characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa


def _table(kept: bytes) -> bytes:
    """Bytes of ``kept``, and all beyond ASCII, stay (A-Z as a-z); every other one is a blank."""
    return bytes(b if b in kept or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


_LETTERS = bytes(range(0x61, 0x7B))
#: Terms of letters, and of letters and digits.
LETTERS, WORDS = _table(_LETTERS), _table(_LETTERS + bytes(range(0x30, 0x3A)))
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 22


def split(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a slice of the text at a time."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(text: bytes, table: bytes) -> Counter:
    """How often each term occurs."""
    out: Counter = Counter()
    for part in split(text, table):
        out.update(part)
    return out


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text's bytes; none for null."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def strings(found: list[bytes]) -> pa.Array:
    return pa.array(found, pa.binary()).cast(pa.string())
