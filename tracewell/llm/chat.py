"""Chat formatting with a template that is a black box: turns' places are found by rendering and comparing.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered,
each whole, and what a prefix adds to the one before it is its last turn's span; where it does not start with the one
before, the template rewrites history, and the turn is marked. A turn's text within its span is found by rendering a probe
in its place. Nothing is assumed of how far back a template looks, so the work grows with the square of a conversation's
turns, and a task holds the turns of one conversation.

Rows are range-sorted by conversation and turn. A task's first and last conversation may go on in other tasks: their turns
are dealt by conversation and rendered in a second step. A digest over a conversation reads it in one stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

Turn = tuple[str, str]
#: Turns, and about how many characters, of a chunk of formatted text.
WINDOW = 16
WINDOW_CHARS = 1 << 22
#: Stands in for a text; a template must leave it as it is, and not write it itself.
PROBE = "\ue000text\ue001"
#: Strings that mark turns.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]")
_MARK = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_MARKED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")


def escape(text: str) -> str:
    """A mark gets a backslash after its first character, a mark with backslashes one more; nothing else changes."""
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1\2\3", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: Sequence[Turn]) -> str:
    """The registered template: an assistant's turn is <s>role, line feed, text</s>, another's [INST]role, line feed, text[/INST]."""
    ends = {True: ("<s>", "</s>"), False: ("[INST]", "[/INST]")}
    return "".join(f"{a}{_escape_role(role)}\n{escape(text)}{b}" for role, text in turns for a, b in [ends[role == "assistant"]])


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns that ``render`` wrote. Raises ValueError on anything else."""
    at = 0
    while at < len(formatted):
        opened = next((m for m in ("<s>", "[INST]") if formatted.startswith(m, at)), None)
        line = formatted.find("\n", at)
        end = formatted.find("</s>" if opened == "<s>" else "[/INST]", line) if opened and line > 0 else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        yield _unescape_role(formatted[at + len(opened) : line]), unescape(formatted[line + 1 : end])
        at = end + (4 if opened == "<s>" else 7)


@dataclass(frozen=True)
class Template:
    """A black box, what undoes its escapes, and whose texts are trained on."""

    render: Callable[[Sequence[Turn]], str] = render
    unescape: Callable[[str], str] = unescape
    trained: frozenset[str] = frozenset({"assistant"})


@dataclass
class Span:
    """What a turn adds to the rendering before it; the place of its text in that (-1: not trained on, or not found);
    how many characters of the rendering before it were taken back."""

    text: str
    start: int = -1
    end: int = -1
    taken_back: int = 0


def located(turns: Sequence[Turn], template: Template, context: Turn | None = None, past: Sequence[Turn] = ()) -> list[Span]:
    """The spans of ``turns``, which follow all of ``past``, or ``context`` alone."""
    past = list(past) if context is None else [context]
    before, out = template.render(past) if past else "", []
    for role, text in turns:
        now = template.render([*past, (role, text)])
        same = len(before) if now.startswith(before) else len(commonprefix([before, now]))
        span = Span(now[same:], taken_back=len(before) - same)
        if role in template.trained:
            probe = PROBE
            while probe in role:
                probe += PROBE
            shown = template.render([*past, (role, probe)])
            at = shown.rfind(probe)
            head, tail = (shown[same:at], shown[at + len(probe) :]) if at >= same else ("", None)
            if tail is not None and span.text.startswith(head) and span.text.endswith(tail) and len(head) + len(tail) <= len(span.text):
                span.start, span.end = len(head), len(span.text) - len(tail)
        out.append(span)
        past.append((role, text))
        before = now
    return out


CHUNK = "conv_id bigint, part int, seq int, whole boolean, turns int, text string, spans array<struct<at:int,start:int,end:int,taken_back:int>>, kind string, role string"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("turns", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("taken_back", pa.int32())]))), ("kind", pa.string()), ("role", pa.string())])


def _chunk(conv_id, part: int, seq: int, whole: bool, spans: list[Span]) -> dict:
    at, places = 0, []
    for s in spans:
        places.append({"at": at, "start": s.start, "end": s.end, "taken_back": s.taken_back})
        at += len(s.text)
    return {"conv_id": conv_id, "part": part, "seq": seq, "whole": whole, "turns": len(spans), "text": "".join(s.text for s in spans), "spans": places, "kind": "chunk", "role": None}


def _chunks(conv_id, part: int, turns: list[Turn], template: Template, window: int, within: bool) -> Iterator[dict]:
    """Chunks of a conversation, each turn rendered after all turns before it."""
    start = seq = 0
    while start < len(turns):
        end, size = start, 0
        while end < len(turns) and end - start < window and size <= WINDOW_CHARS:
            size += len(turns[end][1])
            end += 1
        seq += 1
        yield _chunk(conv_id, part, seq, within and end - start == len(turns), located(turns[start:end], template, past=turns[:start]))
        start = end


def _turn(conv_id, part: int, seq: int, turn: Turn) -> dict:
    return {"conv_id": conv_id, "part": part, "seq": seq, "whole": False, "turns": 0, "text": turn[1], "spans": [], "kind": "turn", "role": turn[0]}


def _runs(batches, template: Template, window: int) -> Iterator[dict]:
    """Chunks of the conversations that certainly lie within a task, from its sorted rows; one in one chunk is ``whole``.
    Turns of the task's first and last conversation come as they are (kind ``turn``)."""
    first, started = True, False  # within the task's first conversation; a row was seen
    conv, part, seq, turns = None, 0, 0, []
    for batch in batches:
        for conv_id, role, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if started and conv_id != conv:
                yield from _chunks(conv, part, turns, template, window, True)
                turns, first = [], False
            conv, part, started = conv_id, at, True
            turn = (role or "", text or "")
            if first:
                seq += 1
                yield _turn(conv, part, seq, turn)
            else:
                turns.append(turn)
    for k, turn in enumerate(turns, 1):
        yield _turn(conv, part, k, turn)


def _rendered(batches, template: Template, window: int) -> Iterator[dict]:
    """Chunks of the conversations whose turns came as they are, from rows sorted by conversation, part and seq."""
    conv, part, turns = None, 0, []
    for batch in batches:
        for r in batch.to_pylist():
            if turns and r["conv_id"] != conv:
                yield from _chunks(conv, part, turns, template, window, False)
                turns = []
            if not turns:
                conv, part = r["conv_id"], r["part"]
            turns.append((r["role"], r["text"]))
    yield from _chunks(conv, part, turns, template, window, False)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("text") or "") + 100
        if size > 1 << 23:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def chunks(conversations: DataFrame, template: Template = Template(), window: int = WINDOW) -> DataFrame:
    """Formatted chunks as tasks make them, turns of conversations that may lie in several as they are (see ``formatted``)."""
    rows = conversations.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn", "role", F.xxhash64("text"))
    rows = rows.select("conv_id", "role", "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(lambda batches: _batches(_runs(batches, template, window), _SCHEMA), CHUNK)


def with_parted(rows: DataFrame, template: Template = Template(), window: int = WINDOW) -> DataFrame:
    """``rows`` of kinds chunk and turn, where the turns have become chunks; two conversations of a task at most are shuffled."""
    turns = rows.where("kind = 'turn'").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    parted = turns.mapInArrow(lambda batches: _batches(_rendered(batches, template, window), _SCHEMA), CHUNK)
    return rows.where("kind = 'chunk'").select(parted.columns).unionByName(parted)


def formatted(conversations: DataFrame, template: Template = Template(), window: int = WINDOW) -> DataFrame:
    """(conv_id, part, seq, whole, turns, text, spans): the chunks of formatted conversations; a conversation is its
    chunks in order of (part, seq). ``spans`` has for each turn its place in the chunk's text, the place of the trained
    text within that (-1: none), and how many characters of what was rendered before it are taken back.

    Turns go by ``turn``, nulls first, equal ones by role and a hash of the text; a null role or text is empty; rows
    without conv_id are one conversation; repeated rows are turns each; other columns are not looked at.
    """
    return with_parted(written(chunks(conversations, template, window), "chat-chunks"), template, window).drop("kind", "role")


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
#: Of a whole conversation the digests; of a part what its digest needs.
_READ = pa.schema([*_DIGEST, *(f for f in _SCHEMA if f.name != "conv_id")])
READ = f"{DIGEST}, {CHUNK.removeprefix('conv_id bigint, ')}"


class _Reader:
    """Digests of a conversation, read back from its chunks."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.loss, self.n, self.loss_chars, self.chars = conv_id, sha256(), sha256(), 0, 0, 0

    def read(self, text: str, spans: list[dict]) -> None:
        for role, said in read_turns(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
        for s in spans:
            if s["start"] >= 0:
                said = unescape(text[s["at"] + s["start"] : s["at"] + s["end"]])
                self.loss.update(said.encode())
                self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _read_whole(batches) -> Iterator[dict]:
    for batch in batches:
        for r in batch.to_pylist():
            if r["whole"]:
                reader = _Reader(r["conv_id"])
                reader.read(r["text"], r["spans"])
                r |= reader.row() | {"text": None, "spans": []}
            yield r


def _read_parts(batches) -> Iterator[dict]:
    reader = None
    for batch in batches:
        for r in batch.to_pylist():
            if reader is None or reader.conv_id != r["conv_id"]:
                if reader is not None:
                    yield reader.row()
                reader = _Reader(r["conv_id"])
            reader.read(r["text"], r["spans"])
    if reader is not None:
        yield reader.row()


def digests(conversations: DataFrame, window: int = WINDOW) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation under the
    registered template, read back from the formatted text: conversations within one chunk in the task that made it,
    others from their chunks in order. An empty table has no rows; see ``formatted`` for nulls and ties."""
    read = chunks(conversations, window=window).mapInArrow(lambda batches: _batches(_read_whole(batches), _READ), READ)
    read = written(read, "chat-read")
    names = [f.name for f in _DIGEST]
    parts = with_parted(read.where("not whole").select(*(f.name for f in _SCHEMA)), window=window)
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "text", "spans")
    return read.where("whole").select(*names).unionByName(parts.mapInArrow(lambda batches: _batches(_read_parts(batches), _DIGEST), DIGEST))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of marks."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP12_SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) x(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + length({_ESC.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) + 1 + length({_ESC.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY 1"""
