"""Token counts by a compiled finite-state tokenizer (operator 8).

Transitions of the transducer carry the number of tokens they emit. A text is cut
into chunks, each chunk becomes a state map, and the maps compose as in the up-sweep
of a parallel prefix scan: neighbours first, then neighbouring pairs, and so on, the
last composition being that of the whole text. A map is kept in symbolic form:
between white space that follows another character and the next such place the
tokenizer always returns to one state, so a chunk sends every entry state (the
unfinished run before it) to the count of that run with the chunk's head, plus a
fixed count, and leaves the chunk's tail as the unfinished run.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.llm.bpe_fst import BREAK, TextEncoder, encoder, forget
from pathglass.llm.common import release_with, task_tables, text_stream

#: Characters in a chunk.
CHUNK = 1 << 16


class StateMap(NamedTuple):
    """What a chunk does to any entry state; ``tail`` is None if no run ends inside."""

    head: str
    count: int
    tail: str | None


def _last_break(chunk: str) -> int:
    """The last place where a run ends and another begins, -1 if there is none."""
    size = 64
    while True:
        at = max(0, len(chunk) - size)
        last = None
        for last in BREAK.finditer(chunk, at):
            pass
        if last is not None or not at:
            return -1 if last is None else last.start()
        size *= 8


def state_map(chunk: str, enc: TextEncoder) -> StateMap:
    first = BREAK.search(chunk)
    if first is None:
        return StateMap(chunk, 0, None)
    last = _last_break(chunk)
    return StateMap(chunk[: first.start()], enc.count(chunk[first.start() : last]), chunk[last:])


def compose(a: StateMap, b: StateMap, enc: TextEncoder) -> StateMap:
    """First ``a``, then ``b``; associative."""
    left = a.head if a.tail is None else a.tail
    ends = BREAK.search(left[-1:] + b.head[:1]) is not None  # a run ends between the two
    done = 0 if a.tail is None else a.count
    if a.tail is None and b.tail is None:
        return StateMap(left, 0, b.head) if ends else StateMap(left + b.head, 0, None)
    if a.tail is None:
        return StateMap(left, enc.count(b.head) + b.count, b.tail) if ends else StateMap(left + b.head, b.count, b.tail)
    if b.tail is None:
        return StateMap(a.head, done + enc.count(left), b.head) if ends else StateMap(a.head, done, left + b.head)
    joined = enc.count(left) + enc.count(b.head) if ends else enc.count(left + b.head)
    return StateMap(a.head, done + joined + b.count, b.tail)


def up_sweep(maps, enc: TextEncoder) -> StateMap | None:
    """The composition of all maps in order, by balanced pairs; maps that a pair has joined are let go."""
    waiting: list[tuple[int, StateMap]] = []  # composed chunks, a power of two each, falling
    for m in maps:
        level = 0
        while waiting and waiting[-1][0] == level:
            m, level = compose(waiting.pop()[1], m, enc), level + 1
        waiting.append((level, m))
    total = waiting.pop()[1] if waiting else None
    while waiting:
        total = compose(waiting.pop()[1], total, enc)
    return total


def apply_to_start(m: StateMap, enc: TextEncoder) -> int:
    """Tokens of all text that the map has read, from the start state to the end."""
    return enc.count(m.head) + m.count + (enc.count(m.tail) if m.tail else 0)


def count_text(text: str, enc: TextEncoder, chunk: int = CHUNK) -> int:
    total = up_sweep((state_map(text[k : k + chunk], enc) for k in range(0, len(text), chunk)), enc)
    return 0 if total is None else apply_to_start(total, enc)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, scale: float = 1) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row.

    The count is that of the vocabulary's own library without begin or end
    tokens; special strings inside a text are single tokens. Null texts count as
    empty (0 bytes, 0 tokens). Every row gives a row, whatever its id; other
    columns are not read. No shuffle; memory is one Arrow batch, a few copies of a
    text's longest run without white space and bounded tables.
    """

    def run(batches):
        with task_tables("bpe"):
            enc = encoder(vocabulary, scale)
            release_with("bpe", forget)
            for b in batches:
                n, size = [], []
                for x in text_stream(b, "__text"):
                    n.append(count_text(x, enc, chunk))
                    size.append(len(x) if x.isascii() else len(x.encode()))
                columns = [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([b.column("__id"), *columns], ["__id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("__id", id_col)
