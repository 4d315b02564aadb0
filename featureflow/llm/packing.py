"""Packing documents into token sequences with a bounded number of open windows per task.

A task tokenises its rows and keeps `windows` open windows. A document goes to the window it fits best;
when none has room the fullest is topped up with the document's first tokens (if it has a worthwhile
rest) and emitted. What is open at the end of a task is merged with the leftovers of other tasks, a few
dozen tasks at a time, until one window is left that is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.llm.bpe import load
from featureflow.sources.storage import checkpointed

LENGTH = 4096
WINDOWS = 64
# A document is cut to fill a window only if that window has this many free tokens.
LEAST_CUT = 64
# Leftovers of so many tasks (then: merges) meet in one merge.
FAN_IN = 32
_ROWS = 20_000


class _Window:
    def __init__(self) -> None:
        self.used = 0
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2]) // 4


class _Packer:
    """Open windows of one task; `emit` collects the rows of closed ones."""

    def __init__(self, length: int, windows: int, least_cut: int, batch: int) -> None:
        self.length, self.windows, self.least_cut, self.base = length, windows, least_cut, batch
        self.open: list[_Window] = []
        self.done = 0
        self.rows: list[tuple] = []

    def place(self, doc_id: object, start: int, ids: bytes, total: int) -> None:
        for at in range(0, len(ids) - 4 * self.length + 1, 4 * self.length):  # whole sequences, without a copy of the rest
            full = _Window()
            full.add((doc_id, start, ids[at : at + 4 * self.length], total))
            self.emit(full, True)
            start += self.length
        ids = ids[len(ids) // (4 * self.length) * 4 * self.length :]
        while ids:
            size = len(ids) // 4
            best = min((w for w in self.open if w.used + size <= self.length), key=_free, default=None)
            if best is None and len(self.open) < self.windows:
                best = _Window()
                self.open.append(best)
            if best is not None:
                best.add((doc_id, start, ids, total))
                if best.used == self.length:
                    self.close(best)
                return
            fullest = min(self.open, key=_free)
            room = self.length - fullest.used
            if room >= self.least_cut:
                fullest.add((doc_id, start, ids[: 4 * room], total))
                ids, start = ids[4 * room :], start + room
            self.close(fullest)

    def close(self, window: _Window) -> None:
        self.open.remove(window)
        self.emit(window, True)

    def emit(self, window: _Window, closed: bool) -> None:
        offset = 0
        for doc_id, start, ids, total in window.pieces:
            kept = None if closed else ids
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.base + self.done, offset, closed, kept))
            offset += len(ids) // 4
        self.done += 1

    def finish(self) -> None:
        for window in self.open:
            self.emit(window, False)
        self.open = []


def _free(window: _Window) -> int:
    return -window.used


def _schema(doc_id: T.DataType) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    ends = [T.StructField("closed", T.BooleanType()), T.StructField("ids", T.BinaryType())]
    return T.StructType([T.StructField("doc_id", doc_id), *longs, *ends])


def _arrays(rows: list[tuple], kind: pa.DataType) -> list[pa.Array]:
    kinds = [kind, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def _number(level: int, group: int) -> int:
    """First sequence id of a task or merge: level, group and place have 4, 31 and 28 bits."""
    return (level << 59) | (group << 28)


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table, length: int, level: int, last: bool) -> pa.Table:
    """Fill the fullest leftovers from the emptiest, cutting pieces; at most one window stays open."""
    windows: dict[int, _Window] = {}
    names = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")
    for doc_id, start, ids, total, sequence, _ in sorted(zip(*(table.column(n).to_pylist() for n in names)), key=lambda r: (r[4], r[5])):
        windows.setdefault(sequence, _Window()).add((doc_id, start, ids, total))
    order = sorted(windows.values(), key=_free)
    packer = _Packer(length, 1, 1, _number(level, key[0].as_py()))
    low, high = 0, len(order) - 1
    while low <= high:
        window, room = order[low], length - order[low].used
        while room and high > low:
            doc_id, start, ids, total = order[high].pieces.pop()
            size = len(ids) // 4
            if size > room:  # its head moves, its tail stays
                order[high].pieces.append((doc_id, start + room, ids[4 * room :], total))
                ids = ids[: 4 * room]
            moved = len(ids) // 4
            order[high].used -= moved
            window.add((doc_id, start, ids, total))
            room -= moved
            if not order[high].pieces:
                high -= 1
        packer.emit(window, last or room == 0)
        low += 1
    return pa.Table.from_arrays(_arrays(packer.rows, table.schema.field("doc_id").type), names=[f.name for f in _schema(T.NullType())])


def pack(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
         windows: int = WINDOWS, least_cut: int = LEAST_CUT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are the ids of its whole text, then `end_id`; null text counts as empty and has
    the one token. Each token is in exactly one piece; pieces of a sequence follow each other from offset 0
    without gaps, up to `length` tokens. Only sequences that are emitted with less than `least_cut` tokens
    missing, and the last one, are not full. ids_crc32 is over little-endian unsigned 32-bit ids.
    Null and repeated doc_ids are packed row by row; other columns are not returned; an empty table
    gives no sequence. No shuffle but for the leftovers, at most `windows` per task.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = _schema(rows.schema["doc_id"].dataType)
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, windows, least_cut, _number(0, TaskContext.get().partitionId()))
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            parts: dict[int, list[bytes]] = {}
            told = [x.as_py() for x in batch.column(0)]
            texts = (t.as_py() or "" for t in batch.column(1))
            done = 0
            for i, packed in load(tokenizer).encode_many(texts):
                while done < i:
                    _placed(packer, told[done], parts.pop(done, []), tail)
                    done += 1
                parts.setdefault(i, []).append(packed)
                if len(packer.rows) >= _ROWS:
                    yield pa.RecordBatch.from_arrays(_arrays(packer.rows, kind), names=schema.names)
                    packer.rows = []
            while done < len(told):
                _placed(packer, told[done], parts.pop(done, []), tail)
                done += 1
        packer.finish()
        if packer.rows:
            yield pa.RecordBatch.from_arrays(_arrays(packer.rows, kind), names=schema.names)

    pieces = checkpointed(rows.mapInArrow(run, schema))
    out = [pieces.where("closed")]
    left = pieces.where("NOT closed")
    tasks = left.agg(F.max(F.shiftright("sequence_id", 28))).first()[0]
    level, groups = 0, 0 if tasks is None else tasks + 1
    while groups:
        level, last = level + 1, groups <= FAN_IN
        group = F.floor(F.shiftright("sequence_id", 28).bitwiseAND(F.lit((1 << 31) - 1)) / FAN_IN).alias("group")
        merge = _merger(length, level, last)
        merged = checkpointed(left.groupBy(group).applyInArrow(merge, schema))
        out.append(merged.where("closed"))
        left, groups = merged.where("NOT closed"), 0 if last else -(-groups // FAN_IN)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("closed", "ids")


def _placed(packer: _Packer, doc_id: object, parts: list[bytes], tail: bytes) -> None:
    ids = b"".join(parts) + tail
    packer.place(doc_id, 0, ids, len(ids) // 4)


def _merger(length: int, level: int, last: bool):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _merge(key, table, length, level, last)

    return merge
