"""Packing documents into fixed windows by the online sum-of-squares rule.

``counts[h]`` is the number of open windows filled up to level ``h``. A piece of size ``s``
goes to the level (or to a new window) after which the sum of ``counts[h] ** 2`` over the
partly filled levels is smallest; ties go to the fullest window. Documents of a window or
more give full windows of their own first; only the remainder is placed.

Windows left open at the end of a partition, or when ``OPEN_LIMIT`` of them are open, are
topped up with cut pieces of the emptiest ones, so that all but one become full. The last
one is cut into windows of powers of two, which need no padding.

Every input partition packs for itself: no shuffle, memory of ``OPEN_LIMIT`` windows, and a
lost task gives the same windows again.

Cases: a null text is empty and holds the end id only; null and repeated ids are kept as
they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palaver.llm import tokens
from palaver.llm.common import columns_of, text_of

WINDOW = 4096
END_ID = 2
OPEN_LIMIT = 512
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
TASK_BITS = 36  # sequence ids of one task


class Piece:
    """A run of one document's ids: four bytes an id in ``ids``."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id, start: int, ids: bytes, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * n], self.total),
            Piece(self.doc_id, self.start + n, self.ids[4 * n:], self.total),
        )


class SumOfSquares:
    """Online placement of pieces; finished windows are handed to ``emit``."""

    def __init__(self, emit, window: int = WINDOW, limit: int = OPEN_LIMIT):
        self.emit, self.window, self.limit = emit, window, limit
        self.counts = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list[Piece]]] = {}  # level -> open windows
        self.opened = 0

    def level_for(self, size: int) -> int:
        """Fill level (0: a new window) that keeps the sum of squares smallest."""
        n, full = self.counts, self.window
        best, change = 0, 2 * int(n[size]) + 1
        below = n[1: full - size]
        if len(below):
            delta = 2 * (n[1 + size: full] - below) + 2
            delta[below == 0] = change + 1
            k = len(delta) - 1 - int(np.argmin(delta[::-1]))
            if delta[k] <= change:
                best, change = k + 1, int(delta[k])
        if n[full - size] and 1 - 2 * int(n[full - size]) <= change:
            best = full - size
        return best

    def place(self, piece: Piece) -> None:
        size = len(piece)
        level = self.level_for(size)
        if level:
            window = self.at[level].pop()
            self.counts[level] -= 1
            self.opened -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.window:
            self.emit(window)
            return
        self.counts[level + size] += 1
        self.at.setdefault(level + size, []).append(window)
        self.opened += 1
        if self.opened > self.limit:
            rest = self.close()
            if rest:
                size = sum(map(len, rest))
                self.counts[size] += 1
                self.at[size] = [rest]
                self.opened = 1

    def close(self) -> list[Piece]:
        """Make all open windows full but one, which is returned."""
        windows = [w for level in sorted(self.at) for w in self.at[level]]
        self.at, self.opened = {}, 0
        self.counts[:] = 0
        donor: list[Piece] = []
        first = 0
        while windows[first:] or donor:
            if not windows[first:]:
                return donor
            window = windows.pop()
            room = self.window - sum(map(len, window))
            while room:
                if not donor:
                    if first >= len(windows):
                        return window
                    donor = list(windows[first])
                    first += 1
                piece = donor.pop()
                if len(piece) > room:
                    head, tail = piece.cut(len(piece) - room)
                    donor.append(head)
                    piece = tail
                window.append(piece)
                room -= len(piece)
            self.emit(window)
        return []

    def finish(self) -> None:
        rest = self.close()
        left = sum(map(len, rest))
        while left:
            size, part = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                piece = rest.pop()
                if len(piece) > size:
                    piece, tail = piece.cut(size)
                    rest.append(tail)
                part.append(piece)
                size -= len(piece)
            self.emit(part)


def _packer(path: str, end_id: int, window: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.words_of(path)
        end = end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << TASK_BITS
        rows: list[tuple] = []
        made = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal made
            at = 0
            for p in pieces:
                rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.total, base + made, at))
                at += len(p)
            made += 1

        def drain() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(NAMES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        packer = SumOfSquares(emit, window, limit)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.encode(text.as_py(), words) + end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    emit([Piece(doc_id, start, ids[4 * start: 4 * (start + window)], total)])
                if total > whole:
                    packer.place(Piece(doc_id, whole, ids[4 * whole:], total))
                if len(rows) >= 20_000:
                    yield drain()
        packer.finish()
        yield drain()

    return run


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = END_ID, window: int = WINDOW, open_limit: int = OPEN_LIMIT
) -> DataFrame:
    """One row for each piece of each document, with its window and place there."""
    source = columns_of(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    return source.mapInArrow(_packer(vocabulary, end_id, window, open_limit), SCHEMA)
