"""Packing: sum-of-squares online placement of documents into token windows.

Every task tokenizes its documents and packs them as they come, without a
shuffle.  A document's full windows are cut off first; the rest is placed into
the fill level (0 opens a window) that makes the sum of squared counts of
partially filled windows smallest, ties to the fullest.  The level array holds
one count per fill level.  At the end of the task the windows still open are
joined and cut anew into full windows; the last remainder becomes sequences of
power-of-two lengths, which need no padding.

Defined results: a null or empty text is a document of the end id alone; rows
with equal ids are documents of their own; empty tables give no pieces; other
columns are ignored.  No text is cut before tokenizing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import text_slices
from holdnet.llm.encoding import encoder

WINDOW = 1024
END_ID = 0
ID_BYTES = 4


class SumOfSquares:
    """Level array and open windows of one packer; ``place`` gives back the windows that became full."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]

    def level_for(self, item: int) -> int:
        """The fill level whose use gives the smallest sum of squared counts; ``size`` is no partial level."""
        levels = np.arange(self.size - item + 1)
        after = levels + item
        gain = np.where(after < self.size, 2 * self.count[after] + 1, 0)
        gain[1:] += 1 - 2 * self.count[1:len(levels)]
        gain[1:][self.count[1:len(levels)] == 0] = np.iinfo(np.int64).max
        return int(len(gain) - 1 - np.argmin(gain[::-1]))

    def place(self, item: int, piece) -> list | None:
        if item == self.size:
            return [piece]
        level = self.level_for(item)
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window.append(piece)
        if level + item == self.size:
            return window
        self.count[level + item] += 1
        self.open[level + item].append(window)
        return None

    def rest(self) -> Iterator[list]:
        """The windows still open, fullest first; the packer is empty afterwards."""
        for level in range(self.size - 1, 0, -1):
            yield from self.open[level]
            self.open[level] = []
        self.count[:] = 0


def recut(pieces: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Cut (doc, start, ids, doc_tokens) pieces in order into full windows, then power-of-two sequences."""
    left = sum(len(p[2]) for p in pieces) // ID_BYTES
    room = 0
    window: list[tuple] = []
    for doc, start, ids, total in pieces:
        while len(ids):
            if room == 0:
                if window:
                    yield window
                window = []
                room = size if left >= size else 1 << (left.bit_length() - 1)
                left -= room
            take = min(room, len(ids) // ID_BYTES)
            window.append((doc, start, ids[:take * ID_BYTES], total))
            start, ids, room = start + take, ids[take * ID_BYTES:], room - take
    if window:
        yield window


def _packer(path: str, size: int):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(path, "I")
        packer = SumOfSquares(size)
        serial = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def close(window):
            nonlocal serial
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // ID_BYTES, ids, total, serial, at))
                at += len(ids) // ID_BYTES
            serial += 1

        def flush():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        id_type = None
        for b in text_slices(batches):
            id_type = b.schema.field("doc_id").type
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                ids += end
                total = len(ids) // ID_BYTES
                for start in range(0, total, size):
                    part = ids[start * ID_BYTES:(start + size) * ID_BYTES]
                    full = packer.place(len(part) // ID_BYTES, (doc, start, part, total))
                    if full:
                        close(full)
            if rows:
                yield flush()
        for window in recut([p for w in packer.rest() for p in w], size):
            close(window)
        if rows:
            yield flush()
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
         size: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers; ``start`` counts the document's ids
    before the piece, ``offset`` the sequence's.  The end id closes every document.
    """
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_packer(tokenizer_path, size), f"doc_id {kind}, start long, length long, ids binary, "
                          "doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
           size: int = WINDOW) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pack(docs, tokenizer_path, id_col, text, size).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
