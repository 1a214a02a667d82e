"""Shared helpers: table reads, batch slicing, byte-level word spans and hashes, shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from holdnet.session import ensure_checkpoint_dir

#: Words of most operators: maximal runs of anything but the ASCII white space \x20 \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"

#: Arrow batches are cut into slices of about this many text bytes before any Python work.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes to clash with no column (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the session's checkpoint folder (shared by driver and executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no slice holds much more than ``max_bytes`` of text.

    A single longer text forms a slice of its own; no text is cut.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        lo = 0
        for hi in [*cuts.tolist(), batch.num_rows]:
            if hi > lo:
                yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: null counts as empty, bytes of row i are at offsets[i]:offsets[i+1]."""
    col = col.fill_null("").cast(pa.large_string())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def class_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Lower-cases A-Z and keeps every other byte.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
NOT_WHITE = class_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM_OR_HIGH = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of the maximal runs of ``inside`` bytes; none crosses a row's end."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cls = inside[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = cls[:-1]
    starts = np.flatnonzero(cls & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = cls[1:]
    ends = np.flatnonzero(cls & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX2
    return (h ^ (h >> np.uint64(27))) * _MIX ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span, eight bytes at a time over all spans at once."""
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) + _MIX)
    if len(starts) == 0:
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    todo = np.arange(len(starts))
    done = 0
    while len(todo):
        left = size[todo] - done
        word = lanes[starts[todo] + done]
        part = left < 8
        keep = np.where(part, (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1),
                        np.uint64(0xFFFFFFFFFFFFFFFF))
        h[todo] = mix((h[todo] ^ (word & keep)) * _MIX)
        todo = todo[left > 8]
        done += 8
    return h


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
