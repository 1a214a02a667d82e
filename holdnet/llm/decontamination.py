"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark items' windows (``WINDOW`` consecutive words, or the
whole item if it has fewer).  Per pattern length L, every block of two
consecutive words (one for L = 1) has a shift: how far the search may move on
when a window ends in that block.  Nearly all blocks occur in no pattern and
allow L - 1 words at once.  Blocks with shift 0 select the bucket of patterns
that end in them; candidates are compared word hash by word hash and then byte
by byte.  All texts of a slice are searched in step, one pointer per lane of
``LANE`` words, so the work is numpy array code on ragged word arrays.

Words: A-Z lower-cased, maximal runs of 0-9, a-z and non-ASCII characters.

The patterns are broadcast in blocks of at most ``PATTERN_BYTES`` of item text,
measured first; a larger benchmark is searched block by block, the marks so far
written to the shared folder between blocks.

Defined results: null or empty texts have no words and are never hit; items
without words give no window; an item with a null id marks words but is not
listed; items that share an id count once; rows with equal ids stay rows of
their own; empty tables give empty results or no hits; other columns pass
through ``drop_contaminated`` and are ignored by ``report``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import (ALNUM_OR_HIGH, LOWER, fresh, mix, span_hashes, text_bytes, text_slices, word_spans, written)

WINDOW = 10
LANE = 256
PATTERN_BYTES = 32 << 20
_RUNS = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    return _RUNS.findall((text or "").encode().lower())


def _hashes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return span_hashes(raw, np.concatenate([[0], ends[:-1] + 1]), ends)


def _block(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at the positions ``at``."""
    return h[at] if size == 1 else mix(h[at - 1] * np.uint64(3) + h[at])


class Patterns:
    """Shift table, suffix buckets and words of all patterns of one length."""

    def __init__(self, length: int, words: list[tuple[bytes, ...]], items: list[list[int]]):
        self.length, self.words, self.items = length, words, items
        self.block = min(2, length)
        self.h = np.stack([_hashes(list(w)) for w in words])
        ends = np.arange(self.block - 1, length)
        blocks = np.stack([_block(row, ends, self.block) for row in self.h])
        bits = max(12, int(blocks.size * 8).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.int32)
        np.minimum.at(self.shift, (blocks & self.mask).astype(np.int64), np.broadcast_to(length - 1 - ends, blocks.shape))
        order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix, self.bucket = blocks[order, -1], order

    def search(self, h: np.ndarray, ends: np.ndarray, stops: np.ndarray):
        """(end position, pattern) of every candidate: lanes start at ``ends`` and go on while below ``stops``."""
        found_at, found = [], []
        live = ends < stops
        at, stop = ends[live], stops[live]
        while len(at):
            blocks = _block(h, at, self.block)
            step = self.shift[(blocks & self.mask).astype(np.int64)]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                lo = np.searchsorted(self.suffix, blocks[hit], "left")
                n = np.searchsorted(self.suffix, blocks[hit], "right") - lo
                where = np.repeat(at[hit], n)
                which = self.bucket[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                for k in range(self.length - 1, -1, -1):
                    same = h[where - (self.length - 1 - k)] == self.h[which, k]
                    where, which = where[same], which[same]
                found_at.append(where)
                found.append(which)
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        z = np.zeros(0, np.int64)
        return np.concatenate([z, *found_at]), np.concatenate([z, *found])


def patterns(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Patterns by length; each knows the numbers of the items that contain it."""
    by_length: dict[int, dict[tuple, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = item_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            of = by_length.setdefault(n, {}).setdefault(tuple(words[i:i + n]), [])
            if not of or of[-1] != k:
                of.append(k)
    return [Patterns(n, list(p), list(p.values())) for n, p in sorted(by_length.items())]


def scan(texts: pa.Array, tables: list[Patterns]):
    """(words per row, mark per word, first word of each row, set of item numbers per row)."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, ALNUM_OR_HIGH)
    h = span_hashes(raw, starts, ends)
    n = np.diff(first)
    marks = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set[int]] = {}
    lanes = -(-n // LANE)
    row = np.repeat(np.arange(len(n)), lanes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lane_at = first[row] + nth * LANE
    lane_stop = np.minimum(lane_at + LANE, first[row + 1])
    for p in tables:
        at, which = p.search(h, np.maximum(lane_at, first[row] + p.length - 1), lane_stop)
        if not len(at):
            continue
        begin = at - (p.length - 1)
        sure = np.fromiter((all(raw[starts[b + k]:ends[b + k]].tobytes() == w for k, w in enumerate(p.words[q]))
                            for b, q in zip(begin.tolist(), which.tolist(), strict=True)), bool, len(at))
        at, begin, which = at[sure], begin[sure], which[sure]
        np.add.at(marks, begin, 1)
        np.add.at(marks, at + 1, -1)
        rows = np.searchsorted(first, at, "right") - 1
        for r, q in zip(rows.tolist(), which.tolist(), strict=True):
            items.setdefault(r, set()).update(p.items[q])
    return n, np.cumsum(marks)[:-1] > 0, first, items


def item_blocks(benchmark: DataFrame, id_col: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark split by a hash into blocks of about ``block_bytes`` of text, by its measured size."""
    src = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    return [src if n == 1 else src.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b) for b in range(n)]


def _marker(tables: list[Patterns], names: list[str | None], columns: list[str], own: list[str], text: str, merge: bool,
            keep: bool):
    """mapInArrow function that adds the marks of one block of patterns to those before."""
    n_words, n_hits, item_list, mark_bits = own

    def run(batches):
        for batch in text_slices(batches, text):
            rows = range(batch.num_rows)
            n, hit, first, items = scan(batch.column(text), tables)
            listed = [{names[k] for k in items.get(r, ()) if names[k] is not None} for r in rows]
            if merge:
                for r, (bits, known) in enumerate(zip(batch.column(mark_bits).to_pylist(),
                                                      batch.column(item_list).to_pylist(), strict=True)):
                    hit[first[r]:first[r + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n[r])).astype(bool)
                    listed[r].update(known)
            total = np.concatenate([[0], np.cumsum(hit)])
            out = {c: batch.column(c) for c in columns} | {
                n_words: pa.array(n, pa.int64()), n_hits: pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
                item_list: pa.array([sorted(x) for x in listed], pa.list_(pa.string()))}
            if keep:
                out[mark_bits] = pa.array([np.packbits(hit[first[r]:first[r + 1]]).tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
    return run


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
           item_text: str = "text", window: int = WINDOW, block_bytes: int = PATTERN_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, and their names: words, hit words, item ids (sorted as strings).

    With several pattern blocks each pass merges its marks (one bit per word) with those before.
    """
    own = fresh(docs.columns, "_words", "_hits", "_items", "_marks")
    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes), *(f"`{c}` {k}" for c, k in zip(
        own, ("long", "long", "array<string>"), strict=False))])
    out, blocks = docs, item_blocks(benchmark, item_id, item_text, block_bytes)
    for b, block in enumerate(blocks):
        items = [(r["item_id"], r["text"]) for r in block.collect()]  # about block_bytes of text at most
        more = b < len(blocks) - 1
        run = _marker(patterns(items, window), [name for name, _ in items], docs.columns, own, text, b > 0, more)
        out = out.mapInArrow(run, schema + f", `{own[3]}` binary" * more)
        if more:
            out = written(out, "marked")
    return out, own[:3]


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
           block_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, items, contaminated``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found, (n_words, n_hits, items) = marked(src, benchmark, block_bytes=block_bytes)
    return found.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_hits).alias("n_hit"),
                        F.col(items).alias("items"), (F.col(n_hits) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      block_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The rows without a hit word, with all their columns."""
    found, (_, n_hits, _) = marked(docs, benchmark, text, block_bytes=block_bytes)
    return found.filter(F.col(n_hits) == 0).select(*docs.columns)
