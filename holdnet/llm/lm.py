"""Interpolated modified Kneser-Ney model of order 2 or 3: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Counting.  1. Tasks count their words' 64-bit hashes; shards of the hash range
merge them into sorted arrays; a word's id is its place in all of them.
2. Tasks count pairs (previous id, id); shards merge them into sorted key
arrays.  A pair's shard depends on the previous word, and for a frequent one
also on the next, so no word makes a shard large.  Each shard reports, per
word, how many successors occur once, twice and more, and how many words
precede it.  3. Those reports are added up per shard of word ids.
With order 3, triples (pair before, id) are counted between 2. and 3.: a triple's
shard depends on the pair before, and for a frequent one also on the next word.
A shard keeps 64-bit hashes of its triples; it reports, per pair before, how many
successors occur once, twice and more, and how many different words precede a
pair.  The pairs' shards keep both beside their pairs; the latter take the place
of the pairs' own counts in 3. (pairs after the start mark have nothing before
them and keep their own).
Shards grow in number with the text (``SHARD_BYTES`` each), not in size.

The arrays are .npy files in the shared folder, counts with a byte each (those of
255 and more lie beside them); a step's shuffle is dropped as it ends.  Scoring tasks memory-map them
and look up a slice's different words and pairs in sorted order; nothing of the
model is broadcast.  (Where the shared folder is not a mounted path, a shard is
read whole through its file system instead.)

Tokens: A-Z lower-cased, runs without ASCII white space, then one end.  P(w | v)
= (c(vw) - D) / c(v) + weight(v) P1(w), where P1 is the same kind of estimate
from the number of different words before w, interpolated with 1 / (V + 1); the
three discounts of each level come from its counts of counts.  With order 3,
P(w | u v) = (c(uvw) - D) / c(uv) + weight(uv) P(w | v) with c(vw) as above.  The
first word's context is one start mark; an unknown context backs off with weight 1.

Defined results: null and empty texts are the end alone; a null id is trained
on; rows that share an id are documents of their own; without training tokens
every score is 0; empty tables give empty results; other columns are ignored.
Ids are 32 bit: more than 2^32 - 2 different words are refused.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import (LOWER, NOT_WHITE, mix, shared_folder, span_hashes, text_bytes, text_slices, word_spans,
                                written)
from holdnet.session import shuffles_dropped

END = np.uint64(0x0123456789ABCDEF)
#: Order of the query's model.
ORDER = 3
SHARD_BYTES = 16 << 20
#: Entries that a task merges before it hands them on.
HELD = 4_000_000
HELD_TRIPLES = 2_000_000
#: Counts from here on do not fit a byte, and the files that hold counts.
MANY = 255
COUNTED = {"count", "times", "pair_left", "triple_times", "after", "stats"}
_U32 = np.uint64(32)


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- files ------------------------------------------------------------------------------------------

def _local(path: str) -> str | None:
    """The path in the file system, if the folder is mounted."""
    if re.match(r"file:/+|/", path):
        return re.sub(r"^file:/+", "/", path)
    return None


def save_bytes(folder: str, name: str, data: bytes) -> None:
    """Write a file as a whole or not at all; a repeated task writes the same bytes again."""
    if local := _local(folder):
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{local}/{name}")
        return
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def save(folder: str, name: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, array)
    save_bytes(folder, f"{name}.npy", out.getvalue())


def load(folder: str, name: str) -> np.ndarray:
    if local := _local(folder):
        return np.load(f"{local}/{name}.npy", mmap_mode="r")
    fs, path = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}.npy") as f:
        return np.load(f)


def packed(sorted_values: np.ndarray) -> bytes:
    """Differences of ascending unsigned values, byte plane by byte plane (the shuffle's compression likes that)."""
    v = sorted_values.astype("<u8")
    return np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def save_counts(folder: str, name: str, shard: int, counts: np.ndarray) -> None:
    """A byte per count; counts of ``MANY`` and more, with their places in the flat array, go to a second file."""
    flat = counts.ravel()
    many = np.flatnonzero(flat >= MANY)
    save(folder, f"{name}-{shard}", np.minimum(counts, MANY).astype(np.uint8))
    save(folder, f"{name}_many-{shard}", np.stack([many.astype(np.uint64), flat[many].astype(np.uint64)]))


class Counts:
    """The counts that :func:`save_counts` wrote, read at given rows."""

    def __init__(self, low: np.ndarray, many: np.ndarray):
        self.low, self.many = low, many

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.array(self.low[rows], np.int64)
        flat, width = out.reshape(-1), self.low[:1].size
        at = np.flatnonzero(flat == MANY)
        if len(at):
            flat[at] = self.many[1][np.searchsorted(self.many[0], (rows[at // width] * width + at % width).astype(np.uint64))]
        return out


# ---- tokens -----------------------------------------------------------------------------------------

def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, first token of every row and the end); each row ends with END."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, NOT_WHITE)
    h = span_hashes(raw, starts, ends)
    at = first[1:] + np.arange(len(first) - 1)  # where each row's end goes
    out = np.empty(len(h) + len(at), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[at] = True
    out[is_end], out[~is_end] = END, h
    return out, np.concatenate([[0], at + 1])


class _Held:
    """Counts gathered by a task; given out per shard in blobs."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n >= HELD and len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.n = len(self.parts[0][0])
        return self.n >= HELD

    def blobs(self, shard_of):
        if not self.parts:
            return
        keys, counts = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.n = [], 0
        shard = shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        for s, lo, hi in _runs(shard):
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([packed(keys[lo:hi])], pa.binary()),
                 pa.array([planes(counts[lo:hi])], pa.binary())], names=["shard", "keys", "counts"])


BLOBS = "shard int, keys binary, counts binary"


def _merged(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([unpacked(x) for x in t.column("keys").to_pylist()])
    counts = np.concatenate([unplanes(x) for x in t.column("counts").to_pylist()])
    return t.column("shard")[0].as_py(), *summed(keys, counts)


# ---- words ------------------------------------------------------------------------------------------

@dataclass
class Words:
    """Sorted word hashes by shard of the hash range; ids number them through."""
    folder: str
    bits: int
    sizes: list[int]
    total: int  # training tokens
    docs: int = 0  # training texts
    there: dict[str, list[int]] = field(default_factory=dict)  # file name -> shards that have one
    files: dict = field(default_factory=dict)

    def __post_init__(self):
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.n = int(self.offsets[-1])

    def __reduce__(self):
        return Words, (self.folder, self.bits, self.sizes, self.total, self.docs, self.there)

    def file(self, name: str, shard: int) -> np.ndarray | Counts:
        """A shard's array, memory-mapped; empty if the shard has none."""
        if (name, shard) not in self.files:
            found = load(self.folder, f"{name}-{shard}") if shard in self.there[name] else np.zeros(0, np.uint64)
            if name in COUNTED and shard in self.there[name]:
                found = Counts(found, load(self.folder, f"{name}_many-{shard}"))
            self.files[name, shard] = found
        return self.files[name, shard]

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of every hash."""
        uniq, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(uniq), -1, np.int64), np.zeros(len(uniq), np.int64)
        for s, lo, hi in _runs(self.shard_of(uniq)):
            known = self.file("word", s)
            if len(known):
                at = np.minimum(np.searchsorted(known, uniq[lo:hi]), len(known) - 1)
                ok = known[at] == uniq[lo:hi]
                ids[lo:hi] = np.where(ok, at + self.offsets[s], -1)
                counts[lo:hi] = np.where(ok, self.file("count", s)[at], 0)
        return ids[back], counts[back]


    def _gather(self, ids: np.ndarray, name: str, width: int, absent: int) -> np.ndarray:
        """Rows of the files ``name`` at the ids (-1: zeros; words.n: the start mark, ``absent`` or the last row)."""
        uniq, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(uniq), width), np.int64)
        shard = np.minimum(np.searchsorted(self.offsets, uniq, "right") - 1, (1 << self.bits) - 1)
        for s, lo, hi in _runs(shard):
            if s >= 0:
                at = uniq[lo:hi] - self.offsets[s]
                file = self.file(name, s)
                there = at < len(file)
                out[lo:hi][there] = np.asarray(file[at[there]]).reshape(-1, width)
                out[lo:hi][~there] = absent
        return out[back]

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Training count of every id: of the start mark the number of training texts."""
        return self._gather(ids, "count", 1, self.docs)[:, 0]

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """Per id: successors seen once, twice, more, different words before it, and the sum of the successors' counts."""
        return self._gather(ids, "stats", len(KINDS), 0)


def _runs(ascending: np.ndarray):
    """(value, first place, place after the last) of every run of equal values."""
    names, at = np.unique(ascending, return_index=True)
    bounds = [*at.tolist(), len(ascending)]
    yield from zip(names.tolist(), bounds[:-1], bounds[1:], strict=True)


def count_words(docs: DataFrame, folder: str, bits: int) -> Words:
    def run(batches):
        held = _Held()
        shard_of = Words(folder, bits, [], 0).shard_of
        for b in text_slices(batches):
            if held.add(*_counted(tokens(b.column("text"))[0])):
                yield from held.blobs(shard_of)
        yield from held.blobs(shard_of)

    def merge(t: pa.Table) -> pa.Table:
        s, keys, counts = _merged(t)
        save(folder, f"word-{s}", keys)
        save_counts(folder, "count", s, counts)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()),
                         "total": pa.array([int(counts.sum())], pa.int64()),
                         "ends": pa.array([int(counts[keys == END].sum())], pa.int64())})

    found = (docs.select("text").mapInArrow(run, BLOBS).repartition(1 << bits, "shard").groupBy("shard")
             .applyInArrow(merge, "shard int, n long, total long, ends long")).collect()  # one row per shard
    sizes = [0] * (1 << bits)
    for r in found:
        sizes[r.shard] = r.n
    words = Words(folder, bits, sizes, sum(r.total for r in found), sum(r.ends for r in found),
                  dict.fromkeys(("word", "count"), [r.shard for r in found]))
    if words.n > 2**32 - 2:
        raise ValueError("more different words than 32-bit ids")
    return words


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


# ---- pairs ------------------------------------------------------------------------------------------

def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (before.astype(np.uint64) << _U32) | ids.astype(np.uint64)


def halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> _U32).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(words: Words, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: id or -1, training count, and the id before it (words.n at a row's start, -1 if unknown)."""
    ids, counts = words.find(h)
    before = np.concatenate([[-1], ids[:-1]])
    before[first[:-1]] = words.n
    return ids, counts, before


def pair_shard(keys: np.ndarray, words: Words) -> np.ndarray:
    """Shard of ascending pairs: by the word before, and after a frequent one also by a part of the next word's hash."""
    before, ids = halves(keys)
    parts = words.counts_of(before) * (1 << words.bits) // max(1, 2 * words.total) + 1
    salt = mix(ids.astype(np.uint64)) % parts.astype(np.uint64)
    return (mix(before.astype(np.uint64) * np.uint64(0x9E3779B1) + salt) % np.uint64(1 << words.bits)).astype(np.int64)


REPORTS = "shard int, kind string, keys binary, counts binary, tally array<long>"


def _reports(words: Words, s: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Of a shard's pairs, per word, how many successors occur once, twice or more (``one, two, more``), the sum of their
    counts (``sum``) and how many words precede it (``left``); ``tally`` counts pairs of counts 1 to 4."""
    before, ids = halves(keys)
    counts = counts.astype(np.int64)
    heads, first = np.unique(before, return_index=True)
    sums = [np.add.reduceat(x, first) for x in ((counts == 1).astype(np.int64), (counts == 2).astype(np.int64),
                                                (counts > 2).astype(np.int64), counts)]
    tails, left = np.unique(ids, return_counts=True)
    rows = []
    for kind, names, values in zip(KINDS, (heads, heads, heads, tails, heads), (*sums[:3], left, sums[3]), strict=True):
        names, values = names[values > 0], values[values > 0]
        to = np.minimum(np.searchsorted(words.offsets, names, "right") - 1, (1 << words.bits) - 1)
        for target, lo, hi in _runs(to):
            rows.append((target, kind, packed(names[lo:hi]), planes(values[lo:hi]), None))
    return _report_table([*rows, (s, None, None, None, [int((counts == k).sum()) for k in range(1, 5)])])


def _report_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["shard", "kind", "keys", "counts", "tally"])


def count_pairs(docs: DataFrame, words: Words, report: bool = True) -> DataFrame:
    """Writes the pair shards; gives their reports (without ``report`` only which shards there are)."""
    def run(batches):
        held = _Held()

        def shard_of(keys):
            return pair_shard(keys, words)

        for b in text_slices(batches):
            ids, _, before = contexts(words, *tokens(b.column("text")))
            if held.add(*_counted(pair_keys(before, ids))):
                yield from held.blobs(shard_of)
        yield from held.blobs(shard_of)

    def merge(t: pa.Table) -> pa.Table:
        s, keys, counts = _merged(t)
        save(words.folder, f"pair-{s}", keys)
        save_counts(words.folder, "times", s, counts)
        return _reports(words, s, keys, counts) if report else _report_table([(s, None, None, None, [0] * 4)])

    found = docs.select("text").mapInArrow(run, BLOBS).repartition(1 << words.bits, "shard").groupBy("shard").applyInArrow(
        merge, REPORTS)
    return written(found, "reports")


def known_pairs(words: Words, before: np.ndarray, ids: np.ndarray, name: str) -> np.ndarray:
    """The pair's value in the files ``name``; 0 where an id is unknown (-1) or the pair is."""
    out = np.zeros(len(ids), np.int64)
    known = np.flatnonzero((before >= 0) & (ids >= 0))
    keys, back = np.unique(pair_keys(before[known], ids[known]), return_inverse=True)
    if len(keys):
        out[known] = _looked_up(words, keys, pair_shard(keys, words), "pair", name, 1)[back, 0]
    return out


def _looked_up(words: Words, keys: np.ndarray, shard: np.ndarray, names: str, values: str, width: int) -> np.ndarray:
    """Rows of the files ``values`` at the keys' places in the files ``names`` of their shards; 0 for absent keys."""
    order = np.argsort(shard, kind="stable")
    got = np.zeros((len(keys), width), np.int64)
    for s, lo, hi in _runs(shard[order]):
        want, there = keys[order[lo:hi]], words.file(names, s)
        if not len(there):
            continue
        at = np.minimum(np.searchsorted(there, want), len(there) - 1)
        ok = there[at] == want
        got[order[lo:hi][ok]] = np.asarray(words.file(values, s)[at[ok]]).reshape(-1, width)
    return got


# ---- triples ----------------------------------------------------------------------------------------

def triple_keys(pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """64-bit hash of the pair before and the id."""
    return mix(mix(pairs) + ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def triple_parts(times: np.ndarray, words: Words) -> np.ndarray:
    """Parts that the successors of a pair of this training count are dealt to."""
    return times * (1 << words.bits) // max(1, 2 * words.total) + 1


def triple_shard(pairs: np.ndarray, salt: np.ndarray, words: Words) -> np.ndarray:
    return (mix(mix(pairs) + salt.astype(np.uint64)) % np.uint64(1 << words.bits)).astype(np.int64)


def salt_of(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64)) % parts.astype(np.uint64)


def second_before(before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per token the id two places before it (-1 for a row's first token)."""
    out = np.concatenate([[-1], before[:-1]])
    out[first[:-1]] = -1
    return out


def _triples_summed(pairs: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, pairs))
    pairs, ids, counts = pairs[order], ids[order], counts[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (ids[1:] != ids[:-1])
    first = np.flatnonzero(new)
    return pairs[first], ids[first], np.add.reduceat(counts, first) if len(first) else counts


TRIPLES = "shard int, pairs binary, ids binary, counts binary"


def count_triples(docs: DataFrame, words: Words) -> DataFrame:
    """Writes the triple shards; gives, per pair shard, how many successors of a pair occur once, twice and more and how
    many different words precede it (blobs with a null ``tally``), and per triple shard the ``tally`` of triples of
    counts 1 to 4."""
    def blobs(parts):
        pairs, ids, counts = _triples_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        heads, at = np.unique(pairs, return_inverse=True)
        spread = triple_parts(known_pairs(words, *halves(heads), "times"), words)[at]
        shard = triple_shard(pairs, salt_of(ids, spread), words)
        order = np.argsort(shard, kind="stable")
        pairs, ids, counts, shard = pairs[order], ids[order], counts[order], shard[order]
        for s, lo, hi in _runs(shard):
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([packed(pairs[lo:hi])], pa.binary()),
                 pa.array([planes(ids[lo:hi])], pa.binary()), pa.array([planes(counts[lo:hi])], pa.binary())],
                names=["shard", "pairs", "ids", "counts"])

    def run(batches):
        held, n = [], 0
        for b in text_slices(batches):
            h, first = tokens(b.column("text"))
            ids, _, before = contexts(words, h, first)
            second = second_before(before, first)
            at = np.flatnonzero(second >= 0)
            held.append((pair_keys(second[at], before[at]), ids[at].astype(np.uint32), np.ones(len(at), np.uint32)))
            n += len(at)
            if n >= HELD_TRIPLES:
                yield from blobs(held)
                held, n = [], 0
        if n:
            yield from blobs(held)

    def merge(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        pairs, ids, counts = _triples_summed(
            np.concatenate([unpacked(x) for x in t.column("pairs").to_pylist()]),
            np.concatenate([unplanes(x) for x in t.column("ids").to_pylist()]),
            np.concatenate([unplanes(x) for x in t.column("counts").to_pylist()]).astype(np.uint64))
        keys = triple_keys(pairs, ids)
        order = np.argsort(keys)
        save(words.folder, f"triple-{s}", keys[order])
        save_counts(words.folder, "triple_times", s, counts[order])
        del keys, order
        tails = pair_keys(halves(pairs)[1], ids)
        rows = []
        for kind, of in (("one", pairs[counts == 1]), ("two", pairs[counts == 2]), ("more", pairs[counts > 2]), ("left", tails)):
            names, n = np.unique(of, return_counts=True)
            to = pair_shard(names, words)
            by = np.argsort(to, kind="stable")
            rows += [(target, kind, packed(names[by[lo:hi]]), planes(n[by[lo:hi]]), None) for target, lo, hi in _runs(to[by])]
        return _report_table([*rows, (s, None, None, None, [int((counts == k).sum()) for k in range(1, 5)])])

    found = docs.select("text").mapInArrow(run, TRIPLES).repartition(1 << words.bits, "shard").groupBy("shard").applyInArrow(merge, REPORTS)
    return written(found, "triples")


PAIR_BLOBS = "shard int, kind string, keys binary, counts binary"


def count_left(lefts: DataFrame, words: Words) -> DataFrame:
    """Writes, beside every pair shard, its pairs' successors that occur once, twice and more and the different words
    before a pair (its count after the start mark); gives the reports of the latter."""
    def merge(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        pairs = np.array(words.file("pair", s))
        found = {kind: np.zeros(len(pairs), np.uint64) for kind in KINDS[:4]}
        there = t.filter(t.column("keys").is_valid())
        for kind, keys, counts in zip(*(there.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
            found[kind][np.searchsorted(pairs, unpacked(keys))] += unplanes(counts)  # a blob's pairs are different
        left, first = found["left"], np.flatnonzero(halves(pairs)[0] == words.n)
        left[first] = words.file("times", s)[first]
        save_counts(words.folder, "pair_left", s, left)
        save_counts(words.folder, "after", s, np.stack([found[kind] for kind in KINDS[:3]], axis=1))
        return _reports(words, s, pairs, left)

    # every shard has a row, also one whose pairs all follow the start mark
    every = lefts.sparkSession.createDataFrame(
        [(s, "left", None, None) for s in words.there["pair"]], PAIR_BLOBS)
    found = (lefts.filter("tally is null").select("shard", "kind", "keys", "counts").unionByName(every)
             .repartition(1 << words.bits, "shard").groupBy("shard").applyInArrow(merge, REPORTS))
    return written(found, "lefts")


def discounts(n: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4, each kept within 0 and its count."""
    if not n[0]:
        return [0.0, 0.0, 0.0]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) if n[k - 1] else 0.0 for k in (1, 2, 3)]


@dataclass
class Model:
    """Words, pairs and successor statistics in files, and a few totals."""
    words: Words
    pair_discounts: list[float]
    word_discounts: list[float]
    left_total: int  # different pairs
    left_classes: list[int]  # words preceded by one, two and more different words
    triple_discounts: list[float] | None = None  # with order 3

    def after_pairs(self, second: np.ndarray, before: np.ndarray, ids: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities given two words, from ``p``, those given one."""
        w, p = self.words, p.copy()
        total = known_pairs(w, second, before, "times")
        known = np.flatnonzero(total > 0)
        if not len(known):
            return p
        pairs, ids, total = pair_keys(second[known], before[known]), ids[known], total[known]
        parts = triple_parts(total, w)
        times = np.zeros(len(known), np.int64)
        there = np.flatnonzero(ids >= 0)
        keys, one, back = np.unique(triple_keys(pairs[there], ids[there]), return_index=True, return_inverse=True)
        if len(keys):
            at = there[one]
            shard = triple_shard(pairs[at], salt_of(ids[at], parts[at]), w)
            times[there] = _looked_up(w, keys, shard, "triple", "triple_times", 1)[back, 0]
        heads, back = np.unique(pairs, return_inverse=True)
        after = _looked_up(w, heads, pair_shard(heads, w), "pair", "after", 3)
        cut = np.array([0.0, *self.triple_discounts])[np.minimum(times, 3)]
        p[known] = (times - cut + (after[back] @ np.array(self.triple_discounts)) * p[known]) / total
        return p

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score (log10)."""
        h, first = tokens(texts)
        w = self.words
        rows = first[:-1]
        ids, counts, before = contexts(w, h, first)
        base = np.log10((counts + 1) / (w.total + w.n + 1))
        n = np.diff(first)
        out = {"n_tokens": n, "n_known": np.add.reduceat((counts > 0).astype(np.int64), rows) if len(rows) else n,
               "base_score": np.add.reduceat(base, rows) if len(rows) else base, "score": np.zeros(len(rows))}
        if not w.total or not len(rows):
            return out
        left = w.stats(ids)[:, KINDS.index("left")]
        cut = np.array([0.0, *self.word_discounts])[np.minimum(left, 3)]
        spread = sum(d * k for d, k in zip(self.word_discounts, self.left_classes, strict=True))
        p = (left - cut + spread / (w.n + 1)) / self.left_total
        times = known_pairs(w, before, ids, "pair_left" if self.triple_discounts else "times")
        after = w.stats(before)
        after, total = after[:, :3], after[:, KINDS.index("sum")]
        cut = np.array([0.0, *self.pair_discounts])[np.minimum(times, 3)]
        p = np.where(total > 0, (times - cut + (after @ np.array(self.pair_discounts)) * p) / np.maximum(total, 1), p)
        if self.triple_discounts:
            p = self.after_pairs(second_before(before, first), before, ids, p)
        out["score"] = np.add.reduceat(np.log10(p), rows)
        return out


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES, order: int = 2) -> Model:
    """Fit on all rows of ``docs`` (column ``text``): counting jobs whose reports, not n-grams, reach the driver."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    with shuffles_dropped(docs.sparkSession):  # what a step leaves is in files
        return _trained(docs, shard_bytes, order)


def _trained(docs: DataFrame, shard_bytes: int, order: int) -> Model:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = count_words(docs, shared_folder(spark, "lm"), max(0, int(size) // shard_bytes).bit_length())
    reports, triple_discounts = count_pairs(docs, words, order == 2), None
    shards = [r.shard for r in reports.filter("tally is not null").select("shard").collect()]  # one row per shard
    words.there |= dict.fromkeys(("pair", "times"), shards)
    if order == 3:
        lefts = count_triples(docs, words)
        found = lefts.filter("tally is not null").select("shard", "tally").collect()  # one row per shard
        triple_discounts = discounts([sum(r.tally[k] for r in found) for k in range(4)])
        words.there |= dict.fromkeys(("triple", "triple_times"), [r.shard for r in found])
        reports = count_left(lefts, words)
        words.there |= dict.fromkeys(("pair_left", "after"), shards)
    tallies = reports.filter("tally is not null").select("shard", "tally").collect()  # one row per shard
    pair_n = [sum(r.tally[k] for r in tallies) for k in range(4)]

    def add_up(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        last = s == (1 << words.bits) - 1
        out = np.zeros((words.sizes[s] + last, len(KINDS)), np.int64)  # the last shard also holds the start mark
        for kind, keys, counts in zip(*(t.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
            out[unpacked(keys).astype(np.int64) - words.offsets[s], KINDS.index(kind)] += unplanes(counts)
        save_counts(words.folder, "stats", s, out)
        left = out[:, KINDS.index("left")]
        return pa.table({"shard": pa.array([s], pa.int32()), "left": pa.array([[int((left == k).sum()) for k in range(1, 5)] + [int((left > 2).sum()), int(left.sum())]],
                                          pa.list_(pa.int64()))})

    sums = (reports.filter("kind is not null").repartition(1 << words.bits, "shard").groupBy("shard")
            .applyInArrow(add_up, "shard int, left array<long>")).collect()  # one row per shard
    left = [sum(r.left[k] for r in sums) for k in range(6)]
    words.there |= {"stats": [r.shard for r in sums]}
    return Model(words, discounts(pair_n), discounts(left[:4]), left[5], [left[0], left[1], left[4]], triple_discounts)


KINDS = ("one", "two", "more", "left", "sum")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``."""
    def run(batches):
        for b in text_slices(batches):
            found = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = src.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(model.words.total).cast("long"))
