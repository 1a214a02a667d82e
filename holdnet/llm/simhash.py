"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 meet in a variant one flip away from both, so
radius 2 needs only the variants within half of it (64 flips and the value
itself).  The odd third bit is met by dropping one of ``PARTS`` bit ranges in
turn: of three differing bits at least one lies in some range, and the rest of
the fingerprint differs in at most two.  So every distinct fingerprint emits,
per dropped range, the kept bits and all their one-bit flips; equal variants
are brought together by one shuffle, and pairs that collide are verified on all
64 bits.  A bucket gives only a spanning forest of its links (never all pairs),
so its output is linear in its members; exact copies are one fingerprint.

Defined results: a null or empty text has fingerprint zero, linked like any
other; rows with equal ids stay rows of their own; a null id never names a
component (a component without any id has a null id); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import fresh, text_slices, written
from holdnet.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Bit ranges of which one is dropped at a time: (first bit, bits).
PARTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64 (repeats included)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 4096):
        bits = np.unpackbits(h[lo:lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row; fp is the fingerprint as a signed long."""
    def run(batches):
        for b in text_slices(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def variants(fp: np.ndarray) -> np.ndarray:
    """Keys (dropped range, kept bits with at most one flip) of every fingerprint: one row each."""
    cols = []
    for part, (first, bits) in enumerate(PARTS):
        low = fp & np.uint64((1 << first) - 1)
        high = (fp >> np.uint64(first + bits)) << np.uint64(first)
        kept, size = low | high, 64 - bits
        flips = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(size, dtype=np.uint64))]).astype(np.uint64)
        cols.append((kept[:, None] ^ flips[None, :]) | (np.uint64(part) << np.uint64(62)))
    return np.concatenate(cols, axis=1)


def _emit(batches):
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fps), 2000):
            part = fps[lo:lo + 2000]
            keys = variants(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)),
                                              pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], names=["k", "fp"])


def forest(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the members exactly as all links between them would: one breadth-first search, each
    found member compared with those not yet found."""
    links = []
    rest = members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                links += [(at, x) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _links(radius: int):
    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solve(k, f):
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(first, len(k)))
            two = first[size == 2]
            a, b = f[two], f[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            pairs = [np.stack([a[near], b[near]], axis=1)]
            for lo, n in zip(first[size > 2], size[size > 2], strict=True):
                if found := forest(f[lo:lo + n], radius):
                    pairs.append(np.array(found, dtype=np.uint64))
            uv = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

        for b in batches:
            k = np.concatenate([held_k, b.column("k").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last bucket may go on in the next batch
            held_k, held_f = k[cut:], f[cut:]
            if cut:
                yield solve(k[:cut], f[:cut])
        if len(held_k):
            yield solve(held_k, held_f)
    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that connect them as all pairs within ``radius`` would."""
    if radius != 3:
        raise ValueError("the dropped ranges and one-flip variants are laid out for radius 3")
    keyed = fps.select("fp").mapInArrow(_emit, "k long, fp long").repartition("k").sortWithinPartitions("k")
    return keyed.mapInArrow(_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """Per row: ``doc_id, fp, root, component_id``: the id is the smallest reachable over links of at most ``radius``
    bits, the root the smallest fingerprint of the component (as a signed long)."""
    marked = written(fingerprints(docs, id_col, text, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes, radius))
    rooted = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    of_fp = written(rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "components")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """The document that names each component, with all its columns; of rows with that same id one stays.

    Of a component in which no row has an id, one row of its smallest fingerprint stays.
    """
    found = written(near_duplicates(docs, id_col, text, shingle, radius), "near-duplicates")
    keep = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    kept = docs.join(keep.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    if not keep.filter("_rows > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    nameless = found.filter("component_id is null").groupBy("root").agg(F.min("fp").alias("fp")).select("fp")
    if not nameless.isEmpty():
        own, = fresh(docs.columns, "_fp")
        mark = F.udf(lambda t: int(np.uint64(fingerprint(t, shingle)).view(np.int64)), "long")
        lost = docs.filter(F.col(id_col).isNull()).withColumn(own, mark(F.col(text)))
        lost = lost.join(nameless.withColumnRenamed("fp", own), own, "left_semi").dropDuplicates([own])
        kept = kept.unionByName(lost.select(*docs.columns))
    return kept.select(*docs.columns)
