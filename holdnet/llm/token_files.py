"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Ids come in ascending order of their documents.  A block of ``BLOCK`` ids starts
from an empty model.  Orders 2 and 1 each predict the id last seen after their
context, with a confidence of 0 to 3; the pair of confidences selects a mixing
cell whose adaptive counts weigh order 2, order 1 and order 0 against each other.
Order 0 gives an adaptive distribution over ``len(CLASSES)`` classes of ids and
codes the rest of the id evenly.  These probabilities drive a range coder of 32
bits with 16-bit output.  All blocks of a group are coded in step, one lane per
block, as numpy arrays; carries are added up at the end.

File: magic, then groups.  A group: header (documents, ids, blocks, sizes of its
two parts, CRC-32 of the first), the document table (ids of the documents, null
marks, lengths; deflated), per block (ids, payload bytes, CRC-32 of the payload),
payloads.  Files are written whole or not at all and read with Spark's binary
file reader, so any file system that Spark knows will do for reading.

Defined results: a null or empty text is the end id alone; documents of one id,
also a null one (first), are ordered by a hash of the text, then by the text;
an empty table gives no document; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdnet.llm.common import shared_folder, text_slices
from holdnet.llm.encoding import encoder
from holdnet.llm.lm import save_bytes

END_ID = 1
BLOCK = 4096
#: Ids that a task codes at a time, and text bytes per file aimed at.
GROUP_IDS = 12_000_000
PART_BYTES = 16 << 20
MAGIC = b"TOKIDS1\n"
HEAD = struct.Struct("<QQIQQI")
ORDER2, ORDER1 = 4096, 1024
CELL_STEP, CELL_LIMIT = 24, 1 << 11
CLASS_STEP, CLASS_LIMIT = 24, 1 << 12


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, evenly coded bits and rest of every id, and the first id of every class: four classes per power of two."""
    ids = np.arange(1 << 16)
    top = np.floor(np.log2(np.maximum(ids, 1))).astype(np.int64)
    bits = np.where(ids < 4, 0, top - 2)
    cls = np.where(ids < 4, ids, 4 * (top - 1) + ((ids >> bits) & 3))
    return cls, bits, ids & ((1 << bits) - 1), np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))


CLASS_OF, BITS_OF, REST_OF, CLASSES = _classes()
CLASS_BITS = BITS_OF[CLASSES].astype(np.uint32)
BITS_OF, REST_OF = BITS_OF.astype(np.uint32), REST_OF.astype(np.uint32)


#: Counts of a mixing cell share one word: order 2 in the low 16 bits, then order 1, then order 0.
CELL_START = np.uint64(2 | 2 << 16 | 4 << 32)
CELL_STEPS = np.array([CELL_STEP, CELL_STEP << 16, CELL_STEP << 32], np.uint64)
CELL_ONES, CELL_HALF = np.uint64(1 | 1 << 16 | 1 << 32), np.uint64(0x7FFF7FFF7FFF)
#: What a class adds to the running counts (row: class; columns: counts below each class, and all).
CLASS_STEPS = (np.arange(len(CLASSES) + 1)[None, :] > np.arange(len(CLASSES))[:, None]).astype(np.uint16) * CLASS_STEP


class Mixer:
    """The models of all lanes; lane k may stop early, so every call is for the first ``n`` lanes."""

    def __init__(self, lanes: int):
        self.order2 = np.zeros(lanes * ORDER2, np.uint32)  # id + 1 in the upper bits, confidence in the lower two
        self.order1 = np.zeros(lanes * ORDER1, np.uint32)
        self.at2, self.at1 = np.arange(lanes) * ORDER2, np.arange(lanes) * ORDER1
        self.cells = np.full(lanes * 32, CELL_START, np.uint64)
        self.at_cell = np.arange(lanes) * 32
        self.below = np.tile(np.arange(len(CLASSES) + 1, dtype=np.uint16), (lanes, 1))  # running counts of the classes
        self.last1 = np.zeros(lanes, np.int64)
        self.last2 = np.zeros(lanes, np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running counts of order 2, of orders 2 and 1, and of all three."""
        one, two = self.last1[:n], self.last2[:n]
        self.i2 = self.at2[:n] + (((two * 40503 + one) * 2654435761 >> 9) & (ORDER2 - 1))
        self.i1 = self.at1[:n] + ((one * 2654435761 >> 7) & (ORDER1 - 1))
        self.v2, self.v1 = self.order2[self.i2], self.order1[self.i1]
        self.x2, self.x1 = self.v2 >> 2, self.v1 >> 2
        self.c2, self.c1 = self.v2 & 3, self.v1 & 3
        self.cell = self.at_cell[:n] + (self.c2 << 2 | self.c1) + ((self.x1 == self.x2) << 4)
        self.counts = self.cells[self.cell]
        first = (self.counts & np.uint64(0xFFFF)).astype(np.uint32)
        second = first + ((self.counts >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint32)
        return first, second, second + (self.counts >> np.uint64(32)).astype(np.uint32)

    def learn(self, n: int, ids: np.ndarray, which: np.ndarray, total: np.ndarray) -> None:
        counts = self.counts + CELL_STEPS[which]
        self.cells[self.cell] = np.where(total > CELL_LIMIT, ((counts + CELL_ONES) >> np.uint64(1)) & CELL_HALF, counts)
        y = ids.astype(np.uint32) + np.uint32(1)
        new = y << 2
        self.order2[self.i2] = new | np.minimum(self.c2 + 1, 3) * (self.x2 == y)
        self.order1[self.i1] = new | np.minimum(self.c1 + 1, 3) * (self.x1 == y)
        self.last2[:n] = self.last1[:n]
        self.last1[:n] = ids

    def learn_class(self, lanes: np.ndarray, cls: np.ndarray, total: np.ndarray) -> None:
        self.below[lanes] += CLASS_STEPS[cls]
        if len(full := lanes[total > CLASS_LIMIT]):  # halve, keeping every class at one or more
            self.below[full] = (self.below[full] + np.arange(len(CLASSES) + 1, dtype=np.uint16)) >> 1


class RangeEncoder:
    def __init__(self, lanes: int, words: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFF, np.uint32)
        self.pos = np.zeros(lanes, np.int64)
        self.out = np.zeros((max(words, 4), lanes), np.uint32)  # words with their carries, added up in the end

    def reserve(self, words: int) -> None:
        """Room for that many more words in every lane."""
        if (need := int(self.pos.max()) + words) > len(self.out):
            self.out = np.concatenate([self.out, np.zeros((need - len(self.out) + len(self.out) // 4, self.out.shape[1]), np.uint32)])

    def put(self, lanes, cum: np.ndarray, freq: np.ndarray, total: np.ndarray) -> None:
        part = self.range[lanes] // total
        self.low[lanes] += part * cum
        self._shrink(lanes, part * freq)

    def put_bits(self, lanes, value: np.ndarray, bits: np.ndarray) -> None:
        part = self.range[lanes] >> bits
        self.low[lanes] += part * value
        self._shrink(lanes, part)

    def _shrink(self, lanes, size: np.ndarray) -> None:
        thin = np.flatnonzero(size < 0x10000)
        if len(thin):
            size[thin] <<= np.uint32(16)
            self._emit(thin if isinstance(lanes, slice) else lanes[thin])
        self.range[lanes] = size

    def _emit(self, lanes: np.ndarray) -> None:
        at, low = self.pos[lanes], self.low[lanes]
        self.out[at, lanes] = low >> np.uint64(16)
        self.pos[lanes] = at + 1
        self.low[lanes] = (low & np.uint64(0xFFFF)) << np.uint64(16)

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.pos))
        self.reserve(2)
        self._emit(every)
        self._emit(every)
        for p in range(int(self.pos.max()) - 1, 0, -1):
            self.out[p - 1] += self.out[p] >> 16
        lanes = np.ascontiguousarray(self.out[:int(self.pos.max())].astype("<u2").T)
        return [lanes[k, :n].tobytes() for k, n in enumerate(self.pos.tolist())]


class RangeDecoder:
    def __init__(self, payloads: list[bytes]):
        words = max((len(p) for p in payloads), default=0) // 2 + 4
        grid = np.zeros((len(payloads), words), "<u2")
        for k, p in enumerate(payloads):
            grid[k, :len(p) // 2] = np.frombuffer(p, "<u2")
        self.words = np.ascontiguousarray(grid.T)
        self.range = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
        self.value = (self.words[0].astype(np.uint32) << np.uint32(16)) | self.words[1]
        self.pos = np.full(len(payloads), 2, np.int64)

    def place(self, lanes, total: np.ndarray) -> np.ndarray:
        self.part = self.range[lanes] // total
        return np.minimum(self.value[lanes] // self.part, total - np.uint32(1))

    def take(self, lanes, cum: np.ndarray, freq: np.ndarray) -> None:
        self.value[lanes] -= self.part * cum
        self._shrink(lanes, self.part * freq)

    def bits(self, lanes, bits: np.ndarray) -> np.ndarray:
        part = self.range[lanes] >> bits
        got = self.value[lanes] // part
        self.value[lanes] -= part * got
        self._shrink(lanes, part)
        return got

    def _shrink(self, lanes, size: np.ndarray) -> None:
        thin = np.flatnonzero(size < 0x10000)
        if len(thin):
            size[thin] <<= np.uint32(16)
            lane = thin if isinstance(lanes, slice) else lanes[thin]
            at = self.pos[lane]
            self.value[lane] = (self.value[lane] << np.uint32(16)) | self.words[at, lane]
            self.pos[lane] = at + 1
        self.range[lanes] = size


def _lane_counts(lengths: np.ndarray):
    """(step, lanes still running) for lanes of descending lengths."""
    for step in range(int(lengths[0]) if len(lengths) else 0):
        yield step, int(np.searchsorted(-lengths, -step))


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, list[bytes]]:
    """(ids per block, payload per block) of an array of ids below 2^16."""
    lengths = np.diff(np.append(np.arange(0, len(ids), block), len(ids)))
    grid = np.zeros(len(lengths) * block, np.uint16)
    grid[:len(ids)] = ids
    steps = np.ascontiguousarray(grid.reshape(len(lengths), block).T)
    model, coder = Mixer(len(lengths)), RangeEncoder(len(lengths), min(block, len(ids)))
    for step, n in _lane_counts(lengths):
        if step % 64 == 0:
            coder.reserve(3 * 64)  # a step gives at most three words
        now = steps[step, :n]
        first, second, total = model.predict(n)
        y = now.astype(np.uint32) + np.uint32(1)
        hit2 = y == model.x2
        hit1 = ~hit2 & (y == model.x1)
        which = 2 - 2 * hit2.astype(np.int8) - hit1
        cum = np.where(hit2, np.uint32(0), np.where(hit1, first, second))
        coder.put(slice(0, n), cum, np.where(hit2, first, np.where(hit1, second, total)) - cum, total)
        miss = np.flatnonzero(which == 2)
        if len(miss):
            missed = now[miss]
            cls = CLASS_OF[missed]
            cum = model.below[miss, cls].astype(np.uint32)
            all_of = model.below[miss, -1].astype(np.uint32)
            coder.put(miss, cum, model.below[miss, cls + 1] - cum, all_of)
            coder.put_bits(miss, REST_OF[missed], BITS_OF[missed])
            model.learn_class(miss, cls, all_of)
        model.learn(n, now, which, total)
    return lengths, coder.finish() if len(lengths) else []


def decode_blocks(lengths: np.ndarray, payloads: list[bytes]) -> np.ndarray:
    """The ids of blocks of descending lengths, one after the other."""
    if not len(lengths):
        return np.zeros(0, np.uint16)
    model, coder = Mixer(len(lengths)), RangeDecoder(payloads)
    out = np.zeros((int(lengths[0]), len(lengths)), np.uint16)
    for step, n in _lane_counts(lengths):
        first, second, total = model.predict(n)
        every = slice(0, n)
        at = coder.place(every, total)
        hit2 = at < first
        hit1 = ~hit2 & (at < second)
        which = 2 - 2 * hit2.astype(np.int8) - hit1
        cum = np.where(hit2, np.uint32(0), np.where(hit1, first, second))
        coder.take(every, cum, np.where(hit2, first, np.where(hit1, second, total)) - cum)
        now = np.where(hit2, model.x2, model.x1).astype(np.int64) - 1
        miss = np.flatnonzero(which == 2)
        if len(miss):
            below = model.below[miss]
            all_of = below[:, -1].astype(np.uint32)
            place = coder.place(miss, all_of)
            cls = (below[:, 1:] <= place.astype(np.uint16)[:, None]).sum(axis=1)
            lane = np.arange(len(miss))
            cum = below[lane, cls].astype(np.uint32)
            coder.take(miss, cum, below[lane, cls + 1] - cum)
            now[miss] = CLASSES[cls] + coder.bits(miss, CLASS_BITS[cls]).astype(np.int64)
            model.learn_class(miss, cls, all_of)
        model.learn(n, now, which, total)
        out[step, :n] = now
    flat = np.ascontiguousarray(out.T)
    return np.concatenate([flat[k, :n] for k, n in enumerate(lengths.tolist())])


def pack_group(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    table = zlib.compress(names + bytes(d is None for d in doc_ids) + np.array(sizes, "<u4").tobytes(), 1)
    lengths, payloads = encode_blocks(ids)
    blocks = b"".join(struct.pack("<III", n, len(p), zlib.crc32(p)) for n, p in zip(lengths.tolist(), payloads, strict=True))
    body = b"".join(payloads)
    return HEAD.pack(len(doc_ids), len(ids), len(lengths), len(table), len(body), zlib.crc32(table + blocks)) + table + blocks + body


def unpack_groups(data: bytes):
    """(document ids, their lengths, ids) of every group; ValueError if a checksum does not fit."""
    if data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC)
    while at < len(data):
        docs, n, blocks, table_size, body_size, crc = HEAD.unpack_from(data, at)
        at += HEAD.size
        head = data[at:at + table_size + 12 * blocks]
        if zlib.crc32(head) != crc:
            raise ValueError("damaged document table")
        table = zlib.decompress(head[:table_size])
        names = np.frombuffer(table, "<i8", docs).tolist()
        null = table[8 * docs:9 * docs]
        sizes = np.frombuffer(table, "<u4", docs, 9 * docs)
        at += len(head)
        index = np.frombuffer(head, "<u4", 3 * blocks, table_size).reshape(blocks, 3)
        stops = at + np.cumsum(index[:, 1], dtype=np.int64)
        payloads = [data[stop - size:stop] for stop, size in zip(stops.tolist(), index[:, 1].tolist(), strict=True)]
        for k, (p, want) in enumerate(zip(payloads, index[:, 2].tolist(), strict=True)):
            if zlib.crc32(p) != want:
                raise ValueError(f"damaged block {k}")
        at += body_size
        ids = decode_blocks(index[:, 0].astype(np.int64), payloads)
        if len(ids) != n:
            raise ValueError("ids are missing")
        yield [None if z else d for d, z in zip(names, null, strict=True)], sizes, ids


def write_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id",
                text: str = "text", part_bytes: int = PART_BYTES) -> tuple[str, list[int]]:
    """Write the token ids of ``docs`` in ascending order of their (long) ids; gives the folder and the ids per file.

    Files are the ranges of a range partitioning by id and text hash, numbered in order; an id that many rows share
    spreads over several files.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")
    t = F.col(text).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("h"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // part_bytes))

    def run(batches):
        enc = encoder(tokenizer_path, "H", lower=True)
        end = array("H", [END_ID]).tobytes()
        part = TaskContext.get().partitionId()
        groups, names, sizes, held, n, total = [MAGIC], [], [], [], 0, 0

        def close():
            nonlocal n, total
            groups.append(pack_group(names, sizes, np.frombuffer(b"".join(held), "<u2")))
            total += n
            names.clear(), sizes.clear(), held.clear()
            n = 0

        for b in text_slices(batches):
            found = enc.encode([x or "" for x in b.column("text").to_pylist()])
            for d, ids in zip(b.column("doc_id").to_pylist(), found, strict=True):
                ids += end
                names.append(d)
                sizes.append(len(ids) // 2)
                held.append(ids)
                n += len(ids) // 2
                if n >= GROUP_IDS:
                    close()
        if names:
            close()
        if total:
            save_bytes(folder, f"part-{part:08d}.ids", b"".join(groups))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total], pa.int64())], names=["part", "n"])

    placed = src.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text")
    counts = {r.part: r.n for r in placed.mapInArrow(run, "part long, n long").collect()}  # one row per file
    return folder, [counts.get(k, 0) for k in range(max(counts, default=-1) + 1)]


def read_files(spark: SparkSession, folder: str, counts: list[int]) -> DataFrame:
    """Read the files back: ``doc_id, start, ids`` (little-endian unsigned 32 bit) of every document."""
    schema = "doc_id long, start long, ids binary"
    if not counts:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum(counts)]).tolist()

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                start = before[int(path[-12:-4])]
                for names, sizes, ids in unpack_groups(data.as_py()):
                    ends = np.cumsum(sizes, dtype=np.int64)
                    wide = ids.astype("<u4").tobytes()
                    rows = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                    for lo in range(0, len(rows), 2000):
                        part = rows[lo:lo + 2000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[lo:lo + 2000], pa.int64()), pa.array([start + a for a, _ in part], pa.int64()),
                             pa.array([wide[4 * a:4 * z] for a, z in part], pa.binary())], names=["doc_id", "start", "ids"])
                    start += len(ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files, read them back: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    folder, counts = write_files(docs, tokenizer_path)
    return read_files(docs.sparkSession, folder, counts).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
