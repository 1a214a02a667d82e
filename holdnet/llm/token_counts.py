"""Token counts by rank-synchronous array merging of a sentencepiece BPE vocabulary.

Texts are cut into pre-tokens (a run of spaces and what follows it; no piece
crosses the start of one).  A slice's different pre-tokens are held as one
ragged numpy array of symbols.  Every round takes each sequence's lowest-rank
pair and merges it in all sequences at once, until no sequence has a mergeable
pair; the surviving symbols are the tokens.  All occurrences of that pair in a
sequence merge in the same round where no piece that extends the merged one has
a lower rank (then nothing could come between them); else only the leftmost.

Defined results: null and empty texts have no tokens; rows are counted one by
one, whatever their ids; empty tables give empty results; other columns are
ignored.  No text is cut short, special strings are ordinary text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import text_slices

OVER = 4096
#: Pre-tokens kept per worker and generation (two generations are kept).
CACHE_CHUNKS = 400_000
NEVER = np.int32(2**31 - 1)
_CHUNKS = re.compile(r" +[^ ]*")


class MergeTable:
    """Symbols, pair table and ranks of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [sp.is_unknown, sp.is_control, sp.is_byte, sp.is_unused]
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not any(f(i) for f in special)}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, sp.get_piece_size() + len(symbols))
        names = {s: k for k, s in enumerate(symbols)}
        order = sorted(pieces, key=lambda p: (-sp.get_score(pieces[p]), pieces[p]))
        self.rank = np.full(len(names), NEVER, dtype=np.int32)
        self.rank[[names[p] for p in order]] = np.arange(len(order), dtype=np.int32)
        left, right, merged = [], [], []
        for p in pieces:
            for k in range(1, len(p)):
                if p[:k] in names and p[k:] in names:
                    left.append(names[p[:k]])
                    right.append(names[p[k:]])
                    merged.append(names[p])
        left, right, merged = (np.array(x, dtype=np.int64) for x in (left, right, merged))
        keys = left * len(names) + right
        by = np.argsort(keys)
        self.size, self.keys, self.merged = np.int64(len(names)), keys[by], merged[by].astype(np.int32)
        #: symbols that a lower-ranked piece extends: their pair merges one occurrence at a time
        self.single = np.zeros(len(names), bool)
        for part in (left, right):
            self.single[part[self.rank[merged] < self.rank[part]]] = True
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for s, k in names.items():
            if len(s) == 1:
                self.char[ord(s)] = k

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; rank NEVER where they do not merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        merged = np.where(ok, self.merged[at], 0)
        return np.where(ok, self.rank[merged], NEVER), merged

    def count(self, chunks: list[str]) -> np.ndarray:
        """Tokens of every pre-token (spaces written as ▁)."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        sym = self.char[code]
        seq = np.repeat(np.arange(len(chunks)), size)
        # a character without a piece stays alone and counts its UTF-8 bytes
        total = np.zeros(len(chunks), np.int64)
        lost = sym < 0
        extra = (code[lost] >= 0x80).astype(np.int64) + (code[lost] >= 0x800) + (code[lost] >= 0x10000)
        np.add.at(total, seq[lost], extra)
        rank, merged = self._all_pairs(sym, seq)
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            length = np.diff(np.append(start, len(seq)))
            least = np.minimum.reduceat(rank, start)
            live = least != NEVER
            total[seq[start[~live]]] += length[~live]
            if not live.any():
                break
            if not live.all():
                keep = np.repeat(live, length)
                sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
                length, least = length[live], least[live]
            hit = np.flatnonzero(rank == np.repeat(least, length))
            # of touching occurrences (a pair of equal symbols) every second one, from the left
            run = np.concatenate([[True], np.diff(hit) != 1])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            first = np.concatenate([[True], np.diff(seq[hit]) != 0])
            hit = hit[first | ((nth % 2 == 0) & ~self.single[merged[hit]])]
            sym[hit] = merged[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols stand once the others are gone
            sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            self._refresh(sym, seq, rank, merged, touched)
        return total

    def _all_pairs(self, sym, seq):
        rank = np.full(len(sym), NEVER, dtype=np.int32)
        merged = np.zeros(len(sym), dtype=np.int32)
        self._refresh(sym, seq, rank, merged, np.arange(len(sym)))
        return rank, merged

    def _refresh(self, sym, seq, rank, merged, at):
        """Look up the pairs that begin at the positions ``at`` again."""
        rank[at] = NEVER
        at = at[at < len(sym) - 1]
        at = at[seq[at] == seq[at + 1]]
        rank[at], merged[at] = self.pairs(sym[at], sym[at + 1])


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each without the one space (or the start) that always comes first."""
    text = text.replace("▁", " ")
    if text.startswith(" ") or "  " in text:
        return [c[1:] for c in _CHUNKS.findall(" " + text)]
    return text.split(" ") if text else []


class Counter:
    """Token counts of texts through a bounded cache of pre-token counts."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.table, self.cache_chunks = MergeTable(path), cache_chunks
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        need: set[str] = set()
        for c in split:
            need.update(c)
        if len(self.young) + len(need) > self.cache_chunks:
            self.old, self.young = self.young, {}
        known, missing = self.old, []
        for c in need:
            if c not in self.young:
                if c in known:
                    self.young[c] = known[c]
                else:
                    missing.append(c)
        found = self.table.count(["▁" + c.replace(" ", "▁") for c in missing])
        self.young.update(zip(missing, found.tolist(), strict=True))
        get = self.young.__getitem__
        return [sum(map(get, c)) for c in split]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter of a model file (kept between tasks)."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text",
                 limit: int = OVER) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit``."""
    def run(batches):
        count = counter(model_path)
        for b in text_slices(batches):
            n = count.count([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    t = F.col(text).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"),
                      F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"))
    counted = src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
