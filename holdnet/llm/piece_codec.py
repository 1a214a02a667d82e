"""SentencePiece encoding and decoding by vectorised merge rounds over flat symbol arrays.

``encode`` gives the ids that the sentencepiece library gives for a BPE model with
byte fallback (identity normaliser, dummy prefix); ``decode`` gives the text of
ids.  Both are Arrow functions over slices of whole texts; no text is cut short.

A text falls into chunks (a run of spaces and what follows it; no piece crosses
a chunk's start), a chunk into words: cuts between two neighbouring characters
that stand next to each other in no piece, so no merge can cross them and even
a chunk of megabytes is made of short words.  All words of a batch lie in one flat symbol array.  A
round finds each word's least pair rank (segmented minimum), merges its
leftmost occurrences in all words at once and drops finished words from the
arrays, until no pair remains.  Several occurrences in a word merge in one round
as long as that cannot differ from merging them one by one (see ``_leftmost``).
Pieces that are runs of one character may share one last rank (space runs); they are
put together after the rounds, from the left.  A character without a piece gives
its UTF-8 bytes' ids.

Defined results: null and empty texts have no ids but the end id; rows are
encoded one by one, whatever their ids, so repeated rows repeat; empty tables give
empty results; columns other than the id and the text are ignored, whatever their
names.  Strings of control pieces are ordinary text.  Null ids lists decode to the empty text and null entries
are skipped; bytes that form no UTF-8 become U+FFFD each; ids outside the vocabulary raise IndexError.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import text_slices

#: Chunks kept per worker and generation (two generations are kept); longer chunks are not kept.
CACHE_CHUNKS, CACHE_CHARS = 300_000, 64
#: Characters merged at a time; a longer chunk is merged on its own.
BATCH_CHARS = 1 << 18
#: Ids decoded at a time.
BATCH_IDS = 1 << 18
SPACE = "▁"
NEVER = np.int32(2**31 - 1)
_CHUNK = re.compile(r" +[^ ]*")


class Vocabulary:
    """Symbols, pair ranks, safe cuts and piece bytes of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.end = np.int32(sp.eos_id())
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        self._bytes(sp, n)
        self._runs({p: sp.get_score(i) for p, i in pieces.items() if len(p) > 1}, pieces)
        self._pairs({p: i for p, i in pieces.items() if p not in self.run_pieces}, sp)

    def _bytes(self, sp, n: int) -> None:
        """Ids of single bytes, and what every id stands for as bytes (end to end, with the offsets)."""
        self.byte_id = np.zeros(256, np.int32)
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.spaced = np.zeros(n, bool)  # may lose a space at the text's start
        out = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b] = i
                out.append(bytes([b]))
            elif sp.is_control(i):
                out.append(b"")
            elif sp.is_unknown(i):
                out.append(sp.decode([i]).encode())
            else:
                self.spaced[i] = piece.startswith(SPACE)
                out.append(piece.replace(SPACE, " ").encode())
        self.piece_size = np.fromiter(map(len, out), np.int64, n)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)

    def _runs(self, scores: dict[str, float], pieces: dict[str, int]) -> None:
        """Pieces that share the last score: runs of one character, joined from the left once all else is done."""
        last = min(scores.values())
        tied = {p for p, s in scores.items() if s == last}
        self.run_pieces = tied if len(tied) > 1 else set()
        rest = [s for p, s in scores.items() if p not in self.run_pieces]
        if len(set(rest)) < len(rest) or len({c for p in self.run_pieces for c in p}) > 1:
            raise ValueError("scores of this vocabulary are tied")
        self.run_char = next(iter(self.run_pieces))[0] if self.run_pieces else ""
        self.run_id = {len(p): pieces[p] for p in self.run_pieces}
        self.run_most = max(self.run_id, default=1)
        self.run_split = [self._joined_run(k) for k in range(self.run_most + 1)]
        if self.run_split[-1] != [self.run_most]:
            raise ValueError("runs of this vocabulary are not joined from the left")

    def _joined_run(self, length: int) -> list[int]:
        """Lengths of the pieces of a run: the leftmost two neighbours that form a piece are joined, again and again."""
        stack: list[int] = []
        for _ in range(length):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.run_id:
                stack.append(stack.pop() + stack.pop())
        return stack

    def _pairs(self, pieces: dict[str, int], sp) -> None:
        symbols = dict.fromkeys(c for p in pieces for c in p) | dict.fromkeys(pieces)
        names = {s: k for k, s in enumerate(symbols)}
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: -sp.get_score(pieces[p]))
        rank = np.full(len(names), NEVER, np.int32)
        rank[[names[p] for p in order]] = np.arange(len(order), dtype=np.int32)
        split = [(names[p[:k]], names[p[k:]], names[p]) for p in order for k in range(1, len(p)) if p[:k] in names and p[k:] in names]
        left, right, merged = np.array(split, np.int64).reshape(-1, 3).T
        key = left * len(names) + right
        by = np.argsort(key)
        self.size, self.rank, self.longest = np.int64(len(names)), rank, max(map(len, pieces))
        self.pair_key, self.pair_symbol, self.pair_rank = key[by], merged[by].astype(np.int32), rank[merged[by]]
        #: symbols that a lower-ranked piece extends: after their merge that piece may come first
        self.extended = np.zeros(len(names), bool)
        for part in (left, right):
            self.extended[part[rank[merged] < rank[part]]] = True
        self.id_of = np.array([pieces.get(s, -1) for s in symbols], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for s, k in names.items():
            if len(s) == 1:
                self.char[ord(s)] = k
        inside = {(self.char[ord(p[k])], self.char[ord(p[k + 1])]) for p in pieces for k in range(len(p) - 1)}
        self.inside = np.sort(np.array([int(a) * len(names) + int(b) for a, b in inside], np.int64))

    def _find(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the sorted keys, whether it is there) of neighbouring symbols."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return at, (keys[at] == key) & (a >= 0) & (b >= 0)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Per chunk (spaces written as in the pieces) the little-endian 32-bit ids."""
        out: list[bytes] = []
        lo, chars = 0, 0
        for hi, c in enumerate(chunks):
            chars += len(c)
            if chars >= BATCH_CHARS:
                out += self._encode(chunks[lo:hi + 1])
                lo, chars = hi + 1, 0
        return out + self._encode(chunks[lo:])

    def _encode(self, chunks: list[str]) -> list[bytes]:
        if not chunks:
            return []
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        chunk = np.repeat(np.arange(len(chunks)), size)
        sym = self.char[code]
        ids, at = self._ids(*self._merge(sym, chunk), code, chunk)
        ends = np.cumsum(np.bincount(chunk[at], minlength=len(chunks)))
        return [ids[a:b].tobytes() for a, b in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True)]

    def _merge(self, sym: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, position of the first character of each) once no pair remains."""
        done_sym, done_at = np.full(len(sym), -1, np.int32), np.zeros(len(sym), bool)
        if len(sym) == 0:
            return done_sym, np.flatnonzero(done_at)
        _, joined = self._find(self.inside, sym[:-1], sym[1:])
        word = np.concatenate([[0], np.cumsum(~(joined & (chunk[1:] == chunk[:-1])))])
        sym, at = sym.copy(), np.arange(len(sym))
        rank, new = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
        self._refresh(np.arange(len(sym)), sym, word, rank, new)
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(start, append=len(word))
            least = np.minimum.reduceat(rank, start)
            least_here = np.repeat(least, length)
            ended = least_here == NEVER
            if ended.any():  # compaction: finished words leave the arrays
                done_sym[at[ended]], done_at[at[ended]] = sym[ended], True
                go = ~ended
                sym, word, at, rank, new, least_here = sym[go], word[go], at[go], rank[go], new[go], least_here[go]
                if not len(sym):
                    break
            hit = self._leftmost(np.flatnonzero(rank == least_here), sym, word, at, new)
            sym[hit] = new[hit]
            go = np.ones(len(sym), bool)
            go[hit + 1] = False
            place = hit - np.arange(len(hit))  # of the merged symbols, once their right halves are gone
            sym, word, at, rank, new = sym[go], word[go], at[go], rank[go], new[go]
            self._refresh(np.concatenate([place, place[place > 0] - 1]), sym, word, rank, new)
        return done_sym, np.flatnonzero(done_at)

    def _leftmost(self, hit, sym, word, at, new) -> np.ndarray:
        """Of the places of every word's least pair (rank r): the leftmost, and others that merge in the same round.

        Of overlapping places every second one counts.  If merging a place makes a pair that ranks below r, that pair
        comes before the next place; as it can only grow into one piece around the place, it matters to places within two
        piece lengths.  So of a chain of places that near to each other, those after the first such place wait.
        """
        number = np.arange(len(hit))
        fresh = np.concatenate([[True], np.diff(hit) != 1])
        hit = hit[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
        symbol = new[hit]
        if not self.extended[symbol].any():
            return hit
        rank = self.rank[symbol]
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
        left = sym[before]
        beside = np.concatenate([[False], (np.diff(hit) == 2) & (word[hit[1:]] == word[hit[:-1]])])
        left[beside] = symbol[beside]
        found, ok = self._find(self.pair_key, left, symbol)
        lower = ok & (self.pair_rank[found] < rank) & (hit > 0) & (word[before] == word[hit])
        found, ok = self._find(self.pair_key, symbol, sym[after])
        lower |= ok & (self.pair_rank[found] < rank) & (hit + 2 < len(sym)) & (word[after] == word[hit])
        chain = np.concatenate([[True], (np.diff(word[hit]) != 0) | (np.diff(at[hit]) > 2 * self.longest)])
        earlier = np.cumsum(lower) - lower
        return hit[earlier == np.maximum.accumulate(np.where(chain, earlier, 0))]

    def _refresh(self, at, sym, word, rank, new) -> None:
        """Look up the pairs that begin at the places ``at``."""
        rank[at] = NEVER
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        found, ok = self._find(self.pair_key, sym[at], sym[at + 1])
        at, found = at[ok], found[ok]
        rank[at], new[at] = self.pair_rank[found], self.pair_symbol[found]

    def _ids(self, sym, at, code, chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, position of the character that each belongs to): runs joined, characters without a piece as bytes."""
        ids = np.where(sym[at] >= 0, self.id_of[sym[at]], -1)
        if self.run_char:
            ids, at = self._join_runs(ids, at, code, chunk)
        lost = np.flatnonzero(ids == -1)
        if not len(lost):
            return ids, at
        raw = [chr(c).encode() for c in code[at[lost]].tolist()]
        copies = np.ones(len(ids), np.int64)
        copies[lost] = [len(r) for r in raw]
        ids, at = np.repeat(ids, copies), np.repeat(at, copies)
        ids[ids == -1] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, at

    def _join_runs(self, ids, at, code, chunk) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(at, append=len(code))
        single = (code[at] == ord(self.run_char)) & (size == 1)
        new_run = single & ~(np.concatenate([[False], single[:-1]]) & (chunk[at] == np.concatenate([[-1], chunk[at][:-1]])))
        starts = np.flatnonzero(new_run)
        if not len(starts):
            return ids, at
        number = np.cumsum(new_run)[single] - 1
        lengths = np.bincount(number, minlength=len(starts))
        keep, ids = np.ones(len(ids), bool), ids.copy()
        for s, n in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
            pieces = np.array([self.run_most] * (n // self.run_most) + self.run_split[n % self.run_most])
            heads = s + np.cumsum(pieces) - pieces
            keep[s:s + n] = False
            keep[heads] = True
            long = pieces > 1
            ids[heads[long]] = [self.run_id[p] for p in pieces[long].tolist()]
        return ids[keep], at[keep]

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """Texts of rows of ids that lie end to end; ``size``: ids per row."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.piece_size)):
            raise IndexError("an id outside the vocabulary")
        n, start = self.piece_size[ids], self.piece_start[ids].copy()
        row = np.repeat(np.arange(len(size)), size)
        shown = np.flatnonzero(~self.control[ids])
        first = shown[np.concatenate([[True], np.diff(row[shown]) != 0])] if len(shown) else shown
        first = first[self.spaced[ids[first]]]  # the dummy prefix goes
        n[first] -= 1
        start[first] += 1
        put = np.cumsum(n) - n
        raw = self.piece_bytes[np.arange(n.sum()) - np.repeat(put - start, n)].tobytes()
        # bytes do not form a character across a control id
        inner = self.control[ids] & (row == np.concatenate([row[1:], [-1]]))
        part = row + np.concatenate([[0], np.cumsum(inner)])[:len(ids)]
        ends = np.cumsum(np.bincount(part, weights=n, minlength=len(size)).astype(np.int64)).tolist()
        texts = [raw[a:b].decode("utf-8", "each-byte") for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if not inner.any():
            return texts
        out = [""] * len(size)
        for k, r in dict(zip(part.tolist(), row.tolist(), strict=True)).items():
            out[r] += texts[k]
        return out


codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def chunks_of(text: str) -> list[str]:
    """The text's chunks, each without the one space (or the start) that always comes first."""
    text = text.replace(SPACE, " ")
    if text.startswith(" ") or "  " in text:
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ") if text else []


class Codec:
    """Ids of texts through a bounded cache of chunks, and texts of ids."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.vocabulary, self.cache_chunks = Vocabulary(path), cache_chunks
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str], end: bool = True) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers."""
        split = [chunks_of(t) for t in texts]
        need: set[str] = set()
        for c in split:
            need.update(c)
        if len(self.young) + len(need) > self.cache_chunks:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for c in need:
            if c not in young:
                if c in old:
                    young[c] = old[c]
                else:
                    missing.append(c)
        young.update(zip(missing, self.vocabulary.encode([SPACE + c.replace(" ", SPACE) for c in missing]), strict=True))
        tail = self.vocabulary.end.tobytes() if end else b""
        out = [b"".join(map(young.__getitem__, c)) + tail for c in split]
        for c in missing:
            if len(c) > CACHE_CHARS:
                del young[c]
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model file (kept between tasks)."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """Per row: ``doc_id, ids`` (array<int>), with the end id last if ``end``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in text_slices(batches):
            found = own.encode([t or "" for t in b.column("text").to_pylist()], end)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)],
                                             names=["doc_id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _id_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, ids end to end, ids per row) in pieces of about BATCH_IDS ids; null lists are empty, null entries left out."""
    for whole in batches:
        lists = whole.column("ids")
        size = np.asarray(lists.value_lengths().fill_null(0))
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // BATCH_IDS)) + 1
        lo = 0
        for hi in [*cuts.tolist(), whole.num_rows]:
            if hi > lo:
                b = whole.slice(lo, hi - lo)
                part = b.column("ids")
                flat = part.flatten()
                n = size[lo:hi]
                if flat.null_count:
                    there = np.asarray(flat.is_valid())
                    n = np.bincount(np.repeat(np.arange(hi - lo), n), weights=there, minlength=hi - lo).astype(np.int64)
                    flat = flat.drop_null()
                yield b, flat.to_numpy(zero_copy_only=False).astype(np.int64), n
            lo = hi


def decode(encoded: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, text`` of a table ``doc_id, ids``; the ids stay beside the text if asked for."""
    names = ["doc_id", "ids", "text"] if keep_ids else ["doc_id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b, ids, size in _id_slices(batches):
            cols = [b.column(c) for c in names[:-1]] + [pa.array(own.vocabulary.decode(ids, size), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = {**dict(encoded.dtypes), "text": "string"}
    src = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    kinds["ids"] = "array<int>"
    return src.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def ids_digest(ids: str = "ids") -> Column:
    """Lowercase hex sha256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
