"""Token ids of whole texts with a public tokenizer, through a bounded cache of space-separated chunks.

The byte-level and word-level vocabularies used here never form a token across
the start of `` `` + non-space, so a text is the concatenation of its chunks
and the library encodes each different chunk once.  Nor do they form one across
a letter and the punctuation marks that end the chunk: such a chunk is put together
from its word and the marks.  A word of letters is one piece to the tokenizer, so
it goes to the library's BPE model as it is, past the steps that cut a text into
pieces.  Texts that hold one of the tokenizer's special strings are encoded whole by
the library.
"""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import is_normalized

#: Chunks, without marks at their ends, kept per worker and generation (two generations are kept).
CACHE_CHUNKS = 450_000
#: Marks that are split from the letters before them at the end of a chunk (an apostrophe may belong to both).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARK_SET = frozenset(MARKS)
#: Different runs of marks kept per worker.
MARK_RUNS = 10_000
#: Characters below this were given out long ago: Python and the library agree on which of them are letters.
SETTLED = "\u0500"
#: The byte-level alphabet: bytes that are no visible character of Latin-1 are letters from U+0100 on.
LETTERS = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
LETTERS |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in LETTERS)}
_BREAK = re.compile(r" (?=\S)")
_UNEVEN = re.compile(r" (?:\s|\Z)")


class ChunkEncoder:
    """ids of texts as native (little-endian) unsigned arrays of array type ``dtype``: "H" or "I"."""

    def __init__(self, path: str, dtype: str, lower: bool = False, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype, self.cache_chunks = dtype, cache_chunks
        self.lower = lower
        self.model = self.tok.model
        #: What the tokenizer has for the space before a word; a vocabulary that marks the words' ends has nothing.
        self.space = "" if self.model.end_of_word_suffix else LETTERS[ord(" ")]
        self.marks: dict[str, bytes] = {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.dtype, e.ids).tobytes() for e in found]

    def _words(self, chunks: list[str]) -> list[bytes]:
        """ids of chunks with the space before them."""
        out: list[bytes | None] = [None] * len(chunks)
        tokenize, space, dtype = self.model.tokenize, self.space, self.dtype
        other = []
        for k, c in enumerate(chunks):
            if not self._settled(c):
                other.append(k)
                continue
            if not c.isascii():
                c = c.encode().decode("latin-1").translate(LETTERS)
            out[k] = array(dtype, [t.id for t in tokenize(space + c)]).tobytes()
        for k, ids in zip(other, self._encode([" " + chunks[k] for k in other]), strict=True):
            out[k] = ids
        return out

    def _settled(self, chunk: str) -> bool:
        """Whether the tokenizer takes the chunk for one piece and changes no letter of it."""
        if not chunk.isalpha() or self.lower and chunk != chunk.lower():
            return False
        return chunk.isascii() or max(chunk) < SETTLED and (not self.lower or is_normalized("NFC", chunk))

    def _marks(self, runs: set[str]) -> dict[str, bytes]:
        """ids of these runs of marks, and maybe of others."""
        if len(self.marks) + len(runs) > MARK_RUNS:
            self.marks = {}
        new = [m for m in runs if m not in self.marks]
        self.marks.update(zip(new, self._encode(new), strict=True))
        return self.marks

    def chunks(self, text: str) -> list[str]:
        """The text cut before every space that a non-space follows; those spaces are dropped."""
        if self.lower and "\u03a3" not in text and "\u0130" not in text and is_normalized("NFC", text):
            text = text.lower()  # the tokenizer does so too, letter by letter
        return _BREAK.split(text) if _UNEVEN.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text the bytes of its ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
            out[k] = ids
        split = {k: self.chunks(t) for k, t in enumerate(texts) if out[k] is None}
        firsts = self._encode([c[0] for c in split.values()])
        need = set().union(*(c[1:] for c in split.values()))
        marked = [(c, w, c[len(w):]) for c in need if c[-1:] in MARK_SET and (w := c.rstrip(MARKS)).isalpha()]
        need.difference_update([c for c, _, _ in marked])
        need.update([w for _, w, _ in marked])
        if len(self.young) + len(need) > self.cache_chunks:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = need.difference(young)
        known = missing.intersection(old)
        young.update((c, old[c]) for c in known)
        missing = list(missing - known)
        young.update(zip(missing, self._words(missing), strict=True))
        marks = self._marks({m for _, _, m in marked})
        here = {c: young[c] for c in need}
        here.update((c, young[w] + marks[m]) for c, w, m in marked)
        get = here.__getitem__
        for (k, c), first in zip(split.items(), firsts, strict=True):
            out[k] = first + b"".join(map(get, c[1:]))
        return out


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, dtype: str, lower: bool = False) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file (kept between tasks); ``lower``: the vocabulary ignores case."""
    key = (path, dtype, lower)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, dtype, lower)
    return _ENCODERS[key]
