"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns at the hits, embedded checksums.

One automaton over all keywords runs over the text; a kind's regular expression
is only tried at a hit of one of its keywords.  Runs of hexadecimal digits have
no keyword: their prefilter is the run length, found on the bytes of a whole
slice at once.  ``github`` and ``npm`` tokens must carry the right checksum
(their last six characters are the CRC-32 of the random part in base 62).

Spans are ``kind, start, end`` in code points, end exclusive, of the whole
match; those of one kind never overlap, those of different kinds may.

Defined results: null or empty texts have no spans (``redact`` keeps them as
they are); rows are judged one by one, whatever their ids; empty tables give
empty results; other columns pass through ``redact``.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import class_table, text_bytes, text_slices, word_spans

#: Kinds in their order, keywords (lower case) and anchored patterns.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "api_key", "apikey"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
PATTERNS = {
    "assign": re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"(npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_DIGIT = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def checksum62(text: str) -> str:
    """CRC-32 of the text as six base-62 digits."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= MIN_VALUE
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    return checksum62(m[2]) == m[3]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def keyword_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would move the positions
        low = text.translate(_ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in automaton.iter(low):
        hits.setdefault(kind, []).append(end - size + 1)
    spans = []
    for kind, at in hits.items():
        done = 0
        for start in sorted(at):
            if start >= done and (m := PATTERNS[kind].match(text, start)):
                done = m.end()  # a match that fails its check still takes its place
                if valid(kind, m):
                    spans.append((kind, start, done))
    return spans


def hex_spans(texts: pa.Array) -> dict[int, list[tuple[str, int, int]]]:
    """Row -> spans of the long runs of hexadecimal digits."""
    raw, offsets = text_bytes(texts)
    starts, ends, _ = word_spans(raw, offsets, HEX_DIGIT)
    long = ends - starts >= MIN_HEX
    starts, ends = starts[long], ends[long]
    rows = np.searchsorted(offsets, starts, "right") - 1
    out: dict[int, list] = {}
    for row, lo, hi in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
        before = raw[offsets[row]:lo]
        at = int(np.count_nonzero((before & 0xC0) != 0x80))  # code points: all but continuation bytes
        out.setdefault(row, []).append(("hex", at, at + hi - lo))
    return out


def scan(texts: pa.Array, automaton: ahocorasick.Automaton | None = None) -> list[list[tuple[str, int, int]]]:
    """Spans of every text by start, then by kind."""
    automaton = automaton or _automaton()
    by_hex = hex_spans(texts)
    out = []
    for row, text in enumerate(texts.to_pylist()):
        spans = (keyword_spans(text, automaton) if text else []) + by_hex.get(row, [])
        out.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        automaton = _automaton()
        for b in text_slices(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scan(b.column("text"), automaton)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    id_kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {id_kind}, spans array<struct<kind:string,start:long,end:long>>")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every (merged) span replaced by ``[kind]`` of its first span."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns; secrets in the text are replaced by ``[kind]``, and ``size_col``, if there, by the new
    length of the texts that changed."""
    columns = docs.columns

    def run(batches):
        automaton = _automaton()
        for b in text_slices(batches, text):
            found = scan(b.column(text), automaton)
            new = [blank(t, s) if s else t for t, s in zip(b.column(text).to_pylist(), found, strict=True)]
            cols = {c: b.column(c) for c in columns}
            cols[text] = pa.array(new, pa.string())
            if size_col in cols:
                old = cols[size_col].to_pylist()
                cols[size_col] = pa.array([len(t) if s else n for t, s, n in zip(new, found, old, strict=True)],
                                          cols[size_col].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=columns)

    return docs.mapInArrow(run, docs.schema)
