import random

import public_tokenizers
import pytest
import sentencepiece

from holdnet.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(6)
    chars = list("abcdeeetthhiosn  \n\t.,=-_'0129ABÉéßäöü") + ["▁", "日", "本", "😀", "́", "​", "\xa0", "\x00", "ﬁ", "Ⅷ"]
    rows = ["".join(rng.choice(chars) for _ in range(rng.choice([1, 3, 20, 300]))) for _ in range(800)]
    return rows + ["", " ", "  ", "▁", "a  b", " lead", "trail  ", "<s> </s> <unk> <0x0A>", "a" * 5000, "=" * 4097, "ha" * 3000,
                   "\n" * 50, "abab" * 100 + "aab" * 100, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000)),
                   "the of and in " * 200, "\r\n x", "﻿bom", "".join(chr(c) for c in range(1, 0x250)),
                   "".join(chr(c) for c in range(0x2000, 0x3100))]


def test_counts_match_the_library(sp):
    rows = texts()
    got = tc.Counter(PATH, cache_chunks=500).count(rows)
    bad = [(t[:40], g, w) for t, g, w in zip(rows, got, map(len, sp.encode(rows)), strict=True) if g != w]
    assert not bad


def test_every_piece_as_text(sp):
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(0, sp.get_piece_size(), 3)]
    twice = [a + b for a, b in zip(pieces, pieces[7:], strict=False)]
    assert tc.Counter(PATH).count(pieces + twice) == [len(x) for x in sp.encode(pieces + twice)]


def test_query_rows(spark, sp):
    rows = [(1, "Hello  world", None), (1, "Hello  world", "x"), (None, None, None), (2, "", None), (3, "日本 " * 3000, None)]
    got = tc.token_counts(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (d or 0, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for d, t, _ in rows)
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
