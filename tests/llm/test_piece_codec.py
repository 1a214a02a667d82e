import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from holdnet.llm import piece_codec as pc
from holdnet.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pc.Codec(PATH, cache_chunks=500)


def own(codec, texts, end=True):
    return [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts, end)]


def texts():
    rng = random.Random(12)
    chars = list("abcdeeetthhiosn  \n\t.,=-_'0129ABÉéßäöü") + ["▁", "日", "本", "😀", "́", "​", "\xa0", "\x00", "ﬁ", "Ⅷ"]
    rows = ["".join(rng.choice(chars) for _ in range(rng.choice([1, 3, 20, 300]))) for _ in range(800)]
    rows += ["".join(rng.choice(letters) for _ in range(2000)) for letters in ("ertinsh", "acgt", "aeiou", "=-", "ab", "the ", "▁a ")
             for _ in range(5)]
    rows += [" " * k + tail for k in range(70) for tail in ("", "the", "\n")] + ["x" + " " * k for k in range(40)]
    return rows + ["", " ", "▁", "a▁ b", "<s> </s> <unk> <0x0A>", "a" * 5000, "=" * 4097, "ha" * 3000, "\n" * 50, "abab" * 100 + "aab" * 100,
                   "\r\n x", "﻿bom", "".join(chr(c) for c in range(1, 0x250)), "".join(chr(c) for c in range(0x2000, 0x3100))]


def test_ids_and_texts_match_the_library(sp, codec):
    rows = texts()
    want = sp.encode(rows, add_eos=True)
    got = own(codec, rows)
    assert not [(t[:40], g[:9], w[:9]) for t, g, w in zip(rows, got, want, strict=True) if g != w]
    assert own(codec, rows[:50], end=False) == sp.encode(rows[:50])
    back = codec.vocabulary.decode(np.array(sum(got, [])), np.array([len(g) for g in got]))
    assert back == sp.decode(got) == [t.replace("▁", " ") for t in rows]


def test_every_piece_as_text(sp, codec):
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(0, sp.get_piece_size(), 3)]
    twice = [a + b for a, b in zip(pieces, pieces[7:], strict=False)]
    assert own(codec, pieces + twice, end=False) == sp.encode(pieces + twice)


def test_any_ids_decode_as_the_library_does(sp, codec):
    rng = random.Random(3)
    rows = [[rng.choice([rng.randrange(32000), rng.randrange(300), rng.randrange(3), 28705, 259]) for _ in range(rng.randrange(12))]
            for _ in range(5000)]
    got = codec.vocabulary.decode(np.array(sum(rows, [])), np.array([len(r) for r in rows]))
    assert got == [sp.decode(r) for r in rows]
    with pytest.raises(IndexError):
        codec.vocabulary.decode(np.array([32000]), np.array([1]))


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ertinsh", "acgt", "a", " ", "日本語中文字人大"])
def test_a_word_of_a_million_letters(sp, codec, letters):
    rng = random.Random(5)
    text = "".join(rng.choices(letters, k=1_000_000))
    began = time.perf_counter()
    got = own(codec, [text])
    assert time.perf_counter() - began < 60
    assert got == [sp.encode(text, add_eos=True)]
    assert not any(len(c) > pc.CACHE_CHARS for c in codec.young)


def test_edge_rows(spark, sp):
    rows = [(1, "Hello  world", None, "x"), (1, "Hello  world", "y", None), (None, None, None, None), (2, "", None, None),
            (3, "日本 𝄞 " * 3000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    encoded = pc.encode(docs, PATH)
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in encoded.collect()))
    assert got == sorted((d or 0, sp.encode(t or "", add_eos=True)) for d, t, _, _ in rows)
    assert sorted((r.doc_id or 0, r.text) for r in pc.decode(encoded, PATH).collect()) == sorted((d or 0, t or "") for d, t, _, _ in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 259, None, 28705, 2])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in pc.decode(odd, PATH).collect()) == [(1, ""), (2, ""), (3, sp.decode([259, 28705, 2]))]
    empty = pc.encode(spark.createDataFrame([], SCHEMA), PATH)
    assert empty.count() == 0 and pc.decode(empty, PATH).count() == 0


def test_registered_query(spark, sp, tmp_path):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts()[::9])] + [(9999, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_sentencepiece"](spark, str(tmp_path)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for k, t, *_ in rows:
        ids = sp.encode(t or "", add_eos=True)
        want[k] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert got == want
