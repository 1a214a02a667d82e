import random
from array import array

import public_tokenizers
import pytest

from holdnet.llm.encoding import ChunkEncoder


@pytest.mark.parametrize(("name", "kind", "lower"), [("byte_bpe_50k.json", "I", False), ("word_bpe_49k.json", "H", True)])
def test_ids_are_those_of_the_library(name, kind, lower):
    enc = ChunkEncoder(public_tokenizers.path(name), kind, lower, cache_chunks=300)
    rng = random.Random(1)
    bits = ["the", "The,", " ", "  ", "\n", "\t", "word.", "it's", "İst", "ΣΑΣ", "ÉCOLE!", "é", "12,", "a1.", "...", "x;", "\x1c", "\x85",
            "\xa0", "　", "日本。", "<|endoftext|>", "<|startoftext|>", "don't,", "😀", "​", "'", "'ll.", "ͅ", "ǅ", "ﬁ.", "\r\n", "K"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.choice([1, 5, 60]))) for _ in range(1500)]
    texts += ["", " ", "a", "Hello, world. ", "y" * 3000, "".join(chr(c) for c in range(1, 0x3000))]
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    got = []
    for lo in range(0, len(texts), 100):
        got += [list(array(kind, x)) for x in enc.encode(texts[lo:lo + 100])]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not bad, bad[0]


@pytest.mark.parametrize(("name", "kind", "lower"), [("byte_bpe_50k.json", "I", False), ("word_bpe_49k.json", "H", True)])
def test_a_word_is_encoded_once_whatever_marks_follow(name, kind, lower):
    enc = ChunkEncoder(public_tokenizers.path(name), kind, lower)
    sent, encode, words = [], enc._encode, enc._words
    enc._encode = lambda texts: sent.extend(texts) or encode(texts)
    enc._words = lambda chunks: sent.extend(chunks) or words(chunks)
    text = "first glorp glorp. glorp.%%% glorp### glorp, glorp!! (glorp) glorp's"
    for _ in range(2):
        assert list(array(kind, enc.encode([text])[0])) == enc.tok.encode(text, add_special_tokens=False).ids
    assert sent.count("glorp") == 1
    assert not any(x in sent for x in (" glorp.", " glorp.%%%", " glorp###", "glorp.%%%", "glorp###"))


def test_letters_that_the_model_gets_past_the_cutting():
    enc = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), "I")
    low = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), "H", lower=True)
    words = [chr(c) * n for c in range(0x21, 0x600) for n in (1, 3)] + ["Éclair", "naïve", "Straße", "ÖL", "мир", "Σάς", "ét"]
    for e in (enc, low):
        want = [x.ids for x in e.tok.encode_batch([f"x {w} y" for w in words], add_special_tokens=False)]
        got = [list(array(e.dtype, x)) for x in e.encode([f"x {w} y" for w in words])]
        assert got == want
