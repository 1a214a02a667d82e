import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from holdnet.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string"


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 30000])
@pytest.mark.parametrize("kind", ["same", "even", "text", "extremes"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"same": np.full(n, 7), "even": rng.integers(0, 1 << 16, n), "extremes": rng.choice([0, 65535, 1, 3, 4], n),
           "text": np.minimum(rng.zipf(1.2, n), 49407)}[kind].astype(np.uint16)
    lengths, payloads = tf.encode_blocks(ids)
    assert lengths.sum() == n and (tf.decode_blocks(lengths, payloads) == ids).all()
    if kind == "same" and n > 4000:
        assert sum(map(len, payloads)) < n / 10
    if kind == "text" and n > 4000:
        assert sum(map(len, payloads)) < 1.6 * n  # two bytes an id uncoded


def test_blocks_are_independent():
    ids = np.random.default_rng(1).integers(0, 500, 3 * 4096).astype(np.uint16)
    lengths, payloads = tf.encode_blocks(ids)
    assert (tf.decode_blocks(lengths[1:2], payloads[1:2]) == ids[4096:8192]).all()


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint16)
    data = tf.MAGIC + tf.pack_group([1, None, 3], [2000, 2000, 1000], ids)
    (names, sizes, got), = tf.unpack_groups(data)
    assert names == [1, None, 3] and sizes.tolist() == [2000, 2000, 1000] and (got == ids).all()
    for at in (len(data) - 5, len(tf.MAGIC) + tf.HEAD.size + 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(tf.unpack_groups(bytes(bad)))


@pytest.mark.parametrize("part_bytes", [1 << 30, 3000])
def test_documents_round_trip(spark, part_bytes):
    rng = random.Random(2)
    words = ["The", "quick", "naïve", "日本", "fox.", "\n", "it's", "<|endoftext|>"]
    rows = [(k * 7 % 211, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 80]))), None) for k in range(211)]
    rows += [(500, None, None), (501, "", None), (501, "same id", None), (None, "no id", None), (None, None, None), (502, "long " * 9000, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    folder, counts = tf.write_files(df, PATH, part_bytes=part_bytes)
    assert (len(counts) > 3) == (part_bytes < 1 << 20)
    got = sorted(tf.read_files(spark, folder, counts).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(PATH)
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
        want[r.doc_id].remove(bytes(r.ids))
    assert not any(want.values())
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    again = tf.round_trip(df, PATH)
    assert again.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(r.ids_crc32 for r in again.collect()) == sorted(zlib.crc32(bytes(r.ids)) for r in got)


def test_empty_table(spark):
    assert tf.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0
