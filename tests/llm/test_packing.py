import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from holdnet.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string"


def docs():
    rng = random.Random(4)
    words = ["the", "naïve", "x1", "it's", "日本", "Abc,", "\n\n", "", "\t", "  ", "don't"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 30, 400, 1500])))) for k in range(150)]
    return rows + [(1000, None), (1001, ""), (1001, " "), (None, "no id"), (1002, "a <|endoftext|>  b \x1c c\x85 d"),
                   (1003, "trailing  "), (1004, "y" * 30000), (1005, "  \n lead  x 　 z")]


def test_pieces_cover_every_id_once(spark):
    rows = docs()
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA).repartition(3)
    got = packing.pack(df, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = {}
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.setdefault(d, []).append(ids)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length * 4 == len(r.ids) > 0
    assert set(by_doc) == set(want)
    for d, texts in want.items():
        if len(texts) == 1:
            parts = sorted(by_doc[d], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in parts) == texts[0]
            assert [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
            assert {r.doc_tokens for r in parts} == {len(texts[0]) // 4}
        else:
            assert sum(r.length for r in by_doc[d]) == sum(map(len, texts)) // 4
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)  # no padding at all
    crc = packing.pieces(df, PATH)
    assert crc.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(r.ids_crc32 for r in crc.collect()) == sorted(zlib.crc32(bytes(r.ids)) for r in got)


def test_level_choice_matches_brute_force():
    rng = random.Random(1)
    p = packing.SumOfSquares(16)
    for _ in range(400):
        item = rng.randint(1, 15)
        best = None
        for level in range(0, 16 - item + 1):
            if level and not p.count[level]:
                continue
            c = p.count.copy()
            if level:
                c[level] -= 1
            if level + item < 16:
                c[level + item] += 1
            cost = int((c[1:16] ** 2).sum())
            if best is None or cost <= best[0]:
                best = (cost, level)
        assert p.level_for(item) == best[1]
        p.place(item, item)
    assert all(len(w) == p.count[k] for k, w in enumerate(p.open))


def test_empty_table(spark):
    assert packing.pieces(spark.createDataFrame([], SCHEMA), PATH).count() == 0
