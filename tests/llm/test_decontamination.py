import random

from holdnet.llm import decontamination as d
from holdnet.llm.decontamination import item_words

SCHEMA = "doc_id long, text string, _words int, _Hits string, _items int"


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = item_words(text)
        hit, names = set(), set()
        for name, t in items:
            p = item_words(t)
            n = min(window, len(p))
            for i in range(len(p) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == p[i:i + n]:
                        hit.update(range(j, j + n))
                        if name is not None:
                            names.add(str(name))
        out.append((doc_id, len(w), len(hit), tuple(sorted(names)), bool(hit)))
    return out


def data():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(6)] + ["É", "ß9", "İx"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([11, 14, 25])))) for k in range(12)]
    items += [(100, "Solo"), (101, "two WORDS"), (102, "five short words in here"), (103, None), (104, "!!"), (None, "anon item x"),
              (7, "second text of seven " * 4)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 30, 700])))) for k in range(40)]
    for k in range(30):
        p = rng.choice(items)[1] or ""
        docs.append((100 + k, "Lead, " + p.upper().replace(" ", "... ") + "; " + rng.choice(items[:12])[1][3:]))
    docs += [(500, None), (501, ""), (501, "solo"), (None, "x two\nwords"), (502, "the solo! anon-item x five short words in"),
             (503, "a b " * 3000 + "two words " + "c " * 4000 + items[3][1])]
    return docs, items


def check(spark, block_bytes):
    docs, items = data()
    df = spark.createDataFrame([(a, b, 1, None, 2) for a, b in docs], SCHEMA).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated)
           for r in d.report(df, bench, block_bytes=block_bytes).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)
    kept = d.drop_contaminated(df, bench, block_bytes=block_bytes)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r[-1] for r in brute(docs, items))


def test_matches_brute_force(spark):
    check(spark, d.PATTERN_BYTES)


def test_pattern_blocks_give_the_same(spark):
    check(spark, 400)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.report(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b", 1, "x", 1)], SCHEMA)
    assert d.report(some, bench).first().contaminated is False
