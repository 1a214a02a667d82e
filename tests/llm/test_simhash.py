import random

import pytest
import xxhash

from holdnet.llm import simhash

random.seed(5)
WORDS = [f"w{k}" for k in range(400)]


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = {i: brute_fp(t) for i, (_, t) in enumerate(rows)}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return [(d, fps[i], least.get(root(i))) for i, (d, _) in enumerate(rows)]


def corpus():
    rows, n = [], 0
    for _ in range(60):
        base = [random.choice(WORDS) for _ in range(random.choice([3, 40, 300]))]
        for _ in range(random.choice([1, 2, 5])):
            w = list(base)
            for _ in range(random.choice([0, 1, 2])):
                w[random.randrange(len(w))] = random.choice(WORDS)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (904, "one two"),
             (None, "alone and nameless here"), (None, rows[0][1]), (905, "É x\x1cy z Ä")]
    return rows


SCHEMA = "doc_id long, text string, _fp string, root int"


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    got = simhash.near_duplicates(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert (sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=key)
            == sorted(brute_components(rows), key=key))


def test_every_link_within_three_bits_is_kept(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        u, v = r.u % 2**64, r.v % 2**64
        assert (u ^ v).bit_count() <= 3
        parent[root(u)] = root(v)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                assert root(a) == root(b)


def test_one_of_each(spark):
    rows = [(5, "a b c d"), (2, "A b c d"), (2, "a b  c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z"), (7, None)]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower().split()) for r in got.collect()) == [
        (0, ["x", "y", "z"]), (2, ["a", "b", "c", "d"]), (7, [])]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.one_of_each(df).count() == 0


@pytest.mark.parametrize("text", ["", "A", "a b", "a b c", "a b c d " * 3000, "K K \x0b k"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)
