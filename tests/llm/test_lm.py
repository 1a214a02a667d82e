import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from holdnet.llm import lm

SCHEMA = "doc_id long, text string, score string"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Brute:
    def __init__(self, texts):
        docs = [words_of(t) for t in texts]
        self.uni = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.pair = Counter(p for d in docs for p in zip(["<s>", *d[:-1]], d, strict=True))
        self.total, self.succ, self.left = Counter(), defaultdict(Counter), Counter()
        for (a, b), c in self.pair.items():
            self.total[a] += c
            self.succ[a][min(c, 3)] += 1
            self.left[b] += 1
        self.dp = self.disc(Counter(self.pair.values()))
        self.dw = self.disc(Counter(self.left.values()))
        self.classes = Counter(min(c, 3) for c in self.left.values())

    @staticmethod
    def disc(n):
        if not n[1]:
            return {1: 0, 2: 0, 3: 0}
        y = n[1] / (n[1] + 2 * n[2])
        return {k: min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else 0 for k in (1, 2, 3)}

    def p(self, a, b):
        t = sum(self.left.values())
        c = self.left[b]
        p = (c - self.dw.get(min(c, 3), 0) + sum(self.dw[k] * self.classes[k] for k in (1, 2, 3)) / (self.v + 1)) / t
        if self.total[a]:
            c = self.pair[a, b]
            p = (c - self.dp.get(min(c, 3), 0) + sum(self.dp[k] * self.succ[a][k] for k in (1, 2, 3)) * p) / self.total[a]
        return p

    def score(self, text):
        d = words_of(text)
        base = sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in d)
        full = sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *d[:-1]], d, strict=True)) if self.n else 0.0
        return len(d), sum(self.uni[w] > 0 for w in d), base, full


def corpus():
    rng = random.Random(7)
    vocab = ["the"] * 30 + ["Of", "a", "É", "ß"] * 5 + [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 20, 200])))) for k in range(250)]
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "zzz unseen qqq"), (903, "The\x1cx"), (None, "w1 w2"),
                   (904, "the " * 5000), (905, "x" * 30000)]


@pytest.mark.parametrize("shard_bytes", [1 << 30, 4000])
def test_scores_match_brute_force(spark, shard_bytes):
    rows = corpus()
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA).repartition(4)
    model = lm.train(df.filter(~lm.held_out(df.doc_id)), shard_bytes=shard_bytes)
    assert (model.words.bits == 0) == (shard_bytes > 1 << 20)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    brute = Brute([t for d, t in rows if not held(d)])
    assert (model.words.total, model.words.n) == (brute.n, brute.v)
    got = lm.score(df, model).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    want = sorted(((d, *brute.score(t)) for d, t in rows), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-9) and g[4] == pytest.approx(w[4], rel=1e-9)
    seen = [*brute.uni, "never seen"]
    for a in ("<s>", "the", "w3", "never seen"):
        assert sum(brute.p(a, b) for b in seen) == pytest.approx(1.0)


class BruteTriples(Brute):
    def __init__(self, texts):
        super().__init__(texts)
        docs = [["<s>", *words_of(t)] for t in texts]
        self.triple = Counter(x for d in docs for x in zip(d, d[1:], d[2:], strict=False))
        self.raw, own = dict(self.pair), Counter()
        for _, a, b in self.triple:
            own[a, b] += 1
        self.pair = Counter({p: c if p[0] == "<s>" else own[p] for p, c in self.raw.items()})
        self.total, self.succ = Counter(), defaultdict(Counter)
        for (a, _), c in self.pair.items():
            self.total[a] += c
            self.succ[a][min(c, 3)] += 1
        self.dp = self.disc(Counter(self.pair.values()))
        self.after = defaultdict(Counter)
        for (a, b, _), c in self.triple.items():
            self.after[a, b][min(c, 3)] += 1
        self.dt = self.disc(Counter(self.triple.values()))

    def p3(self, a, b, w):
        p = self.p(b, w)
        if self.raw.get((a, b)):
            c = self.triple[a, b, w]
            p = (c - self.dt.get(min(c, 3), 0) + sum(self.dt[k] * self.after[a, b][k] for k in (1, 2, 3)) * p) / self.raw[a, b]
        return p

    def score(self, text):
        d = ["<s>", *words_of(text)]
        return *super().score(text)[:3], sum(math.log10(self.p3(d[k - 2], d[k - 1], d[k]) if k > 1 else self.p("<s>", d[1]))
                                             for k in range(1, len(d)))


@pytest.mark.parametrize("shard_bytes", [1 << 30, 4000])
def test_order_three_matches_brute_force(spark, shard_bytes):
    rows = corpus() + [(1000 + k, "the w1 w2 then w3") for k in range(40)]
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA).repartition(4)
    model = lm.train(df.filter(~lm.held_out(df.doc_id)), shard_bytes=shard_bytes, order=3)
    brute = BruteTriples([t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(df, model).collect()), key=key)
    for g, w in zip(got, sorted(((d, *brute.score(t)) for d, t in rows), key=key), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)
    for a, b in (("<s>", "the"), ("the", "the"), ("w1", "w2"), ("never", "seen")):
        assert sum(brute.p3(a, b, w) for w in [*brute.uni, "never seen"]) == pytest.approx(1.0)


def test_counts_take_a_byte_and_larger_ones_lie_beside(spark):
    """Also where more than 255 different words precede a pair or follow it."""
    rows = corpus() + [(8, "a b c a b d")] * 300 + [(9, f"v{k} a b x{k}") for k in range(280)]
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA).repartition(2)
    model, brute = lm.train(df, order=3), BruteTriples([t for _, t in rows])
    assert {str(lm.load(model.words.folder, f"{name}-0").dtype) for name in lm.COUNTED} == {"uint8"}
    texts = ["a b c a b d", "v3 a b x3", "a b x4", "a b never", "b c a", None]
    got = model.score(pa.array(texts))
    assert got["score"].tolist() == pytest.approx([brute.score(t)[3] for t in texts], rel=1e-9)
    assert len(lm.load(model.words.folder, "after-0")) == len(lm.load(model.words.folder, "pair-0"))


def test_order_three_without_triples(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", None)], SCHEMA)
    assert [r.score for r in lm.score(df, lm.train(df, order=3)).collect()] == pytest.approx([BruteTriples([None, ""]).score("")[3]] * 2)
    assert {r.score for r in lm.score(df, lm.train(df.limit(0), order=3)).collect()} == {0.0}


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, None)], SCHEMA)
    got = lm.score(df, lm.train(df.limit(0))).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert lm.score(df.limit(0), lm.train(df)).count() == 0


def test_blobs_round_trip():
    import numpy as np
    v = np.array([0, 5, 2**32, 2**64 - 1], np.uint64)
    assert (lm.unpacked(lm.packed(v)) == v).all() and (lm.unplanes(lm.planes(v[:2])) == v[:2]).all()
    assert lm.tokens(pa.array([None, "A b"]))[1].tolist() == [0, 1, 4]
