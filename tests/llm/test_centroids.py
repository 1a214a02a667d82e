import hashlib
import math
import random

import pytest

from holdnet.llm import centroids as cc
from holdnet.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, id string"


def plain(rows, dim, k=8, rounds=10, scale=1024):
    """Lloyd in Python integers: (kept (id, x) rows, their clusters, distances, centroids)."""
    kept = [(i, tuple(math.floor(scale * float(c)) for c in v)) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        found = [nearest(x)[1] for _, x in kept]
        for j in range(len(cents)):
            own = [x for (_, x), f in zip(kept, found, strict=True) if f == j]
            if own:
                cents[j] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    last = [nearest(x) for _, x in kept]
    return kept, [j for _, j in last], [d for d, _ in last], cents


def vectors(n, dim, seed=1, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(5)]
    return [(k, [float.fromhex(float(c + rng.gauss(0, 0.3)).hex()) for c in rng.choice(centres)]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "r", "i") for i, v in rows], SCHEMA)


def expected(rows, dim, rounds=10):
    kept, found, dist, cents = plain(rows, dim, rounds=rounds)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    own = [sum(d for d, f in zip(dist, found, strict=True) if f == j) for j in range(len(cents))]
    return sorted((i if i is not None else -1, f, d, own[f], sum(dist), sha[f]) for (i, _), f, d in zip(kept, found, dist, strict=True))


def got(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in df.collect())


def float32(rows):
    import numpy as np
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]


def test_registered_query(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = vectors(300, 64)
    rows += [(500, rows[0][1]), (500, rows[0][1]), (7, rows[9][1]), (None, rows[3][1]), (501, None), (502, [1.0] * 63), (503, []),
             (504, [1.0] * 63 + [nan]), (505, [inf] + [1.0] * 63), (506, [None] + [1.0] * 63), (507, [-0.0] * 64), (508, [0.0] * 64)]
    rows = float32(rows)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(QUERIES["op13_centroids"](spark, str(tmp_path))) == expected(rows, 64)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("centroids_")]


@pytest.mark.parametrize("width", [1, 3, 64])
def test_widths_of_blocks(spark, width):
    rows = float32(vectors(60, 4, seed=2))
    found = cc.cluster(cc.integer_vectors(frame(spark, rows), dim=4), rounds=3, width=width)
    assert got(cc.report(found)) == expected(rows, 4, 3)


def test_ties_and_empty_clusters(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(20)]  # equal seeds: the smaller number takes all, the others stay
    found = cc.report(cc.cluster(cc.integer_vectors(frame(spark, rows), dim=2), rounds=2, width=1))
    assert got(found) == expected(rows, 2, 2)


def test_few_and_no_rows(spark):
    rows = [(1, [0.5, 1.0]), (2, [3.0, 1.0])]
    assert got(cc.report(cc.cluster(cc.integer_vectors(frame(spark, rows), dim=2), rounds=1))) == expected(rows, 2, 1)
    one = cc.report(cc.cluster(cc.integer_vectors(frame(spark, rows[:1]), dim=2), rounds=1))
    assert got(one) == expected(rows[:1], 2, 1)
    none = cc.report(cc.cluster(cc.integer_vectors(frame(spark, []), dim=2)))
    assert none.count() == 0 and none.columns == one.columns


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="scaled component"):
        cc.integer_vectors(frame(spark, [(1, [1e9, 0.0])]), dim=2).collect()
