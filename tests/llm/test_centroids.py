"""Centroids against plain Python over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tarn.llm import centroids as c

SCHEMA = "vec_id long, embedding array<double>, cluster int"


def brute(given, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else 64 * int(x) for x in v], v) for i, v in given if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    cents = [q for _, q, _ in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), j) for j, m in enumerate(cents))

    for _ in range(rounds):
        of = [near(q)[1] for _, q, _ in kept]
        new = []
        for j, m in enumerate(cents):
            own = [q for (_, q, _), o in zip(kept, of, strict=True) if o == j]
            new.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else m)
        cents = new
    return [(i, near(q)[1], near(q)[0]) for i, q, _ in kept], cents


@pytest.mark.parametrize("scale", [1.0, 0.02, 1e9, 1e300])
def test_against_brute_force(spark, scale):
    r = random.Random(2)
    given = [(i if i % 9 else None, [r.choice([r.gauss(0, 1), 0.0, -0.5]) * scale for _ in range(4)]) for i in range(120)]
    given += [(500, None), (501, [1.0] * 3), (502, [1.0, None, 1.0, 1.0]), (503, [float("nan")] * 4), (504, [float("inf")] + [0.0] * 3), (505, [])]
    given += [(3, [0.25 * scale] * 4)] * 3 + [(600 + i, [float(i % 2)] * 4) for i in range(6)]  # ties
    df = spark.createDataFrame([(*g, 1) for g in given], SCHEMA).repartition(3)
    out, cents = c.clustered(df, k=5, dim=4)
    want, want_cents = brute(given, 5, 3, 4)
    assert cents == want_cents
    fits = lambda d: d if d < 1 << 63 else None
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in out.collect()))) == sorted(map(str, ((i, j, fits(d)) for i, j, d in want)))
    whole = c.summed(out, cents).collect()
    assert len(whole) == len(want)
    if all(d < 1 << 55 for _, _, d in want):
        assert {r.inertia for r in whole} == {sum(d for _, _, d in want)}
        assert all(r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) for r in whole)


def test_few_or_no_vectors(spark):
    out, cents = c.clustered(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)], SCHEMA), dim=2)
    assert sorted(map(tuple, cents)) == [(64, 128), (192, 128)] and out.count() == 2
    out, cents = c.clustered(spark.createDataFrame([], SCHEMA), dim=2)
    assert cents == [] and c.summed(out, cents).count() == 0


def test_annulus_leaves_centroids_out():
    """Of centroids at many norms only few are compared, and none that is nearest is missed."""
    r = np.random.default_rng(4)
    cents = (r.normal(size=(200, 8)) * np.linspace(1, 4000, 200)[:, None]).astype(np.int64)
    x = (cents[r.integers(0, 200, 3000)] + r.integers(-5, 6, (3000, 8))).astype(np.int64)
    a = c.Annuli(cents.tolist())
    low, high = a.ranges(x)
    d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    number, best = a.nearest(x)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert (high - low).mean() < 150
