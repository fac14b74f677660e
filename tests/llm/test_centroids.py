"""Integer clusters against plain Lloyd's rounds."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from dayrank.llm import centroids
from tests.llm.helpers import CLASHING

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, rows, extra: bool = True):
    names = [c.split()[0] for c in CLASHING.split(", ")] + ["cluster", "distance"] if extra else []
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([(i, v, 1, *["x"] * len(names)) for i, v in rows], schema)


def plain(rows) -> list[tuple]:
    """The same clusters by comparing everything with everything, in Python's integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            ints = [x.as_integer_ratio()[0] * 256 // x.as_integer_ratio()[1] for x in v]
            kept.append((i, ints))
    def digest(i) -> str:
        return hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()

    now = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:40]]

    def assign(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(now))

    for _ in range(5):
        found = [assign(x)[1] for _, x in kept]
        now = [
            [sum(col) // len(own) for col in zip(*own, strict=True)]
            if (own := [x for (_, x), k in zip(kept, found, strict=True) if k == number]) else c
            for number, c in enumerate(now)
        ]
    last = [assign(x) for _, x in kept]
    total = {k: sum(d for d, j in last if j == k) for _, k in last}

    def fit(n):
        return n if n < 1 << 63 else None

    return sorted(
        (
            (i, k, fit(d), fit(total[k]) , fit(sum(total.values())),
             hashlib.sha256(",".join(map(str, now[k])).encode()).hexdigest())
            for (i, _), (d, k) in zip(kept, last, strict=True)
        ),
        key=repr,
    )


def found(spark, rows) -> list[tuple]:
    return sorted(map(tuple, centroids.cluster(frame(spark, rows)).collect()), key=repr)


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in middles[rng.randrange(12)]]) for i in range(400)]
    same = rows[3][1]
    rows += [(400 + i, same) for i in range(150)]  # a hot vector, with ties between equal centroids
    rows += [(7, same), (None, [0.1] * 64), (None, [0.1] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None])]
    rows += [(905, [float("nan")] * 64), (906, [1.0] * 63 + [float("inf")]), (907, [0.0] * 64)]
    assert found(spark, rows) == plain(rows)


def test_few_none_and_no_usable_vectors(spark):
    few = [(i, [float(i % 3)] * 64) for i in range(7)]
    assert found(spark, few) == plain(few)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [1.0])]) == []


def test_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    rows += [(100, [1e7] * 64), (101, [-1e12] * 64), (102, [1.7e308] * 64), (103, [1.7e308] * 63 + [-1.0])]
    assert found(spark, rows) == plain(rows)


def test_bounds_rule_out_most_and_never_the_nearest():
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 64)) * 256
    x = (middles[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * 40).astype(np.int64)
    basis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    model = centroids.Centroids([[int(v) for v in m] for m in middles], basis)
    lead, rest = centroids.rotated(x, basis)
    exact = np.square(x[:, None, :] - model.values).sum(axis=2)
    bounds = model.bounds(lead, rest)
    assert (bounds <= exact).all()
    number, best = model.nearest(x, lead, rest)
    assert (number == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert (bounds <= best[:, None]).sum() < 1.5 * len(x)
