from __future__ import annotations

import numpy as np
import pytest

from dayrank.llm import forest
from tests.llm.helpers import CLASHING, sorted_rows


def brute(rows, cosine=0.98):
    """[(id, links, smallest id reachable)] over all pairs of a label."""
    links, root = [0] * len(rows), list(range(len(rows)))

    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            _, w, other = rows[j]
            if label is None or label != other or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            x, y = np.array(v, dtype=float), np.array(w, dtype=float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return sorted((r[0], links[i], rows[find(i)][0]) for i, r in enumerate(rows))


def clusters(seed, count=1200, width=24):
    r = np.random.default_rng(seed)
    base = r.standard_normal((count // 4, width))
    rows = []
    for i in range(count):
        v = base[r.integers(len(base))] if i % 3 else r.standard_normal(width)
        v = v + r.standard_normal(width) * r.choice([0.0, 0.1, 0.15, 0.25]) * np.abs(v).mean()
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(count + i, rows[1][1], rows[1][2]) for i in range(60)]  # a group of equal vectors
    return rows


def frame(spark, rows, element="float"):
    data = [(*r, *["x"] * len(CLASHING.split(", "))) for r in rows]
    return spark.createDataFrame(data, f"vec_id long, embedding array<{element}>, label int, {CLASHING}")


@pytest.mark.parametrize(("leaf", "cell"), [(32, 1000), (64, 10)])
def test_recall_against_brute_force(spark, leaf, cell):
    rows = clusters(leaf)
    wanted = brute(rows)
    got = sorted_rows(
        forest.near_duplicates(frame(spark, rows), leaf=leaf, cell=cell), "vec_id", "n_links", "component_id"
    )
    total, met = sum(w[1] for w in wanted), sum(g[1] for g in got)
    assert total > 1000
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), wanted, strict=True))  # none below the threshold
    assert met / total >= 0.99
    same = sum(g == w for g, w in zip(sorted(got), wanted, strict=True))
    assert same / len(rows) >= 0.99


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (2, [2.0, 4.0, 6.0], 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [], 0),
        (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [float("nan"), 2.0, 3.0], 0),
        (10, [float("inf"), 2.0, 3.0], 0), (11, [1.0, 2.0, 3.0, 0.0], 0), (12, [-1.0, -2.0, -3.0], 0),
        (13, [1.0, 2.0, 3.001], 0), (14, [0.0, -0.0, 1.0], 2), (15, [-0.0, 0.0, 1.0], 2),
    ]
    for element in ("float", "double"):
        got = sorted_rows(forest.near_duplicates(frame(spark, rows, element)), "vec_id", "n_links", "component_id")
        assert sorted(got) == brute(rows)
    nulls = forest.near_duplicates(frame(spark, [(None, one, 0), (2, one, 0), (2, one, 0)]))
    assert sorted_rows(nulls, "vec_id", "n_links", "component_id", "kept") == sorted(
        [(None, 0, None, True), (2, 1, 2, True), (2, 1, 2, True)], key=repr
    )
    assert forest.near_duplicates(frame(spark, [])).count() == 0
