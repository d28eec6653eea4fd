"""Hard negatives against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnscope.llm import hardneg


def test_strassen():
    rng = np.random.default_rng(1)
    for shape in [(1, 1, 1), (3, 5, 7), (64, 64, 64), (100, 33, 70), (257, 64, 129), (40, 0, 8), (16, 300, 16)]:
        m, k, n = shape
        for high in (10, 1 << 28):
            a, b = rng.integers(-high, high, (m, k)), rng.integers(-high, high, (k, n))
            exact = (a.astype(object) @ b.astype(object)).astype(np.int64) if k else np.zeros((m, n), np.int64)
            for leaf in (1, 4, 16):
                assert (hardneg.strassen(a, b, leaf) == exact).all()
    # Sums on the way leave 64 bits, the result does not.
    a = np.full((64, 64), 1 << 30)
    b = np.where(np.arange(64)[:, None] % 2, 1 << 32, -(1 << 32)) * np.ones((1, 64), np.int64)
    assert (hardneg.strassen(a, b, 1) == 0).all()


def test_heaps_merge():
    rng = random.Random(2)
    for _ in range(20):
        n, k = rng.randint(1, 5), rng.randint(1, 4)
        heaps, seen = hardneg.Heaps(n, k), [[] for _ in range(n)]
        ids = 0
        for _ in range(rng.randint(1, 6)):
            wide = rng.randint(1, 9)
            score = np.array([[rng.randint(-3, 3) for _ in range(wide)] for _ in range(n)])
            for i in range(n):
                seen[i] += list(zip(score[i].tolist(), range(ids, ids + wide)))
            heaps.push(score.copy(), np.arange(ids, ids + wide))
            ids += wide
        for i in range(n):
            best = sorted(seen[i], key=lambda x: (-x[0], x[1]))[:k]
            found = [(s, d) for s, d in zip(heaps.score[i].tolist(), heaps.id[i].tolist()) if s != hardneg.NONE]
            assert found == best


def plain(rows, positives, negatives, low, high, scale):
    able = {}
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(x * scale) for x in vector]
        if sum(x * x for x in whole) < 2**56:
            able[vec_id] = min(able.get(vec_id, (label, whole)), (label, whole))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, vector) in able.items():
        if a % 5:
            continue
        scored = sorted((-dot(vector, v), b, own == label) for b, (own, v) in able.items() if b != a)
        for score, b, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and low * -score <= -100 * x[0] <= high * -score][:negatives]
            out |= {(a, b, k + 1, c, -score, -s) for k, (s, c, _) in enumerate(inside)}
    return out


SCHEMA = "vec_id bigint, label int, embedding array<float>, rank string, part string, near string, anchor_id string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    found = []
    for i in range(300):
        base = [rng.choice([0.0, 0.25, 0.5, -0.125]) for _ in range(rng.choice([12, 12, 12, 9, 0]))]
        found.append((i - 20, 0 if i % 3 == 0 else rng.randint(1, 4), base))
    found += [(400, None, [1.0]), (405, 0, None), (410, 0, [None, 1.0]), (415, 0, [float("nan")]), (420, 1, [float("inf"), 0.0])]
    found += [(425, 1, [3e30]), (None, 1, [1.0]), (430, 7, [0.5] * 12), (435, 2, [0.0] * 12), found[25], found[30], (10, 1, [0.5] * 12)]
    return [(*r, "x", "y", "z", "0") for r in found]


@pytest.mark.parametrize("parts, bytes_", [(1, 1 << 30), (7, 200), (64, 1 << 30)])
def test_hard_negatives(spark, rows, parts, bytes_, monkeypatch):
    monkeypatch.setattr(hardneg, "GROUPS", parts)
    monkeypatch.setattr(hardneg, "GROUP_BYTES", bytes_ * 20)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for settings in [(5, 3, 50, 95, 256), (2, 4, 10, 100, 8)]:
        found = hardneg.hard_negatives(table, F.col("vec_id") % 5 == 0, *settings).collect()
        assert len(found) == len(set(found))
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert {tuple(r[c] for c in names) for r in found} == plain(rows, *settings)


def test_empty(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], "", "", "", ""), (1, 1, [1.0], "", "", "", "")], SCHEMA)
    assert hardneg.hard_negatives(one, F.col("vec_id") % 5 == 0).count() == 0
    assert hardneg.hard_negatives(one, F.lit(False)).count() == 0
