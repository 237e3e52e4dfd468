"""Hard negatives against brute force with Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, vector array<double>"


def brute(rows, is_anchor):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    q = [[math.floor(256 * x) for x in r[2]] for r in ok]
    most = 2**63 - 1
    out = []
    for i, a in enumerate(ok):
        if not is_anchor(a[0]):
            continue
        score = [max(-most, min(most, sum(x * y for x, y in zip(q[i], c)))) for c in q]
        rank = sorted(range(len(ok)), key=lambda j: (-score[j], ok[j][0]))
        for p in [j for j in rank if j != i and ok[j][1] == a[1]][:5]:
            fit = [j for j in rank if ok[j][1] != a[1] and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:10]
            out += [(a[0], ok[p][0], n + 1, ok[j][0], score[p], score[j]) for n, j in enumerate(fit)]
    return sorted(out)


def run(spark, rows, every=5, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit(1) for c in ("row", "n", "chunk", "block", "slot", "score", "found")})
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def vectors(seed, n, dims, size):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, size) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.randrange(4)
        rows.append((i, c % 3, [x + rng.gauss(0, size / 2) for x in centre[c]]))
    return rows + [rows[3], rows[5], (n, rows[10][1], rows[10][2])]  # repeated rows and a repeated vector


@pytest.mark.parametrize("seed,dims,size", [(1, 8, 0.2), (2, 3, 5.0), (3, 16, 0.01), (4, 4, 1e5), (5, 3, 1e12), (6, 1, 0.004)])
def test_equal_to_brute_force(spark, seed, dims, size):
    rows = vectors(seed, 150, dims, size)
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_small_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_NUMBERS", 64)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 3)
    monkeypatch.setattr(hn, "SLICE", 2)
    monkeypatch.setattr(hn, "TILE", 2)
    rows = vectors(7, 120, 8, 0.2)
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_rows_without_part_and_ragged_vectors(spark):
    rows = [
        (0, 1, [1.0, 2.0]),
        (5, 1, [1.0, 2.0, 0.5]),
        (1, 1, [2.0]),
        (2, 2, [0.5, 0.5]),
        (3, 2, []),
        (4, 2, [float("nan"), 1.0]),
        (6, 2, [float("inf")]),
        (7, 2, [None, 1.0]),
        (8, None, [1.0]),
        (9, 2, None),
        (None, 2, [1.0]),
    ]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert run(spark, rows[:2]) == [] and run(spark, rows[9:]) == []
    assert run(spark, [r for r in rows if r[0] == 3]) == []


def test_a_hot_vector_and_a_hot_label(spark):
    rows = [(i, 1, [0.25, 0.5]) for i in range(300)] + [(300 + i, 2, [0.2, 0.01 * i]) for i in range(40)]
    assert run(spark, rows, 50) == brute(rows, lambda i: i % 50 == 0)


def test_fields_hold_several_candidates():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-150, 150, (7, 64)).astype(float), rng.integers(-150, 150, (33, 64)).astype(float)
    fields, width = hn.field_plan(np.abs(a).sum(axis=1).max(), c.min(), c.max())
    assert fields == 2 and (hn.products(a, c, -c.min(), fields, width) == (a @ c.T)).all()
    assert hn.packed(c, -c.min(), fields, width).shape == (64, 17)
    assert (hn.products(a, c, -c.min(), 0, 0) == (a @ c.T)).all()
