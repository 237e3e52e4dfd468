"""Families of texts that nearly but not quite reach the similarity: compared within tasks, never as all pairs."""

import random

import numpy as np

from glossa.llm import simhash


def test_full_groups_give_rows_not_pairs():
    rng = np.random.default_rng(3)
    words = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.uint64), 500, axis=0)
    words[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    other = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    other[1] = other[0]
    group = np.array([0] * 500 + [1] * 3)
    a, b, full = simhash.pairs_or_rows(group, np.arange(503), np.concatenate([words, other]), 10, 4)
    assert (a.tolist(), b.tolist()) == ([500], [501]) and sorted(full.tolist()) == list(range(500))


def test_alike_joins_what_exact_pairs_join():
    rng = random.Random(5)
    sets = []
    for _ in range(12):
        base = [rng.randrange(-(2**62), 2**62) for _ in range(50)]
        sets += [np.unique([x if rng.random() > 0.08 else rng.randrange(2**62) for x in base]) for _ in range(8)]
    sets += [np.zeros(0, dtype=np.int64)] * 2
    n = len(sets)
    label = np.array([i // 2 for i in range(n)])

    def components(links):
        root = list(range(n))
        find = lambda i: i if root[i] == i else find(root[i])
        for i, j in [*links, *((i, j) for i in range(n) for j in range(i) if label[i] == label[j])]:
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(n)]

    near = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9
    want = [(i, j) for i in range(n) for j in range(i) if near(sets[i], sets[j])]
    for slab in (1 << 21, 120):
        a, b = simhash.alike(label, sets, 0.8, slab)
        assert len(a) < len(set(label.tolist())) and all(near(sets[i], sets[j]) for i, j in zip(a, b, strict=True))
        assert components(zip(a.tolist(), b.tolist(), strict=True)) == components(want)
