"""Removal of repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import repeats


def brute(rows, length, keep_first=False):
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, first = Counter(), {}
    for i in order:
        for s in range(len(texts[i]) - length + 1):
            w = texts[i][s : s + length]
            seen[w] += 1
            first.setdefault(w, (i, s))
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if seen[w] > 1 and not (keep_first and first[w] == (i, s)):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + gone[0])
        out.append((rows[i][0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length, gram, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({c: F.lit(1) for c in ("h", "c", "doc", "at", "n", "k", "spans", "z")})
    out = repeats.remove_repeats(df, length, gram, **options)
    return sorted((tuple(r)[:5] for r in out.collect()), key=str)


def texts(seed, n, alphabet="ab é日 "):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, k)))
    passages = [word(120) for _ in range(5)]
    rows = [(i, "".join(rng.choice([word(40), rng.choice(passages), rng.choice(passages)[rng.randint(0, 30) :]]) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, "x" * 300), (n + 2, "ab" * 100), (n + 3, None), (n + 4, ""), (None, rows[1][1] + "?")]


@pytest.mark.parametrize("seed,length,gram", [(1, 20, 10), (2, 20, 3), (3, 40, 20), (4, 30, 29)])
def test_equal_to_brute_force(spark, seed, length, gram):
    rows = texts(seed, 60)
    assert run(spark, rows, length, gram) == brute(rows, length)


def test_anchors_with_many_surroundings(spark, monkeypatch):
    rows = texts(5, 60, "abcdefgh ")
    assert run(spark, rows, 20, 10, most=2) == brute(rows, 20)
    monkeypatch.setattr(repeats, "SUFFIXES", 50)
    monkeypatch.setattr(repeats, "BUFFER", 64)  # long texts in parts
    assert run(spark, rows, 20, 10) == brute(rows, 20)


def test_first_copies_stay(spark):
    rows = texts(6, 60)
    assert run(spark, rows, 20, 10, keep_first=True) == brute(rows, 20, True)
    assert run(spark, rows, 20, 10, keep_first=True, most=2) == brute(rows, 20, True)


def test_full_length(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(["stone", "river", "cloud", "walk", "seven", "lamp"]) + str(rng.randint(0, 99)) for _ in range(n))
    a, b = prose(90), prose(60)
    rows = [(1, prose(50) + a + prose(50)), (2, a), (3, prose(9) + a[7:300] + prose(3)), (4, b + "." + b), (5, prose(400)), (6, "z" * 5000), (6, "z" * 199), (7, "z" * 200)]
    assert run(spark, rows, 200, 100) == brute(rows, 200)


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "the same text " * 30), (1, "the same text " * 30), (None, "q" * 100), (None, "q" * 100)]
    assert run(spark, rows, 50, 25) == brute(rows, 50)
    assert run(spark, [], 50, 25) == []


def test_longest_previous_factor():
    text = np.frombuffer(b"abracadabra-abracad-zzzzzz-dabr", dtype=np.uint8)
    width = 8
    records = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.arange(200, 200 + width, dtype=np.uint8)]), width)[: len(text)]
    raw = [bytes(r) for r in records]
    common = lambda x, y: next((i for i in range(width) if x[i] != y[i]), width)
    previous, following = repeats.lpf(records, np.arange(len(text)))
    assert previous.tolist() == [max((common(raw[i], raw[j]) for j in range(i)), default=0) for i in range(len(text))]
    assert following.tolist() == [max((common(raw[i], raw[j]) for j in range(i + 1, len(text))), default=0) for i in range(len(text))]


def test_nearest_smaller():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50):
        p = rng.permutation(n)
        assert repeats.nearest_smaller(p).tolist() == [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(n)]
