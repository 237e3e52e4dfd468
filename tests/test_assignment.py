"""Terms on syllables against all permutations, and many terms on a long entry."""

import itertools
import random

from pyspark.sql import functions as F

import model
from glossa.functions.spans import assign_syllables
from glossa.functions.text import syllables
from glossa.plans.search import query_terms


def paths(spark, cases):
    df = spark.createDataFrame([(i, q, r) for i, (q, r) in enumerate(cases)], "i int, q string, r string").coalesce(1)
    return [r["p"] for r in df.orderBy("i").select(assign_syllables(query_terms(F.col("q")), syllables(F.col("r"))).alias("p")).collect()]


def cheapest(query, reading):
    terms, syl = query.split(), reading.split()
    base = lambda t: t[:-1] if t[-1].isdigit() else t
    cost = [[None if t[-1].isdigit() and t[-1] != s[-1] else model.term_cost(base(t), s[:-1]) for s in syl] for t in terms]
    best = None
    for places in itertools.permutations(range(len(syl)), len(terms)):
        cs = [cost[t][p] for t, p in enumerate(places)]
        if None not in cs:
            best = min(best or (1 << 60, ()), (sum(cs), places))
    return list(best[1]) if best else None


def test_same_as_permutations(spark):
    rng = random.Random(31)
    words = ["a", "ab", "ba", "bab", "aab", "cab"]
    cases = [
        (" ".join(rng.choice(words) + rng.choice(["", "", "1", "2"]) for _ in range(rng.randint(1, 3))), " ".join(rng.choice(words) + rng.choice("12") for _ in range(rng.randint(0, 5))))
        for _ in range(150)
    ]
    assert paths(spark, cases) == [cheapest(*c) for c in cases]


def test_many_terms_on_a_long_entry(spark):
    reading = " ".join(f"{w}1" for w in ["zo", "ma", "ki"] * 10)
    (path,) = paths(spark, [("ma ma ma ki ki ki zo zo", reading)])
    assert path == [1, 4, 7, 2, 5, 8, 0, 3]


def test_forty_terms_on_sixty_syllables(spark):
    rng = random.Random(5)
    words = ["zo", "ma", "ki", "zoma", "kima", "makizo"]
    reading = " ".join(rng.choice(words) + rng.choice("12") for _ in range(60))
    terms = rng.sample(reading.split(), 40)
    terms = [t if rng.random() < 0.4 else t[:-1] for t in terms]
    (path,) = paths(spark, [(" ".join(terms), reading)])
    syl = reading.split()
    assert len(set(path)) == 40
    base = lambda t: t[:-1] if t[-1].isdigit() else t
    cost = [[None if t[-1].isdigit() and t[-1] != s[-1] else model.term_cost(base(t), s[:-1]) for s in syl] for t in terms]
    assert all(cost[t][p] is not None for t, p in enumerate(path))
    # No exchange of two terms, and no move to a free place, costs less, or as much with smaller positions.
    rank = lambda ps: (sum(cost[t][p] for t, p in enumerate(ps)), ps)
    free = [p for p in range(60) if p not in path]
    for a in range(40):
        moves = [[*path[:a], p, *path[a + 1 :]] for p in free]
        for b in range(a):
            swap = list(path)
            swap[a], swap[b] = path[b], path[a]
            moves.append(swap)
        for m in moves:
            if all(cost[t][p] is not None for t, p in enumerate(m)):
                assert rank(path) < rank(m)


def test_as_many_terms_as_syllables(spark):
    reading = " ".join(f"{w}{i % 6 + 1}" for i, w in enumerate(["so", "lo", "mi"] * 8))
    (path,) = paths(spark, [(" ".join(reversed(reading.split())), reading)])
    assert path is not None and sorted(path) == list(range(24))
