"""The set-oriented search against the per-row model, on random lexicons and queries."""

import random

import pytest

import model
from conftest import entry
from glossa.plans.search import SearchRun

SYLLABLES = ["a", "ab", "ba", "bab", "aab", "cab", "abcabcabcabcabcabcab", "Bc"]
CHARS = "甲乙丙丁xy"
WORDS = ["ab", "Ba-ab", "über", "CAB", "cabs", "a", "b-a", "déjà", "ab\tba", "bcabcabcabcabcabcab"]


def random_lexicon(rng, n):
    rows = []
    for i in range(n):
        reading = " ".join(rng.choice(SYLLABLES) + str(rng.randint(1, 3)) for _ in range(rng.randint(0, 4)))
        head = "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 3)))
        defs = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 3))]
        rows.append(entry(i, head, reading, defs, 100 * (i // 7)))
    return rows


def random_query(rng):
    parts = []
    for _ in range(rng.randint(1, 3)):
        part = rng.choice(SYLLABLES + WORDS + list(CHARS) + ["abcabcabcXabcabcabcab", "acab", "bca", "?", "ü", "5"])
        if rng.random() < 0.2:
            part += str(rng.randint(0, 3))
        if rng.random() < 0.2:
            part = part.swapcase()
        if rng.random() < 0.3 and len(part) > 1:
            cut = rng.randrange(len(part))
            part = part[:cut] + part[cut + 1 :]
        parts.append(part)
    return rng.choice([" ", "  ", "\t"]).join(parts)


@pytest.mark.parametrize(
    "seed,broadcast_bytes,k,saved",
    [(1, 64 << 20, 5, False), (2, 0, 5, False), (3, 64 << 20, 2000, False), (1, 64 << 20, 5, True), (2, 0, 5, True), (3, 200_000, 2000, True)],
)
def test_same_as_model(make_lexicon, make_queries, seed, broadcast_bytes, k, saved):
    rng = random.Random(seed)
    rows = random_lexicon(rng, 80)
    queries = sorted({random_query(rng) for _ in range(250)})
    run = SearchRun(make_queries(queries, k), make_lexicon(rows, files=3, saved=saved), broadcast_bytes=broadcast_bytes)
    got = {i: [] for i in range(len(queries))}
    for r in sorted(run.ranked().collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(
            (r["entry_id"], r["match_type"], r["term_match_cost"], r["unmatched_position_cost"], r["inversion_cost"], r["total_cost"])
        )
    counts = {r[0]: r[1] for r in run.candidate_counts().collect()}
    for i, q in enumerate(queries):
        want, n = model.search(q, k, rows)
        assert got[i] == want, q
        assert counts[i] == n, q
