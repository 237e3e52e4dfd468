"""Exact search results on three tiny lexicons."""

import pytest

from conftest import LEX_A, LEX_B, LEX_C
from glossa.plans.search import SearchRun

J, E, T = "Jyutping", "English", "Traditional"

# query -> [(entry, kind, term, unmatched, inversion, total)]
GOLD_A = {
    "lou": [(0, J, 0, 20000, 0, 20100)],
    "lou5": [(0, J, 0, 20000, 0, 20100)],
    "LOU": [(0, J, 0, 20000, 0, 20100)],
    "saa": [(1, J, 5000, 30000, 0, 35100)],
    "ho": [(1, J, 2500, 20000, 0, 22600)],
    "ho saa": [(1, J, 7500, 0, 0, 7600)],
    "lou si": [(0, J, 0, 0, 0, 100)],
    "si lou": [(0, J, 0, 0, 8000, 8100)],
    "lou lou": [(0, J, 0, 20000, 0, 20100)],
    "lou6": [],
    "teacher": [(0, E, 5000, 0, 0, 5100)],
    "teacher teacher": [(0, E, 5000, 0, 0, 5100)],
    "student": [(1, E, 5000, 0, 0, 5100)],
    "老": [(0, T, 0, 0, 0, 100)],
    "老師": [(0, T, 0, 0, 0, 100)],
    "xyz": [],
    "": [],
    "   ": [],
    "5": [],
}
GOLD_B = {
    "aa baa": [(0, J, 0, 0, 0, 0)],
    "aa ba": [(0, J, 2500, 0, 0, 2500)],
    "aa3 baa1": [(0, J, 0, 0, 0, 0)],
    "baa aa": [(0, J, 0, 0, 8000, 8000)],
    "aa": [(0, J, 0, 20000, 0, 20000)],
}
GOLD_C = {
    "fu": [(0, J, 0, 0, 0, 2165), (2, J, 0, 0, 0, 23000)],
    "fu2": [(0, J, 0, 0, 0, 2165), (2, J, 0, 0, 0, 23000)],
    "fu3": [],
    "fo": [(0, J, 20000, 0, 0, 22165), (2, J, 20000, 0, 0, 43000)],
    "to": [],
    "tiger": [(0, E, 5000, 0, 0, 7165)],
    "虎": [(0, T, 0, 0, 0, 2165), (2, T, 0, 0, 0, 23000)],
    "jat bing": [(1, J, 0, 0, 0, 16869)],
    "bing jat": [(1, J, 0, 0, 8000, 24869)],
    "bing": [(1, J, 0, 30000, 0, 46869)],
    "jat1 b": [(1, J, 7500, 0, 0, 24369)],
    "treat": [(1, E, 9500, 0, 0, 26369)],
    "together treat": [(1, E, 12900, 0, 0, 29769)],
    "wife": [(2, E, 5800, 0, 0, 28800)],
    "一併": [(1, T, 0, 0, 0, 16869), (1, E, 22100, 0, 0, 38969)],
    "   ": [],
}


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0], ids=["broadcast", "shuffle"])
@pytest.mark.parametrize("rows,gold", [(LEX_A, GOLD_A), (LEX_B, GOLD_B), (LEX_C, GOLD_C)], ids="ABC")
def test_goldens(make_lexicon, make_queries, rows, gold, broadcast_bytes):
    run = SearchRun(make_queries(list(gold)), make_lexicon(rows), broadcast_bytes=broadcast_bytes)
    got = {q: [] for q in gold}
    names = list(gold)
    for r in sorted(run.ranked().collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[names[r["query_id"]]].append(
            (
                r["entry_id"],
                r["match_type"],
                r["term_match_cost"],
                r["unmatched_position_cost"],
                r["inversion_cost"],
                r["total_cost"],
            )
        )
    assert got == gold
    counts = {names[r["query_id"]]: r["internal_candidates"] for r in run.candidate_counts().collect()}
    assert counts == {q: len(v) for q, v in gold.items()}
