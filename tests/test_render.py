"""Highlight spans, rendered entries and JSON of whole searches."""

import json

import pytest

from conftest import LEX_A, LEX_B, LEX_C, entry
from glossa.plans.render import display, render, results_json
from glossa.plans.search import SearchRun

M = '<mark class="hit-highlight">'


@pytest.fixture(scope="module")
def rendered(make_lexicon, make_queries):
    def run(rows, texts):
        out = {t: [] for t in texts}
        for r in render(SearchRun(make_queries(texts), make_lexicon(rows))).orderBy("query_id", "rank").collect():
            out[texts[r["query_id"]]].append(r)
        return out

    return run


def spans_of(row):
    return [tuple(s) for s in row["spans"]]


def test_syllable_spans(rendered):
    got = rendered(LEX_A, ["lou", "lou5", "LOU", "si", "saa", "ho", "saa1", "lou lou", "ho saa"])
    want = {
        "lou": [(0, 3)],
        "lou5": [(0, 4)],
        "LOU": [(0, 3)],
        "si": [(5, 7)],
        "saa": [(5, 8)],
        "ho": [(0, 2)],
        "saa1": [(5, 8), (10, 11)],
        "lou lou": [],  # two terms cannot share a syllable when highlighting
        "ho saa": [(0, 2), (5, 8)],
    }
    assert {q: spans_of(rs[0]) for q, rs in got.items()} == want
    assert got["saa1"][0]["rendered"]["jyutping"] == f"hok6 {M}saa</mark>ng{M}1</mark>"
    assert got["saa1"][0]["rendered"]["characters"] == "學生"


def test_spans_across_syllables(rendered):
    got = rendered(LEX_B, ["aa baa", "aa ba", "aa3 baa1"])
    assert {q: spans_of(rs[0]) for q, rs in got.items()} == {
        "aa baa": [(0, 2), (4, 7)],
        "aa ba": [(0, 2), (4, 6)],
        "aa3 baa1": [(0, 8)],
    }


def test_definition_and_headword_spans(rendered):
    got = rendered(LEX_A, ["teach", "老", "teacher teacher"])
    assert got["teach"][0]["rendered"]["english_definitions"] == [f"{M}teach</mark>er"]
    assert got["teacher teacher"][0]["rendered"]["english_definitions"] == [f"{M}teacher</mark>"]
    assert spans_of(got["老"][0]) == [(0, 1)]
    assert got["老"][0]["rendered"]["characters"] == f"{M}老</mark>師"
    assert got["老"][0]["rendered"]["english_definitions"] == ["teacher"]


def test_spans_stay_within_their_definition(rendered):
    """A hit ending one definition and one starting the next are not fused."""
    got = rendered([entry(0, "x", "", ["a <cat>", "cat & cat"], 0)], ["cat"])
    assert got["cat"][0]["rendered"]["english_definitions"] == [f"a &lt;{M}cat</mark>&gt;", f"{M}cat</mark> &amp; cat"]


def test_headword_spans_one_apart_are_fused(rendered):
    got = rendered([entry(0, "甲乙甲丁丁甲", "", [], 0)], ["甲"])
    assert spans_of(got["甲"][0]) == [(0, 3), (5, 6)]
    assert got["甲"][0]["rendered"]["characters"] == f"{M}甲乙甲</mark>丁丁{M}甲</mark>"


def test_byte_spans_of_non_ascii_definitions(rendered):
    got = rendered([entry(0, "x", "", ["für Übel", "Öl"], 0)], ["bel"])
    assert got["bel"][0]["rendered"]["english_definitions"] == [f"für Ü{M}bel</mark>", "Öl"]


def test_same_entry_twice(rendered):
    """A headword hit and a definition hit of one entry are both kept, the cheaper first."""
    got = rendered(LEX_C, ["一併"])
    assert [(r["match_type"], r["entry_id"]) for r in got["一併"]] == [("Traditional", 1), ("English", 1)]


def test_assignment_prefers_smallest_positions(rendered):
    got = rendered([entry(0, "x", "aa1 aa1 ab1", [], 0)], ["aa aa", "ab aa", "aa aa aa"])
    assert got["aa aa"][0]["path"] == [0, 1]
    assert got["ab aa"][0]["path"] == [2, 0]
    # Every syllable is within reach of "aa", at a price for the last.
    assert got["aa aa aa"][0]["path"] == [0, 1, 2]


def test_json(make_lexicon, make_queries):
    run = SearchRun(make_queries(["teach", "nothing"]), make_lexicon(LEX_A))
    got = {r["query_id"]: json.loads(r["json"]) for r in results_json(run).collect()}
    assert got[1] == {"results": []}
    (hit,) = got[0]["results"]
    assert hit["query"] == "teach"
    assert hit["match_obj"]["matched_spans"] == [[0, 5]]
    assert hit["match_obj"]["match_obj"] == {
        "cost_info": {"term_match_cost": 5000, "unmatched_position_cost": 0, "inversion_cost": 0, "static_cost": 100},
        "match_type": "English",
        "entry_id": 0,
    }
    assert hit["rendered_entry"]["english_definitions"] == [f"{M}teach</mark>er"]
    assert hit["rendered_entry"]["entry_source"] == "CEDict"


def test_display(make_lexicon):
    rows = {r["entry_id"]: r for r in display(make_lexicon(LEX_C)).collect()}
    assert rows[1]["jyutping"] == "jat1 bing6"
    assert rows[0]["english_definitions"] == ["tiger", "CL:隻|只[zhi1]"]
    assert rows[2]["entry_source"] == "CCanto"
