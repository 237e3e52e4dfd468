"""Options of a search, page sizes of any length, and what a run leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import LEX_A, LEX_C, entry
from glossa.functions.paging import LARGEST, page_size, page_size_of
from glossa.operators.ids import top_k
from glossa.plans.search import SearchRun, search
from glossa.session import scratch_root
from glossa.streaming.search import search_stream

# The third entry's definition holds its own headword.
OWN = [entry(0, "木杉", "ba1", ["wood"], 10), entry(1, "木", "da2", ["see 木杉 there"], 20), entry(2, "杉", "fa3", ["not 木杉"], 30)]


def kinds(run):
    return sorted((r["query_id"], r["entry_id"], r["match_type"]) for r in run.matches().collect())


@pytest.mark.parametrize("saved", [False, True])
def test_dedup_keeps_the_headword_match(make_lexicon, make_queries, saved):
    lexicon, queries = make_lexicon(OWN + [entry(3, "木杉", "ga1", ["the 木杉 tree"], 40)], saved=saved), make_queries(["木杉"])
    both = [(0, 0, "Traditional"), (0, 1, "English"), (0, 2, "English"), (0, 3, "English"), (0, 3, "Traditional")]
    for limit in (64 << 20, 0):
        assert kinds(SearchRun(queries, lexicon, broadcast_bytes=limit)) == both
        assert kinds(SearchRun(queries, lexicon, broadcast_bytes=limit, dedup=True)) == [b for b in both if b != (0, 3, "English")]


@pytest.mark.parametrize("saved", [False, True])
def test_strict_refuses_unknown_characters(make_lexicon, make_queries, saved):
    lexicon, queries = make_lexicon(OWN, saved=saved), make_queries(["木Ω", "木 杉", "木"])
    loose = kinds(SearchRun(queries, lexicon))
    assert kinds(SearchRun(queries, lexicon, strict=True)) == [m for m in loose if m[0] != 0]
    assert any(m[0] == 0 for m in loose) and any(m[0] == 1 for m in loose)


def test_page_sizes_have_no_end(spark, make_lexicon):
    presses = [0, 1, 28, 40, 58, 59, 60, 200]
    got = spark.createDataFrame([(p,) for p in presses], "p bigint").select("p", page_size(12, F.col("p")).alias("k"))
    assert {r["p"]: r["k"] for r in got.collect()} == {p: min(12 * 2**p, LARGEST) for p in presses} == {p: page_size_of(12, p) for p in presses}
    queries = got.select(F.col("p").alias("query_id"), F.lit("fu").alias("query"), "k")
    counts = {r["query_id"]: r["count"] for r in search(queries, make_lexicon(LEX_C)).groupBy("query_id").count().collect()}
    assert counts == dict.fromkeys(presses, 2)


def test_top_k_by_its_own_k(spark):
    rows = [(g, i, k) for g, k in ((1, 5), (2, 5000), (3, 0)) for i in range(7000)]
    df = spark.createDataFrame(rows, "g int, v int, k bigint").repartition(3)
    ranked = top_k(df, "g", ["v"], "k", 5000)
    assert {r["g"]: r["count"] for r in ranked.groupBy("g").count().collect()} == {1: 5, 2: 5000}
    assert ranked.filter("v <> rank - 1").count() == 0
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_stream_leaves_no_tables(spark, make_lexicon, make_queries, tmp_path):
    lexicon, queries = make_lexicon(LEX_A), make_queries(["lou", "teacher", "saa", "xyz"])
    source = str(tmp_path / "in")
    queries.repartition(4).write.parquet(source)
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    seen = []
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = search_stream(stream, lexicon, lambda ranked, i: seen.append(ranked.count())).option("checkpointLocation", str(tmp_path / "cp"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None and sum(seen) == 3
    assert {d for d in os.listdir(root) if d.startswith("cut-")} <= before
