"""Work that must not grow faster than the input: counts of rows, and of what a row computes."""

from pyspark.sql import functions as F

from glossa import fixtures as fx
from glossa.functions import spans, text
from glossa.operators import joins, postings, terms
from glossa.plans import indexed
from glossa.plans.search import SearchRun, query_terms


def test_running_totals_compute_their_elements_once(spark):
    """Bound once, or each chunk of a long text would compute all elements anew."""
    rows = spark.createDataFrame([([1] * 1000,)], "xs array<int>")
    for total, last in ((text.totals_before, 7 * 999), (text.running_max, 7)):
        df = rows.select(total(F.transform("xs", lambda x: x * 7)).alias("t"))
        assert df._jdf.queryExecution().analyzed().toString().count("* 7") == 1
        assert df.first()["t"][-1] == last


def test_postings_are_made_once(spark, tmp_path):
    log = str(tmp_path / "log")

    @F.udf("string")
    def key(i):
        with open(log, "a") as f:
            f.write("x")
        return f"k{i % 7}"

    rows = spark.range(100).select(key("id").alias("key"), F.col("id").alias("entry_id"), F.lit(1).alias("static_cost"))
    (tmp_path / "saved").mkdir()
    assert postings.save_postings(rows, str(tmp_path / "saved" / "made"), "errorifexists", 30) == 4
    assert len(open(log).read()) == 100 and [p.name for p in (tmp_path / "saved").iterdir()] == ["made"]
    assert spark.read.parquet(str(tmp_path / "saved" / "made")).count() == 100


def test_short_and_long_queries_agree(spark, make_lexicon, make_queries, monkeypatch):
    rows = [(i, "", [(w, t) for t, w in enumerate(("lou", "si", "gau", "fan")[: 1 + i % 4])], [f"some old {w} here" for w in ("cat", "dog", "cold tea")[: 1 + i % 3]], i, "A") for i in range(40)]
    lexicon, queries = make_lexicon(rows, saved=True), make_queries(["cat", "old cat", "lou si", "si lou0", "dog old cat here", "old old", "lo", "si si si si"])
    got = []
    for slots in (4, 0):
        monkeypatch.setattr(indexed, "SLOTS", slots)
        with SearchRun(queries, lexicon) as run:
            got.append(sorted(map(tuple, run.matches().collect())))
    assert got[0] == got[1] and len(got[0]) > 50


def test_text_does_not_travel_with_its_hits(spark):
    needles = spark.createDataFrame([("abcd",), ("xyz",)], "needle string")
    lines = spark.createDataFrame([("abcd " * 50,), ("xyy abd",), ("nothing",)], "key string")
    pairs = joins.local_levenshtein_pairs(needles, lines, 1)
    assert sorted((r["needle"], r["key"][:3], r["distance"]) for r in pairs.collect()) == [("abcd", "abc", 0), ("abcd", "xyy", 1), ("xyz", "xyy", 1)]
    grouped = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert grouped and not any("key#" in line for line in grouped)


def test_scanned_texts_have_the_same_pairs(spark, monkeypatch):
    import random

    rng = random.Random(1)
    some = lambda most, n: sorted({"".join(rng.choices("ab.é\n(😀", k=rng.randint(1, most))) for _ in range(n)})
    terms = spark.createDataFrame([(t,) for t in some(5, 30)] + [("",)], "needle string")
    texts = spark.createDataFrame([(t,) for t in some(9, 150)] + [("",), (None,)], "key string")
    found = lambda: joins.local_levenshtein_pairs(terms, texts, 1)
    joined = found()
    monkeypatch.setattr(joins, "SCAN_BYTES", 0)
    scanned = found()
    assert scanned.schema.simpleString() == joined.schema.simpleString()
    assert sorted(map(tuple, scanned.collect())) == sorted(map(tuple, joined.collect())) and scanned.count() > 500
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # No row for each place of a piece, and nothing is shuffled.
    assert "sequence(" in plan(joined) and "sequence(" not in plan(scanned) and "Join" not in plan(scanned)


def test_hits_are_dealt_by_their_number(spark):
    asked = spark.createDataFrame([(q, 0, "a", None) for q in range(20)] + [(99, 0, "b", 2)], "query_id bigint, term_idx int, term_base string, tone int")
    matches = spark.createDataFrame([("a", "ab", 5), ("a", "ac", 3), ("b", "ab", 1)], "term_base string, base string, match_cost int")
    entries = spark.range(300).select(F.col("id").alias("entry_id"), F.expr("array(named_struct('base', 'ab', 'tone', int(id % 3)), named_struct('base', 'ac', 'tone', 1))").alias("syllables"))
    want = sorted([(q, 0, e, 3, 1) for q in range(20) for e in range(300)] + [(99, 0, e, 1, 0) for e in range(300) if e % 3 == 2])
    for limit in (1 << 20, 0):
        got = terms.best_term_positions(asked, matches, entries, hits_per_task=100, limit=limit)
        assert sorted(map(tuple, got.collect())) == want
    tasks = terms.best_term_positions(asked, matches, entries, hits_per_task=100).rdd.getNumPartitions()
    assert tasks == 9  # 900 hits


def test_assignment_of_differing_best_syllables(spark):
    rows = spark.createDataFrame(
        [("lou si", [("si", 1), ("lou", 2)]), ("si si", [("si", 1), ("si", 2)]), ("lou lou", [("lou", 1), ("si", 2)]), ("si3 lou", [("si", 3), ("lou", 2), ("si", 3)])],
        "q string, syl array<struct<base:string,tone:int>>",
    )
    path = spans.assign_syllables(query_terms(F.col("q")), F.col("syl"))
    assert [r["p"] for r in rows.coalesce(1).select(path.alias("p")).collect()] == [[1, 0], [0, 1], None, [0, 1]]


def test_pages_search_the_last_one_once(spark, monkeypatch, tmp_path):
    from workload import queries as q

    part = [(i, f"{a} {b}", f"Brand#{i % 5}", "ECONOMY", i % 9, 1.0) for i, (a, b) in enumerate([("cold", "ring"), ("hot", "bolt")] * 40)]
    spark.createDataFrame(part, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    made = []

    class Run(SearchRun):
        def __init__(self, queries, *args, **kw):
            made.append(queries.count())
            super().__init__(queries, *args, **kw)

    monkeypatch.setattr(q, "SearchRun", Run)
    rows = q.search_pages(spark, str(tmp_path)).collect()
    assert made == [len(fx.QSET) + 2]  # not three times as many
    of = lambda i: sorted((r["rank"], r["entry_id"], r["k"], r["has_more"]) for r in rows if r["query_id"] == i)
    first, last = of(10000), of(10002)
    assert [r[:2] for r in first] == [r[:2] for r in last[:12]] and len(first) == 12 and len(last) == 40
    assert {r[2:] for r in first} == {(12, 1)} and {r[2:] for r in last} == {(48, 0)}


def test_spans_of_lines_that_hold_a_term(spark, tmp_path):
    from workload import queries as q

    docs = [(1, "x And y\nno match here\nüber uns", "en", "s", 3), (2, None, None, None, None), (3, "THE QUE la", "fr", "s", 9)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["query_id"], r["entry_key"], r["def_idx"], r["spans"]) for r in q.spans_english(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0, "2-5"), (1, 3, 0, "0-3"), (2, 1, 2, "0-2"), (3, 1, 2, "0-5"), (5, 3, 0, "4-10")]
    plan = q.spans_english(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "<> )" not in plan.replace("'", "")
