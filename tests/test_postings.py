"""Posting tables: places of words, pruning by key, and searches that read no text."""

import random

from pyspark.sql import functions as F

from conftest import ENTRY, entry
from glossa.functions.text import search_block
from glossa.operators import postings
from glossa.operators.ids import top_k
from glossa.plans import indexed
from glossa.plans.search import KINDS, SearchRun
from glossa.sources.tables import Lexicon

WORDS = ["a", "über", "ab-c", "日本", "x", "the", "The", "\t", "", "end."]


def lexicon_rows(n, seed=1):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 150)))
    return [entry(i, "山川"[: i % 3], "ka1 lo2 ka3", [text() for _ in range(rng.randint(0, 3))], i) for i in range(n)]


def files_read(df):
    """What the scans of the executed plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            found.append((node.metrics().apply("numFiles").value(), node.schema().simpleString()))
        it = node.children().iterator()
        while it.hasNext():
            walk(it.next())

    walk(plan)
    return found


def test_places_of_words(spark):
    rows = lexicon_rows(40) + [entry(99, "", "", [], 0), entry(98, "", "", ["wort " * 5000], 0)]
    df = spark.createDataFrame(rows, ENTRY)
    blocks = {r["entry_id"]: r["b"] for r in df.select("entry_id", search_block(F.col("definitions")).alias("b")).collect()}
    got = {(r["key"], r["entry_id"]): (r["at_char"], r["at_byte"]) for r in postings.word_postings(df).collect()}
    want = {}
    for i, block in blocks.items():
        for word in {w for w in block.split(" ") if w}:
            at = f" {block} ".find(f" {word} ")  # the place of the word itself: one blank was put in front
            want[word, i] = (at + 1, len(block[:at].encode()))
    assert got == want


def test_places_of_words_by_columns(spark):
    """Texts of several sizes are cut up together or alone; nothing of a batch depends on another text."""
    rng = random.Random(3)
    rows = [r for r in lexicon_rows(30, 4)] + [entry(None, "", "", ["A\tB\na", "Éa ÉA"], None), entry(5, "", "", ["x" * 90 + " Z\rz\f😀 😀"], 1)]
    rows += [(70, "", [], None, 2, "A"), (71, "", [], [None, "a b"], 2, "A")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ENTRY).coalesce(1)
    want = []
    for i, cost, block in df.select("entry_id", "static_cost", search_block(F.col("definitions"))).collect():
        for w in {w for w in block.split(" ") if w}:
            at = f" {block} ".find(f" {w} ")
            want.append((w, i, cost, at + 1, len(block[:at].encode())))
    for size in (1, 200, 1 << 20):
        made = postings.word_postings(df, block_bytes=size)
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_pair_comes_once_for_a_gram_that_comes_again(spark):
    from glossa.operators.joins import containment_pairs

    needles = spark.createDataFrame([("na",), ("anan",), ("a",), ("😀😀",), ("é",), ("",)], "needle string")
    keys = spark.createDataFrame([("bananana",), ("😀😀😀x",), ("éa",), ("",), ("n",)], "key string")
    want = [("a", "bananana"), ("a", "éa"), ("anan", "bananana"), ("na", "bananana"), ("é", "éa"), ("😀😀", "😀😀😀x")]
    for small in (True, False):
        pairs = containment_pairs(needles, keys, small).select("needle", "key")
        assert sorted(map(tuple, pairs.collect())) == want
        assert "regexp_extract_all" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_only_shards_of_the_keys_asked_are_read(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")).alias("key"), F.col("id").alias("entry_id"), F.lit(1).alias("static_cost"))
    shards = postings.save_postings(rows, str(tmp_path / "p"), "errorifexists", rows_per_shard=100)
    assert shards == 40
    table = postings.load_postings(spark, str(tmp_path / "p"), "key string, entry_id bigint, static_cost int", shards)
    every = files_read(table.rows.filter("key <> ''"))[0][0]
    before = 0
    for n in (1, 5, 20):
        keys = [f"k{i}" for i in range(n)]
        asked = spark.createDataFrame([(k,) for k in keys], "key string").select(postings.shard_of(F.col("key"), shards).alias("s")).distinct().collect()
        found = table.of_shards([r["s"] for r in asked]).filter(F.col("key").isin(keys))
        assert found.count() == 8 * n
        ((read, _),) = files_read(found)
        assert before < read <= every * len(asked) / 20 + len(asked) and read < every
        before = read


def test_a_search_reads_no_definitions(make_lexicon, make_queries):
    rows = lexicon_rows(60, 2)
    run = SearchRun(make_queries(["über the", "ab", "nothing"]), make_lexicon(rows, saved=True), kinds=("English",))
    scans = files_read(run.matches())
    assert scans and not any("definitions" in schema for _, schema in scans)
    scanned = SearchRun(make_queries(["über the", "ab", "nothing"]), make_lexicon(rows), kinds=("English",))
    assert sorted(run.matches().collect()) == sorted(scanned.matches().collect())
    assert any("definitions" in schema for _, schema in files_read(scanned.matches()))


def test_the_best_are_sought_among_near_postings(spark, make_lexicon, make_queries, monkeypatch, tmp_path):
    rng = random.Random(5)
    syllables = [f"{a}{b}{c}" for a in "bdg" for b in "aou" for c in "nr"]
    text = lambda: " ".join("".join(rng.choices(syllables, k=rng.choice((1, 1, 2)))) + rng.choice(("", "", "-x", ".")) for _ in range(rng.randint(1, 30)))
    rows = [entry(i, "", "", [text(), text()], rng.choice((i * 37 % 900, 5000))) for i in range(200)]
    rows += [entry(400 + i, "山", "ban1 den2", [text()], i) for i in range(20)]  # found by syllables too
    # Ids that come twice, with costs far apart, or not at all, and entries without a static cost.
    rows += [entry(7, "", "", ["ban " + text()], 9), entry(7, "", "", [text() + " ban"], 90_000), entry(None, "", "", ["ban don"], 3), entry(None, "", "", [text() + " ban don"], 70_000)]
    rows += [entry(500 + i, "", "", [text() + " ban dun"], None) for i in range(3)]
    make_lexicon(rows).save(str(tmp_path / "lexicon"), rows_per_shard=2000)
    lexicon = Lexicon.load(spark, str(tmp_path / "lexicon"))
    queries = make_queries(["ban", "dun", "gor bar", "don don", "ést", "ban1 den", "bandun", "dun.", "g"], k=4)
    columns, order = ["query_id", "rank", "entry_id", "match_type", "total_cost"], ["total_cost", "static_cost", "entry_id", "match_type"]
    monkeypatch.setattr(indexed, "MANY_HITS", 50)
    for near, further, kinds, limit in ((100, 4, ("English",), 64 << 20), (400, 16, KINDS, 3000)):
        monkeypatch.setattr(indexed, "NEAR_ROWS", near)
        monkeypatch.setattr(indexed, "FURTHER", further)
        with SearchRun(queries, lexicon, kinds=kinds, broadcast_bytes=limit) as run:
            every = run.matches()
            want = sorted(map(repr, top_k(every, "query_id", order, "k", run.k_max).select(*columns).collect()))
            got = sorted(map(repr, run.ranked().select(*columns).collect()))
            assert got == want and len(got) > 20
            assert run.index.contenders().count() < every.count() * 0.7
