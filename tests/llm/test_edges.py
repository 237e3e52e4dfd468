"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossa.llm import decontamination, fingerprints, html_extract, packing, pii, quality, secret_scan, sharding, simhash, toxicity

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
ROWS = [
    (1, "A plain text, with a few words in it.\n\nAnd a second paragraph."),
    (2, None),
    (3, ""),
    (None, "no id here"),
    (4, LONG),
    (5, "said twice"),
    (5, "said twice"),
    (6, "\x00 ퟿ €uro \U0001f600 <|endoftext|>"),
    (7, "x" * 50_000),
]
LABELS = [(1, 1, 0), (4, 1, 0), (5, 0, 1), (None, 1, None), (9, None, 1), (6, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    extra = {c: F.lit(7) for c in ("class", "row", "w0", "_text", "shard", "score", "slot", "token", "_keep_id", "_bad_id", "h", "pos", "held")}
    return df.withColumns({"lang": F.when(F.col("doc_id") > 2, "en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("bigint"), **extra})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "short one"), (4, ROWS[0][1])], "item_id bigint, text string")


def per_row(docs, labels):
    yield sharding.shard_documents(docs)
    yield fingerprints.fingerprint_documents(docs)
    yield simhash.simhash_components(docs)
    yield secret_scan.scan(docs)
    yield quality.classify(docs, labels)
    yield pii.personal_data(docs)
    yield toxicity.toxicity(docs, labels)


def test_a_row_per_document(docs, labels):
    for out in per_row(docs, labels):
        ids = sorted((r["doc_id"] for r in out.collect()), key=lambda i: (i is None, i))
        assert ids == [1, 2, 3, 4, 5, 5, 6, 7, None], out.columns


def test_no_rows(docs, labels, benchmark):
    none, unlabelled = docs.filter("false"), labels.filter("false")
    for out in per_row(none, labels):
        assert out.count() == 0
    for out in (packing.pack_documents(none), decontamination.contaminated(none, benchmark)):
        assert out.count() == 0
    assert decontamination.contaminated(docs, benchmark.filter("false")).count() == 0
    assert toxicity.toxicity(docs, unlabelled).filter("predicted = 1").count() == 0
    assert quality.classify(docs, unlabelled).count() == len(ROWS)


def test_packing_holds_every_row(docs):
    pieces = packing.pack_documents(docs)
    assert pieces.filter("start = 0").count() == len(ROWS)
    totals = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert all(r["n"] == r["d"] * (2 if r["doc_id"] == 5 else 1) for r in totals)


def test_contaminated(docs, benchmark):
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()] == [(1, 4)]
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1


def test_one_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # The null and the empty text are alike, as are the repeated rows.
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=lambda i: (i is None, i)) == [1, 2, 4, 5, 6, 7, None]


def test_redaction_keeps_rows(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.filter("text is null").count() == 1 and out.filter("_text <> 7").count() == 0


def test_pages(spark):
    rows = [(1, "http://a.example/1", None), (2, None, ""), (None, "http://a.example/1", "<p>x"), (3, "http://a.example/1", "no tags &amp; all"), (3, "http://a.example/1", "no tags &amp; all")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit(1), "text": F.lit(2), "token": F.lit(3)})
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect())
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "no tags & all", 13), (3, "no tags & all", 13)]
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_stages(spark, docs, labels, benchmark, tmp_path):
    for name, t in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} >= {2, 4, 6, 7, None}
