"""Streams give what a batch gives."""

from pyspark.sql import functions as F

from conftest import LEX_A
from glossa.plans.search import search
from glossa.streaming.search import search_stream
from glossa.streaming.sessions import page_size_stream
from test_operators import random_log, replay

COLUMNS = ["query_id", "rank", "entry_id", "match_type", "total_cost"]


def test_search_stream(spark, make_lexicon, make_queries, tmp_path):
    lexicon = make_lexicon(LEX_A)
    texts = ["lou", "teacher", "saa", "xyz", "老"]
    queries = make_queries(texts)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    queries.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def sink(ranked, batch_id):
        ranked.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = search_stream(stream, lexicon, sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 2
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(map(tuple, search(queries, lexicon).select(COLUMNS).collect()))


def test_page_size_stream(spark, tmp_path):
    log = random_log(3, 90)
    schema = "session bigint, t bigint, event_id bigint, query string"
    source = str(tmp_path / "in")
    for i in range(3):
        part = spark.createDataFrame(log[i * 30 : i * 30 + 30], schema).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000)).drop("t")
        part.coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = (
        page_size_stream(stream)
        .writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.table("pages").select("session", "event_id", "presses", "page_size")
    assert sorted(map(tuple, got.collect())) == replay(log)
    assert spark.table("pages").filter("late").count() == 0
