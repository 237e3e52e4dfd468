import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .appName("glossa-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


ENTRY = (
    "entry_id bigint, headword string, syllables array<struct<base:string,tone:int>>, "
    "definitions array<string>, static_cost int, source string"
)


def entry(i, headword, reading, definitions, cost, source="CEDict"):
    syl = [(w[:-1], int(w[-1])) for w in reading.split()]
    return (i, headword, syl, definitions, cost, source)


# Three small lexicons whose search results are known.
LEX_A = [entry(0, "老師", "lou5 si1", ["teacher"], 100), entry(1, "學生", "hok6 saang1", ["student"], 100)]
LEX_B = [entry(0, "學師", "aa3 baa1", ["father"], 0)]
LEX_C = [
    entry(0, "虎", "fu2", ["tiger", "CL:隻|只[zhi1]"], 2165),
    entry(1, "一並", "jat1 bing6", ["variant of 一併|一并, to lump together", "to treat along with all the others"], 16869),
    entry(2, "虎", "fu2", ["(slang) wife (who is savage and mean usually)"], 23000, "CCanto"),
]


@pytest.fixture(scope="session")
def make_lexicon(spark, tmp_path_factory):
    from glossa.sources.tables import Lexicon

    def make(rows, files=1, saved=False):
        """A lexicon that is scanned, or one saved with posting tables of several shards."""
        path = str(tmp_path_factory.mktemp("lexicon") / "entries")
        spark.createDataFrame(rows, ENTRY).repartition(files).write.parquet(path)
        lexicon = Lexicon.from_entries(spark.read.parquet(path))
        if not saved:
            return lexicon
        lexicon.save(path + "-saved", rows_per_shard=100)
        return Lexicon.load(spark, path + "-saved")

    return make


@pytest.fixture(scope="session")
def make_queries(spark):
    def make(texts, k=8):
        rows = [(i, t, k) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "query_id bigint, query string, k int").coalesce(1)

    return make
