"""Lexicons, queries and source tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import syllables
from glossa.session import scratch_path
from glossa.sources.tables import Lexicon

LEX_SQL = """
select p_partkey entry_key,
       translate(substring(p_brand,6),'#0123456789','品零一二三四五六七八九') headword,
       array_join(transform(split(p_name,' '), (w,i) -> concat(w, cast((p_size+i+1)%6+1 as string))),' ') reading,
       array(p_name,p_type,p_brand) definitions, p_size*100 static_cost,
       if(p_partkey%2=0,'A','B') source
from {part}
"""
LDOC_SQL = """
select doc_id entry_key, filter(transform(split(text,'\\n'), x->trim(x)), x->x<>'') definitions,
       cast(n_chars as int) static_cost, lang source from {documents}
"""

QSET = [
    (1, "widget", 12),
    (2, "cold wid", 12),
    (3, "widget cold", 12),
    (4, "bolt3", 12),
    (5, "WIDGET", 5),
    (6, "wdget", 12),
    (7, "gea", 12),
    (8, "Brand#13", 12),
    (9, "economy", 12),
    (10, "small ring", 5),
    (11, "xyz", 12),
    (12, "old old", 12),
    (13, "一三", 12),
    (14, "三", 5),
    (15, "三Ω", 12),
    (16, "economy widget", 12),
    (17, "t econ", 12),
    (18, "tecon", 12),
]
QDOC = [(1, "and the", 12), (2, "ü", 12), (3, "über", 12), (4, "tion", 5), (5, "la que", 12)]
QUERY_SCHEMA = "query_id bigint, query string, k int"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Files of less than one split in all, maybe a single row group, are spread over the cores.

    Byte ranges tell nothing of that: a row group belongs to one of them, whatever their number.
    """
    path = f"{sf.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= split else df


def lex(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(LEX_SQL, part=table(spark, sf, "part"))


def ldoc(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(LDOC_SQL, documents=table(spark, sf, "documents"))


def entries(rows: DataFrame) -> DataFrame:
    """Fixture rows as lexicon entries; the key serves as the id."""
    headword = F.col("headword") if "headword" in rows.columns else F.lit("")
    reading = F.col("reading") if "reading" in rows.columns else F.lit("")
    return rows.select(
        F.col("entry_key").alias("entry_id"),
        headword.alias("headword"),
        syllables(reading).alias("syllables"),
        "definitions",
        F.col("static_cost").cast("int").alias("static_cost"),
        "source",
    )


#: Where this process has saved the lexicons of a table folder, by session and name.
_SAVED: dict[tuple[str, str, str], str] = {}


def _saved(spark: SparkSession, sf: str, name: str, rows) -> Lexicon:
    """The lexicon as a user would have it: built and saved once, then loaded for each search."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SAVED:
        path = scratch_path(spark, name)
        Lexicon.from_entries(entries(rows(spark, sf))).save(path)
        _SAVED[key] = path
    return Lexicon.load(spark, _SAVED[key])


def lex_lexicon(spark: SparkSession, sf: str) -> Lexicon:
    return _saved(spark, sf, "lex", lex)


def ldoc_lexicon(spark: SparkSession, sf: str) -> Lexicon:
    return _saved(spark, sf, "ldoc", ldoc)


def literal_queries(spark: SparkSession, rows=QSET) -> DataFrame:
    return spark.createDataFrame(rows, QUERY_SCHEMA)


def qset(spark: SparkSession, sf: str) -> DataFrame:
    """The listed queries and one per distinct part name, so that they grow with the table."""
    names = table(spark, sf, "part").groupBy("p_name").agg((F.min("p_partkey") + 1000).alias("query_id"))
    return literal_queries(spark).unionByName(
        names.select("query_id", F.col("p_name").alias("query"), F.lit(12).alias("k"))
    )


def cfreq(spark: SparkSession, sf: str) -> DataFrame:
    """Character counts of the documents with cumulative percentages.

    One row per distinct character, so no more than there are code points:
    the two running totals over it may use one task.
    """
    chars = table(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("ch"))
    counts = chars.filter(F.col("ch").rlike(r"[^\x00-\x20]")).groupBy("ch").agg(F.count("*").alias("cnt"))
    return spark.sql(
        """
        with r as (select row_number() over (order by cnt desc, ch) idx, ch, cnt,
                          sum(cnt) over (order by cnt desc, ch rows unbounded preceding) rc,
                          sum(cnt) over () tot from {counts})
        select idx, ch, cnt, round(100.0D*rc/tot,6) cum_pct from r
        """,
        counts=counts,
    )
