"""Registered queries of this subpackage, each over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.collocations import collocations
from glossa.llm.common import read
from glossa.llm.decontamination import contaminated
from glossa.llm.fingerprints import fingerprint_documents
from glossa.llm.hard_negatives import hard_negatives
from glossa.llm.html_extract import extract
from glossa.llm.packing import pack_documents
from glossa.llm.pii import personal_data
from glossa.llm.quality import classify
from glossa.llm.repeats import remove_repeats
from glossa.llm.secret_scan import scan
from glossa.llm.sharding import shard_documents
from glossa.llm.simhash import simhash_components
from glossa.llm.toxicity import toxicity


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark")).drop("crc")


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(read(spark, sf, "documents"))


def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf, "documents"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(read(spark, sf, "documents"))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(read(spark, sf, "documents"))


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return scan(read(spark, sf, "documents"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return classify(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op8_html(spark: SparkSession, sf: str) -> DataFrame:
    return extract(read(spark, sf, "pages"))


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(read(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(read(spark, sf, "documents")).drop("kept")


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(read(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_sharding,
        op3_fingerprints,
        op4_simhash,
        op5_packing,
        op6_secrets,
        op7_quality,
        op8_html,
        op9_pii,
        op10_toxicity,
        op11_hard_negatives,
        op12_repeats,
        op13_collocations,
    )
}

#: The anchors are a stated set of queries against all rows; inner products of whole numbers are exact in doubles.
OP11_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
s as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same,
         list_dot_product(a.q, c.q)::bigint as score
  from e a join e c on a.vec_id <> c.vec_id
  where a.vec_id % 100 = 0
),
p as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as i from s where same) where i <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
from (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from p join s n on n.anchor_id = p.anchor_id and not n.same
   and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
where rank <= 10
"""

OP13_SQL = """
with d as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
),
w as (select lang, [x for x in string_split_regex(piece, '[\\x20\\x09]+') if x <> ''] as ws from d),
f1 as (select lang, p, count(*) as f from (select lang, unnest(ws) as p from w) group by all),
f2 as (
  select lang, w1, w2, count(*) as f
  from (select lang, ws[i] as w1, ws[i + 1] as w2 from (select lang, ws, unnest(range(1, len(ws))) as i from w)) group by all
),
f3 as (
  select lang, w1, w2, w3, count(*) as f
  from (select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3 from (select lang, ws, unnest(range(1, len(ws) - 1)) as i from w)) group by all
  having count(*) >= 10
),
around as (
  select lang, w1, w2, max(f) as longer
  from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all
),
cuts as (
  select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.f as a, 1 as k, x.f as l, y.f as r
  from f2 join f1 x on x.lang = f2.lang and x.p = f2.w1 join f1 y on y.lang = f2.lang and y.p = f2.w2
  left join around o on o.lang = f2.lang and o.w1 = f2.w1 and o.w2 = f2.w2
  where f2.f >= 10 and (o.longer is null or 100 * o.longer < 50 * f2.f)
  union all
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  from f3 join f1 x on x.lang = f3.lang and x.p = f3.w1 join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
  union all
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  from f3 join f2 x on x.lang = f3.lang and x.w1 = f3.w1 and x.w2 = f3.w2 join f1 y on y.lang = f3.lang and y.p = f3.w3
),
scored as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts),
chosen as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as i from scored) where i = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from chosen)
select ranked.lang, rank, phrase, a, l, r, t.n, score
from ranked join (select lang, sum(f)::bigint as n from f1 group by lang) t on t.lang = ranked.lang
where rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op13_collocations": OP13_SQL}
