"""Text sources to lexicon tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.costs import DEFAULT_COSTS, MAX_TONE, SOURCE_BILINGUAL, SOURCE_ROMANISED, CostModel
from glossa.functions.scoring import heuristic_cost
from glossa.functions.text import definition_block, syllables
from glossa.operators import lexicon as ops
from glossa.operators.ids import dense_ids
from glossa.operators.joins import salted_join
from glossa.sources import files
from glossa.sources.tables import Lexicon

ORDER = ["static_cost", "src_order", "line_no"]


@dataclass(frozen=True)
class Build:
    lexicon: Lexicon
    rejects: DataFrame


def bilingual_entries(parsed: DataFrame, readings: DataFrame, freq: DataFrame, costs: CostModel = DEFAULT_COSTS) -> DataFrame:
    """Readings and character costs both hang on the headword, so one join brings both."""
    info = ops.headword_char_costs(parsed.select("headword"), freq, costs).join(
        ops.first_readings(readings), "headword", "left"
    )
    joined = salted_join(parsed, info, "headword", "left")
    return joined.select(
        "line_no",
        F.lit(0).alias("src_order"),
        "headword",
        F.coalesce("first_reading", F.lit("")).alias("reading"),
        "definitions",
        F.lit(SOURCE_BILINGUAL).alias("source"),
        (F.coalesce("char_cost", F.lit(0)) + heuristic_cost(F.col("definitions"))).cast("int").alias("cost"),
    )


def romanised_entries(parsed: DataFrame, costs: CostModel = DEFAULT_COSTS) -> DataFrame:
    return parsed.select(
        "line_no",
        F.lit(1).alias("src_order"),
        "headword",
        "reading",
        "definitions",
        F.lit(SOURCE_ROMANISED).alias("source"),
        ops.romanised_cost(F.col("reading"), F.col("definitions"), costs).cast("int").alias("cost"),
    )


def build_from_lines(
    bilingual: DataFrame,
    romanised: DataFrame,
    readings: DataFrame,
    char_freq: DataFrame,
    costs: CostModel = DEFAULT_COSTS,
) -> Build:
    freq = ops.char_frequencies(files.parse_char_freq(char_freq), costs)
    parsed_readings = files.parse_readings(readings)
    entries = bilingual_entries(files.parse_bilingual(bilingual), parsed_readings, freq, costs).unionByName(
        romanised_entries(files.parse_romanised(romanised), costs)
    )
    entries = entries.withColumn(
        "static_cost", (F.col("cost") + ops.missing_reading_cost(F.col("reading"), costs)).cast("int")
    ).withColumn("syllables", syllables(F.col("reading")))
    bad_tone = F.exists("syllables", lambda s: s["tone"] > MAX_TONE)
    good = dense_ids(entries.filter(~bad_tone), ORDER, "entry_id")
    rejected = [
        files.rejects(bilingual, files.BILINGUAL, "bilingual line"),
        files.rejects(romanised, files.ROMANISED, "romanised line"),
        files.rejects(readings, files.READINGS, "reading line"),
        files.rejects(char_freq, files.CHAR_FREQ, "character frequency line"),
    ]
    out = entries.filter(bad_tone).select(
        "line_no", F.concat_ws(" ", "headword", "reading").alias("line"), F.lit("tone out of range").alias("reason")
    )
    for r in rejected:
        out = out.unionByName(r.select("line_no", "line", "reason"))
    return Build(Lexicon.from_entries(good), out)


def build_lexicon(
    spark: SparkSession, bilingual: str, romanised: str, readings: str, char_freq: str, costs: CostModel = DEFAULT_COSTS
) -> Build:
    """Build from the paths of the four text sources."""
    return build_from_lines(*(files.read_lines(spark, p) for p in (bilingual, romanised, readings, char_freq)), costs)


def build_report(lexicon: Lexicon) -> DataFrame:
    """One row of build statistics."""
    e = lexicon.entries.agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.col("source") == SOURCE_BILINGUAL).alias("n_bilingual"),
        F.count_if(F.col("source") == SOURCE_ROMANISED).alias("n_romanised"),
        F.sum(F.size("definitions")).cast("bigint").alias("n_definitions"),
        F.sum(F.octet_length(definition_block(F.col("definitions")))).cast("bigint").alias("definition_bytes"),
        F.sum(F.size("syllables")).cast("bigint").alias("n_syllable_positions"),
    )
    # Three one-row tables side by side.
    chars = lexicon.characters.agg(F.count("*").alias("n_characters")).scalar()
    bases = lexicon.syllables.agg(F.count("*").alias("n_syllables")).scalar()
    return e.withColumn("n_characters", chars).withColumn("n_syllables", bases)
