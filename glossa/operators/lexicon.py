"""The relational steps of a lexicon build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.costs import DEFAULT_COSTS, CostModel
from glossa.functions.scoring import frequency_cost, heuristic_cost
from glossa.functions.text import (
    block_words,
    characters,
    definition_block,
    fold,
    search_block,
    syllable_tokens,
)
from glossa.operators.ids import dense_ids, with_previous
from glossa.operators.joins import salted_join
from glossa.session import cut


# --- character frequencies -------------------------------------------------


def last_wins(char_rows: DataFrame) -> DataFrame:
    """One row per character, the last in file order."""
    cols = [c for c in char_rows.columns if c not in ("ch", "line_no")]
    return (
        char_rows.groupBy("ch")
        .agg(F.max_by(F.struct(*cols), "line_no").alias("r"))
        .select("ch", *[F.col(f"r.{c}").alias(c) for c in cols])
    )


def char_frequencies(char_rows: DataFrame, costs: CostModel = DEFAULT_COSTS) -> DataFrame:
    """(ch, idx, count, frequency, cost) from cumulative percentages in file order."""
    stepped = with_previous(char_rows, ["line_no"], "cum_pct", "prev_pct", 0.0)
    frequency = ((F.col("cum_pct") - F.col("prev_pct")).cast("float") / F.lit(100.0).cast("float")).cast("float")
    rows = stepped.withColumn("frequency", frequency).withColumn("cost", frequency_cost(F.col("frequency"), costs))
    return last_wins(rows.select("line_no", "ch", "idx", "count", "frequency", "cost"))


def backfill_frequencies(freq: DataFrame, chars: DataFrame) -> DataFrame:
    """Add a default row for each of ``chars`` that has none."""
    # Count, frequency, cost and index of a character that was not seen.
    unseen = chars.select("ch").distinct().join(freq, "ch", "left_anti").select(
        "ch",
        F.lit(10_000).alias("idx"),
        F.lit(1).alias("count"),
        F.lit(0.001).cast("float").alias("frequency"),
        F.lit(10_000).alias("cost"),
    )
    return freq.select("ch", "idx", "count", "frequency", "cost").unionByName(unseen)


def headword_char_costs(headwords: DataFrame, freq: DataFrame, costs: CostModel = DEFAULT_COSTS) -> DataFrame:
    """(headword, char_cost) for distinct headwords.

    ``freq`` has one row per Unicode code point at most (1,114,112), so its two
    columns may be broadcast.
    """
    per_char = headwords.distinct().select("headword", F.explode(characters(F.col("headword"))).alias("ch"))
    return (
        per_char.join(F.broadcast(freq.select("ch", "cost")), "ch", "left")
        .groupBy("headword")
        .agg(F.sum(F.coalesce("cost", F.lit(costs.max_char_cost))).alias("char_cost"))
    )


# --- readings --------------------------------------------------------------


def first_readings(readings: DataFrame) -> DataFrame:
    return readings.groupBy("headword").agg(F.min_by("reading", "line_no").alias("first_reading"))


def annotate(entries: DataFrame, readings: DataFrame) -> DataFrame:
    """Replace each entry's reading by the first one listed for its headword, if any."""
    return (
        salted_join(entries, first_readings(readings), "headword", "left")
        .withColumn("reading", F.coalesce("first_reading", "reading"))
        .drop("first_reading")
    )


def grouped_ci(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Per ``key`` the values in file order, later ASCII-case variants dropped.

    Variants are folded away with map-side combine before anything is
    collected, so a hot key brings only its distinct values to one task.
    """
    firsts = rows.groupBy(key, fold(F.col(value)).alias("_f")).agg(
        F.min(F.struct(F.col("line_no"), F.col(value).alias("v"))).alias("r")
    )
    return firsts.groupBy(key).agg(F.sort_array(F.collect_list("r")).alias("rs")).select(
        key, F.transform("rs", lambda r: r["v"]).alias(name)
    )


# --- static costs ----------------------------------------------------------


def romanised_cost(reading, definitions, costs: CostModel = DEFAULT_COSTS):
    return (
        F.size(syllable_tokens(reading)) * costs.romanised_per_syllable
        + costs.romanised_base
        + heuristic_cost(definitions)
    )


def missing_reading_cost(reading, costs: CostModel = DEFAULT_COSTS):
    return F.when(reading == "", costs.missing_reading).otherwise(0)


# --- vocabularies ----------------------------------------------------------


def definition_words(definitions):
    """Distinct whitespace-separated words of the folded definition block.

    Query terms hold no whitespace, so a term occurs in the block exactly if it
    occurs in one of these words.
    """
    return block_words(search_block(definitions))


def syllable_keys(syl):
    return F.array_distinct(syl["base"])


def headword_keys(headword):
    return F.array_distinct(characters(headword))


def key_counts(entries: DataFrame, keys, name: str) -> DataFrame:
    """(name, n_entries): in how many entries each key occurs."""
    return (
        entries.select(F.explode(keys).alias(name)).groupBy(name).agg(F.count("*").alias("n_entries"))
    )


def vocabulary_ids(vocabulary: DataFrame, name: str, id_name: str) -> DataFrame:
    return dense_ids(vocabulary.select(name).distinct(), [name], id_name)


def encode(entries: DataFrame, characters_ids: DataFrame, syllable_ids: DataFrame) -> DataFrame:
    """(entry_id, kind, pos, id, tone): headword characters and syllables as vocabulary ids.

    Character ids are bounded by the number of code points and broadcast;
    syllables are joined without a hint.
    """
    chars = entries.select("entry_id", F.posexplode(characters(F.col("headword"))).alias("pos", "ch"))
    syl = entries.select("entry_id", F.posexplode("syllables").alias("pos", "s")).select(
        "entry_id", "pos", F.col("s.base").alias("base"), F.col("s.tone").alias("tone")
    )
    return (
        chars.join(F.broadcast(characters_ids), "ch")
        .select("entry_id", F.lit("char").alias("kind"), "pos", F.col("char_id").alias("id"), F.lit(None).cast("int").alias("tone"))
        .unionByName(
            salted_join(syl, syllable_ids, "base").select(
                "entry_id", F.lit("syllable").alias("kind"), "pos", F.col("base_id").alias("id"), "tone"
            )
        )
    )


def definition_offsets(entries: DataFrame, order_by: list[str]) -> DataFrame:
    """(.., start): byte offset of each entry's definitions in one running text.

    Running total over the whole lexicon: totals per range partition first,
    then a local running sum, like ``dense_ids``.
    """
    cols = [F.col(c) for c in order_by]
    size = F.octet_length(definition_block(F.col("definitions"))).cast("bigint")
    tagged = cut(
        entries.select(*order_by, size.alias("bytes"))
        .repartitionByRange(*cols)
        .withColumn("_part", F.spark_partition_id())
    )
    totals = tagged.groupBy("_part").agg(F.sum("bytes").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.withColumn("_local", F.coalesce(F.sum("bytes").over(local), F.lit(0)))
        .join(F.broadcast(bases), "_part")
        .select(*order_by, "bytes", (F.col("_base") + F.col("_local")).alias("start"))
    )
