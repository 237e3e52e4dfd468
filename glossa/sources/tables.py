"""A built lexicon: its entries and the vocabularies that search starts from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.lexicon import definition_words, headword_keys, key_counts, syllable_keys
from glossa.operators.postings import KINDS, ROWS_PER_SHARD, Postings, load_postings, save_postings

# Fixed value: version of the table layout.
VERSION = 9

POSTINGS = {
    "words": "key string, entry_id bigint, static_cost int, at_char int, at_byte int",
    "syllables": "key string, entry_id bigint, static_cost int, n_syllables int, pos int, tone int",
    "characters": "key string, entry_id bigint, static_cost int",
}
KEY_NAMES = {"words": "word", "syllables": "base", "characters": "ch"}
ENTRY_COLUMNS = ("entry_id", "headword", "syllables", "definitions", "static_cost", "source")


@dataclass(frozen=True)
class Lexicon:
    """entries(entry_id, headword, syllables, definitions, static_cost, source) and three key counts.

    ``entry_id`` is unique; equal total costs are ranked by (static_cost, entry_id).
    A saved lexicon also has ``postings`` by the name of the key counts, and is
    searched through them without reading its entries. ``repeated`` are the
    ids that, against the above, more than one entry has.
    """

    entries: DataFrame
    syllables: DataFrame  # base, n_entries
    characters: DataFrame  # ch, n_entries
    words: DataFrame  # word, n_entries
    postings: dict[str, Postings] | None = None
    repeated: DataFrame | None = None  # entry_id

    @staticmethod
    def from_entries(entries: DataFrame) -> "Lexicon":
        entries = entries.select(*ENTRY_COLUMNS)
        return Lexicon(
            entries,
            key_counts(entries, syllable_keys(F.col("syllables")), "base"),
            key_counts(entries, headword_keys(F.col("headword")), "ch"),
            key_counts(entries, definition_words(F.col("definitions")), "word"),
        )

    def save(self, path: str, mode: str = "errorifexists", rows_per_shard: int = ROWS_PER_SHARD) -> None:
        spark = self.entries.sparkSession
        self.entries.sortWithinPartitions("static_cost", "entry_id").write.mode(mode).parquet(f"{path}/entries")
        entries = spark.read.parquet(f"{path}/entries")
        repeated = entries.groupBy("entry_id").agg(F.count("*").alias("n")).filter("n > 1").select("entry_id")
        repeated.write.mode(mode).parquet(f"{path}/repeated")
        shards = {}
        for name, made in KINDS.items():
            shards[name] = save_postings(made(entries), f"{path}/postings/{name}", mode, rows_per_shard)
            # One row per key and entry, or per place of it, so the counts come from the thin sorted rows.
            found = Postings(spark.read.schema(POSTINGS[name] + ", shard int").parquet(f"{path}/postings/{name}"), 0).rows
            counts = found.groupBy(F.col("key").alias(KEY_NAMES[name]))
            n = F.count_distinct("entry_id") if name == "syllables" else F.count("*")
            counts.agg(n.alias("n_entries")).write.mode(mode).parquet(f"{path}/{name}")
        meta = spark.range(1).select(F.lit(VERSION).alias("version"), *[F.lit(n).alias(f"{name}_shards") for name, n in shards.items()])
        meta.write.mode(mode).parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Lexicon":
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["version"] != VERSION:
            raise ValueError(f"lexicon at {path} has layout version {meta['version']}, expected {VERSION}")
        tables = (spark.read.parquet(f"{path}/{n}") for n in ("entries", "syllables", "characters", "words"))
        repeated = spark.read.parquet(f"{path}/repeated")
        found = {n: load_postings(spark, f"{path}/postings/{n}", POSTINGS[n], meta[f"{n}_shards"]) for n in KINDS}
        return Lexicon(*tables, found, repeated)
