"""Posting tables of a lexicon: for every key the entries that hold it, and where.

Rows are dealt to shards by a hash of their key, one folder a shard, and sorted
by key and entry within it. A search reads the folders of the keys it asks for,
and of their files only the row groups whose key range can hold one. Shards are
cut by ranges of (key, entry_id), so a key that most entries hold is spread
over as many files as it needs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import ASCII_SPACES, characters, definition_block
from glossa.session import drop

ROWS_PER_SHARD = 1_000_000
MOST_SHARDS = 4096
#: Text that a task cuts into words at once.
BLOCK_BYTES = 4 << 20


def _first_places(block_bytes: int):
    """Words of blocks and their first places, by whole columns; texts of no more than ``block_bytes`` at a time, or one."""
    fold = bytes.maketrans((ascii_uppercase + "".join(ASCII_SPACES)).encode(), (ascii_lowercase + " " * len(ASCII_SPACES)).encode())

    def cut_up(rows: pa.RecordBatch, blocks: pa.Array) -> pa.RecordBatch:
        words = pc.split_pattern(blocks, " ")
        flat, row = words.flatten(), pc.list_parent_indices(words).to_numpy().astype(np.int64)
        starts = np.searchsorted(row, np.arange(rows.num_rows))

        def before(lengths: pa.Array) -> np.ndarray:
            """What lies before each word of its text: the words there, and a blank after each."""
            total = np.concatenate(([0], np.cumsum(lengths.to_numpy().astype(np.int64) + 1)))[:-1]
            return total - total[starts][row]

        coded = flat.dictionary_encode()
        _, first = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_index=True)
        first = first[pc.binary_length(flat).to_numpy()[first] > 0]
        at_char, at_byte, of = before(pc.utf8_length(flat))[first] + 1, before(pc.binary_length(flat))[first], pa.array(row[first])
        made = [flat.take(pa.array(first)), rows.column("entry_id").take(of), rows.column("static_cost").take(of), pa.array(at_char, pa.int32()), pa.array(at_byte, pa.int32())]
        return pa.RecordBatch.from_arrays(made, ["key", "entry_id", "static_cost", "at_char", "at_byte"])

    def run(batches):
        for batch in batches:
            blocks = batch.column("block")
            valid, offsets, data = blocks.buffers()
            folded = [valid, offsets, pa.py_buffer(data.to_pybytes().translate(fold)) if data else data]
            blocks = pa.Array.from_buffers(blocks.type, len(blocks), folded, blocks.null_count, blocks.offset)
            sizes, start = np.cumsum(pc.binary_length(blocks).to_numpy().astype(np.int64)), 0
            while start < batch.num_rows:
                below = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, below + block_bytes, "right")))
                yield cut_up(batch.slice(start, end - start), blocks.slice(start, end - start))
                start = end

    return run


def word_postings(entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, entry_id, static_cost, at_char, at_byte): each distinct word of the definitions and its first place.

    Places are those of ``search_block``: the first character has the 1-based
    position ``at_char``, and ``at_byte`` bytes lie before it.
    """
    # Folded and blanked out as ``search_block`` does, but as bytes.
    block = F.concat(F.lit(" "), definition_block(F.col("definitions")), F.lit(" "))
    blocks = entries.select("entry_id", "static_cost", block.alias("block"))
    kept = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ("entry_id", "static_cost"))
    return blocks.mapInArrow(_first_places(block_bytes), f"key string, {kept}, at_char int, at_byte int")


def syllable_postings(entries: DataFrame) -> DataFrame:
    """(key, entry_id, static_cost, n_syllables, pos, tone): every syllable of the readings."""
    return entries.select("entry_id", "static_cost", F.size("syllables").alias("n_syllables"), F.posexplode("syllables").alias("pos", "s")).select(
        F.col("s.base").alias("key"), "entry_id", "static_cost", "n_syllables", "pos", F.col("s.tone").alias("tone")
    )


def character_postings(entries: DataFrame) -> DataFrame:
    """(key, entry_id, static_cost): each distinct character of the headwords."""
    return entries.select(F.explode(F.array_distinct(characters(F.col("headword")))).alias("key"), "entry_id", "static_cost")


KINDS = {"words": word_postings, "syllables": syllable_postings, "characters": character_postings}


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class Postings:
    """One posting table and the number of its shards."""

    rows: DataFrame
    shards: int

    def of_shards(self, shards: list[int]) -> DataFrame:
        """The rows of some shards; no other folder is read."""
        return self.rows.filter(F.col("shard").isin(shards)).drop("shard")


def save_postings(rows: DataFrame, path: str, mode: str, rows_per_shard: int = ROWS_PER_SHARD) -> int:
    """Write a posting table and return the number of its shards.

    Postings are made once and written as they come; counting, sampling and dealing out read the written rows.
    """
    spark, made = rows.sparkSession, [f"{path}-unsorted-{uuid.uuid4().hex}"]
    try:
        rows.write.parquet(made[0])
        found = spark.read.schema(rows.schema).parquet(made[0])
        shards = max(1, min(MOST_SHARDS, -(-found.count() // rows_per_shard)))
        order = ["shard", "key", "entry_id"]
        placed = found.withColumn("shard", shard_of(F.col("key"), shards))
        placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("shard").parquet(path)
    finally:
        drop(spark, made)
    return shards


def load_postings(spark: SparkSession, path: str, schema: str, shards: int) -> Postings:
    return Postings(spark.read.schema(f"{schema}, shard int").parquet(path), shards)
