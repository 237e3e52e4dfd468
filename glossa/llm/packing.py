"""Harmonic packing of token sequences.

A piece belongs to class j when j such pieces fit in a sequence but not j + 1.
A sequence of class j holds exactly j pieces, whatever the other classes do,
so workers fill their share of a class without knowing of each other. As
documents may be cut, they are cut at class boundaries: whole sequences
first, then pieces of exactly 1/j of the capacity, until the rest is small.
A full sequence then wastes only the rounding of 1/j.

The pieces that do not fill a last sequence of their class are fewer than j
for each of at most 2 * sqrt(capacity) classes, whatever the size of the
input. They are packed first-fit by decreasing length in one small group.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import cut, gapless

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 1
#: A rest of at most this many tokens is not cut any more.
SMALL_REST = 128
#: Characters on which both tokenizer libraries are known to agree (checked one by one in the tests);
#: any other text takes the slower library.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]|\\s{64}")

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int"


def byte_bpe_encoder(name: str = "byte_bpe_50k"):
    """A function from a text to its ids (uint32) under the public byte-level vocabulary ``name``.

    The rank file holds the same vocabulary as the JSON file and is read by a
    library that is about four times as fast; texts with characters outside a
    checked range go through the JSON file itself.
    """
    import base64
    import os

    import public_tokenizers
    import tiktoken

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> np.ndarray:
        if _PLAIN.search(text) is None:
            return fast.encode_to_numpy(text, disallowed_special=())
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            slow[0].encode_special_tokens = True
        text = text.encode("utf-8", "replace").decode("utf-8")
        return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def cut_lengths(tokens: int, capacity: int = CAPACITY, small: int = SMALL_REST) -> list[int]:
    """Lengths of the pieces of a document of ``tokens`` tokens."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest > small:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their class; a null text counts as empty and has only the end id."""

    def run(batches):
        encode = byte_bpe_encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                at = 0
                for n in cut_lengths(len(ids), capacity):
                    rows.append((doc, at, n, zlib.crc32(ids[at : at + n]), len(ids), capacity // n))
                    at += n
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PIECES)


def _first_fit(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """First-fit decreasing; free space is kept sorted, so the tightest sequence that fits is taken."""
    group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
    free: list[tuple[int, int]] = []
    bins, offsets, n = [], [], 0
    for length in group["length"]:
        i = bisect_left(free, (length, -1))
        room, b = free.pop(i) if i < len(free) else (capacity, n)
        n += b == n
        bins.append(b)
        offsets.append(capacity - room)
        insort(free, (room - length, b))
    return group.assign(bin=bins, offset=offsets)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class), one row per piece.

    Every id of every document lies in one piece. Repeated rows are packed
    again, null doc_ids too; an empty table gives no rows.
    """
    pieces = cut(cut_pieces(docs, capacity, vocabulary))
    spark = docs.sparkSession
    totals = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    first, at = [], 0
    for j in sorted(totals):
        first.append((j, at, totals[j] // j * j))
        at += totals[j] // j
    table = F.broadcast(spark.createDataFrame(first, "class int, _first bigint, _full bigint"))  # one row per class
    placed = cut(gapless(pieces, "class", ["doc_id", "start", "length", "ids_crc32"], "_at").join(table, "class"))
    seat = Window.partitionBy("class", "_bin").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        placed.filter("_at < _full")
        .withColumn("_bin", F.expr("_at div class"))
        .withColumn("offset", F.coalesce(F.sum("length").over(seat), F.lit(0)))
        .withColumn("sequence_id", F.col("_first") + F.col("_bin"))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"]

    def tail(group: pd.DataFrame) -> pd.DataFrame:
        done = _first_fit(group, capacity)
        return done.assign(sequence_id=done["bin"] + at)[columns]

    rest = placed.filter("_at >= _full").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(tail, PIECES.replace("class", "sequence_id bigint, offset bigint, class"))
    return full.select(*columns).unionByName(rest)
