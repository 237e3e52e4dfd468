"""Hard negatives by Kronecker-packed products.

Rows are held in chunks, anchors in blocks. In a product of a block and a
chunk the components of several candidates, raised by a bias so that none is
negative, lie in separated fields of one wide integer: a candidate's field is
wide enough for its whole inner product. One multiplication per anchor
component then advances all of them, and the fields of the sum, less what the
bias has added, are the exact scores. The wide integer is the 53-bit
significand of a double, in which sums of integers are exact and matrix
products fast; where not even one field fits, Python's integers are used.

Two passes: the first finds each anchor's positives, the second, for each
positive, the best rows of other labels inside the range that it allows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows of a chunk and bits of a place in it.
CHUNK_BITS = 13
#: Numbers held by a chunk, and by a block of anchors; anchors of a block at most; blocks that are broadcast at a time.
CHUNK_NUMBERS = 1 << 19
BLOCK_NUMBERS = 1 << 18
BLOCK_ROWS = 4096
SLICE = 8
#: Anchors scored at a time in a task, and products (in 2^20 components) that a task should do.
TILE = 256
TASK_MEGA = 1 << 18
SIGNIFICAND = 53
_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id, a label and a vector of finite components only."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _narrow(q: np.ndarray) -> np.ndarray:
    """The components in the smallest type that holds them."""
    top = np.abs(q).max() if q.size else 0
    return q.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def _matrix(data: bytes, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(-1, dims).astype(np.float64) if dims else np.zeros((0, 0))


def make_chunks(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(chunk, n, dims, kind, low, high, ids, labels, marks, comps): rows in order of vec_id, components floor(scale * x)."""

    def run(batches):
        place = TaskContext.get().partitionId() << 20
        for batch in batches:
            dims = max(map(len, batch["vector"]), default=0)
            step = min(1 << CHUNK_BITS, max(1, CHUNK_NUMBERS // max(1, dims)))
            batch = batch.sort_values("vec_id", kind="stable")
            for first in range(0, len(batch), step):
                part = batch.iloc[first : first + step]
                q = np.zeros((len(part), max(1, dims)))
                for i, v in enumerate(part["vector"]):
                    with np.errstate(over="ignore"):
                        q[i, : len(v)] = np.floor(scale * np.asarray(v, dtype=np.float64))
                q = np.clip(q, -sys.float_info.max, sys.float_info.max)
                comps = _narrow(q)
                yield pd.DataFrame(
                    {
                        "chunk": [place],
                        "n": [len(part)],
                        "dims": [q.shape[1]],
                        "kind": [comps.dtype.str],
                        "low": [q.min()],
                        "high": [q.max()],
                        "ids": [part["vec_id"].to_numpy(dtype=np.int64).tobytes()],
                        "labels": [part["label"].to_numpy(dtype=np.int64).tobytes()],
                        "marks": [part["mark"].to_numpy(dtype=bool).tobytes()],
                        "comps": [comps.tobytes()],
                    }
                )
                place += 1

    schema = "chunk bigint, n int, dims int, kind string, low double, high double, ids binary, labels binary, marks binary, comps binary"
    return rows.mapInPandas(run, schema)


def anchors_of(chunks: DataFrame) -> DataFrame:
    """(row, vec_id, label, weight, dims, comps): the marked rows; weight is the sum of the components' sizes."""

    def run(batches):
        for batch in batches:
            for c in batch.itertuples():
                at = np.flatnonzero(np.frombuffer(c.marks, dtype=bool))
                if len(at):
                    q = _matrix(c.comps, c.kind, c.dims)[at]
                    yield pd.DataFrame(
                        {
                            "row": (np.int64(c.chunk) << CHUNK_BITS) + at,
                            "vec_id": np.frombuffer(c.ids, dtype=np.int64)[at],
                            "label": np.frombuffer(c.labels, dtype=np.int64)[at],
                            "weight": np.abs(q).sum(axis=1),
                            "dims": c.dims,
                            "comps": [x.tobytes() for x in q],
                        }
                    )

    return chunks.mapInPandas(run, "row bigint, vec_id bigint, label bigint, weight double, dims int, comps binary")


def make_blocks(anchors: DataFrame, count: int, dims: int) -> DataFrame:
    """(block, rows, ids, labels, comps, lows, highs, wanted, scores): anchors dealt by hash into blocks of bounded size.

    ``anchors`` may have ``found``, its positives as an array of (slot, score, vec_id).
    """
    with_found = "found" in anchors.columns
    blocks = max(1, -(-count // max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, dims)))))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        q = np.zeros((len(part), dims))
        for i, c in enumerate(part["comps"]):
            one = np.frombuffer(c)
            q[i, : len(one)] = one
        low = np.full((len(part), POSITIVES), _MOST, dtype=np.int64)  # an empty range where there is no positive
        high = np.full((len(part), POSITIVES), -_MOST, dtype=np.int64)
        wanted, score = np.zeros_like(low), np.zeros_like(low)
        for i, found in enumerate(part["found"] if with_found else []):
            for f in found:
                j, s = f["slot"], int(f["score"])
                wanted[i, j], score[i, j] = f["vec_id"], s
                low[i, j], high[i, j] = -(-LOW * s // 100), HIGH * s // 100
        return pd.DataFrame(
            {
                "block": [int(part["block"].iloc[0])],
                "rows": [part["row"].to_numpy(dtype=np.int64).tobytes()],
                "anchor_ids": [part["vec_id"].to_numpy(dtype=np.int64).tobytes()],
                "anchor_labels": [part["label"].to_numpy(dtype=np.int64).tobytes()],
                "anchor_comps": [q.tobytes()],
                "lows": [low.tobytes()],
                "highs": [high.tobytes()],
                "wanted": [wanted.tobytes()],
                "scores": [score.tobytes()],
            }
        )

    schema = "block bigint, rows binary, anchor_ids binary, anchor_labels binary, anchor_comps binary, lows binary, highs binary, wanted binary, scores binary"
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(pack, schema)


def field_plan(weight: float, low: float, high: float) -> tuple[int, int]:
    """(fields, width): how many candidates share a wide integer, and the bits of each; no fields if none fits.

    ``weight`` bounds the sum of an anchor's component sizes, ``low`` and
    ``high`` all candidates' components, raised by -low. A field is signed.
    """
    width = int(int(weight) * (int(high) - int(low))).bit_length() + 1
    # Scores are also ranked together with a place in the chunk, in 64 bits.
    return (SIGNIFICAND // width if width + CHUNK_BITS < 63 else 0), width


def packed(comps: np.ndarray, bias: float, fields: int, width: int) -> np.ndarray:
    """(dims, wide integers): candidate i lies in field i // wides of column i % wides."""
    n, dims = comps.shape
    wides = -(-n // fields)
    out = np.zeros((dims, wides))
    for f in range(fields):
        part = comps[f * wides : (f + 1) * wides]
        out[:, : len(part)] += (part.T + bias) * float(1 << (f * width))
    return out


def unpacked(sums: np.ndarray, n: int, fields: int, width: int) -> np.ndarray:
    """The signed fields of each wide sum, one column per candidate."""
    rest = sums.astype(np.int64)
    half, mask = np.int64(1 << (width - 1)), np.int64((1 << width) - 1)
    out = []
    for _ in range(fields):
        field = ((rest + half) & mask) - half
        out.append(field)
        rest = (rest - field) >> np.int64(width)
    return np.concatenate(out, axis=1)[:, :n]


def products(anchors: np.ndarray, comps: np.ndarray, bias: float, fields: int, width: int) -> np.ndarray:
    """Exact inner products as int64; past its range they count as its end."""
    if not fields:
        exact = np.dot(_whole(anchors), _whole(comps).T)
        return np.clip(exact, -_MOST, _MOST).astype(np.int64)
    sums = anchors @ packed(comps, bias, fields, width)
    added = (anchors.sum(axis=1) * bias).astype(np.int64)
    return unpacked(sums, len(comps), fields, width) - added[:, None]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def best(scores: np.ndarray, allowed: np.ndarray, k: int, small: bool) -> np.ndarray:
    """Per row the columns of the k highest allowed scores, ties to the left; -1 where there are fewer."""
    n = scores.shape[1]
    k = min(k, n)
    if small:
        keys = np.where(allowed, (scores << np.int64(CHUNK_BITS)) + np.arange(n - 1, -1, -1), _NONE)
        top = np.partition(keys, n - k, axis=1)[:, n - k :]
        return np.where(top == _NONE, -1, n - 1 - (top & ((1 << CHUNK_BITS) - 1)))
    order = np.argsort(np.where(allowed, -scores, _MOST), axis=1, kind="stable")[:, :k]
    return np.where(np.take_along_axis(allowed, order, axis=1), order, -1)


class _Best:
    """The k best (score, id) per anchor and slot that a task has met."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.score = np.full((anchors, slots, k), _NONE, dtype=np.int64)
        self.id = np.full((anchors, slots, k), _MOST, dtype=np.int64)

    def add(self, rows: slice, slot: int, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[2]
        score = np.concatenate([self.score[rows, slot], score], axis=1)
        ids = np.concatenate([self.id[rows, slot], ids], axis=1)
        falling = np.where(score == _NONE, _MOST, -np.maximum(score, -_MOST))
        order = np.lexsort((ids, falling), axis=-1)[:, :k]
        self.score[rows, slot] = np.take_along_axis(score, order, axis=1)
        self.id[rows, slot] = np.take_along_axis(ids, order, axis=1)


def search(chunks: DataFrame, blocks: DataFrame, n_blocks: int, tasks: int, positive: bool, bias: float, fields: int, width: int) -> DataFrame:
    """Per task the best candidates of each anchor: of its label if ``positive``, else of others inside the slots' ranges.

    Blocks, a slice of bounded size at a time, are broadcast to the chunks; a
    task holds the best rows of one slice.
    """
    slots, k = (1, POSITIVES) if positive else (POSITIVES, NEGATIVES)

    def run(batches):
        held = {}
        for batch in batches:
            for c in batch.itertuples():
                rows, labels = np.frombuffer(c.rows, dtype=np.int64), np.frombuffer(c.anchor_labels, dtype=np.int64)
                ids, others = np.frombuffer(c.ids, dtype=np.int64), np.frombuffer(c.labels, dtype=np.int64)
                comps = _matrix(c.comps, c.kind, c.dims)
                anchors = np.frombuffer(c.anchor_comps).reshape(len(rows), -1)
                shared = min(anchors.shape[1], comps.shape[1])
                anchors, comps = anchors[:, :shared], comps[:, :shared]
                low, high = (np.frombuffer(x, dtype=np.int64).reshape(-1, POSITIVES) for x in (c.lows, c.highs))
                if c.block not in held:
                    facts = (rows, *(np.frombuffer(x, dtype=np.int64) for x in (c.anchor_ids, c.wanted, c.scores)))
                    held[c.block] = (facts, _Best(len(rows), slots, k))
                found = held[c.block][1]
                places = (np.int64(c.chunk) << CHUNK_BITS) + np.arange(len(ids))
                for first in range(0, len(rows), TILE):
                    tile = slice(first, first + TILE)
                    scores = products(anchors[tile], comps, bias, fields, width)
                    same = labels[tile, None] == others
                    for j in range(slots):
                        if positive:
                            allowed = same & (rows[tile, None] != places)
                        else:
                            allowed = ~same & (scores >= low[tile, j, None]) & (scores <= high[tile, j, None])
                        at = best(scores, allowed, k, fields > 0)
                        none = at < 0
                        if not none.all():
                            found.add(
                                tile, j, np.where(none, _NONE, np.take_along_axis(scores, at, axis=1)), np.where(none, _MOST, ids[at])
                            )
        for (rows, anchor_ids, wanted, wanted_scores), found in held.values():
            a, j, i = np.nonzero(found.score != _NONE)
            at = a * POSITIVES + j
            yield pd.DataFrame(
                {
                    "row": rows[a],
                    "anchor_id": anchor_ids[a],
                    "slot": j,
                    "positive_id": wanted[at],
                    "positive_score": wanted_scores[at],
                    "vec_id": found.id[a, j, i],
                    "score": found.score[a, j, i],
                }
            )

    schema = "row bigint, anchor_id bigint, slot int, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"
    dealt = chunks.repartition(tasks, "chunk")
    out = None
    for first in range(0, n_blocks, SLICE):
        # The stated anchors against all rows: a few block rows of bounded size beside each chunk row.
        part = dealt.crossJoin(F.broadcast(blocks.filter(F.col("block").between(first, first + SLICE - 1)))).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def hard_negatives(rows: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, label, vector).

    Scores are inner products of floor(scale * component); ``anchor`` marks
    the anchors. Positives are an anchor's 5 best other rows of its label, ties
    to the smaller vec_id; per positive come the 10 best rows of other labels
    whose score is 30 to 90 hundredths of the positive's. Rows without an id,
    a label or a vector of finite numbers take no part. A shorter vector counts
    as filled up with zeros. Repeated rows are rows of their own, also as
    anchors. Scores past the range of a bigint count as its end. Anchors without
    positives, and an empty table, give no rows. Other columns are ignored.
    """
    given = usable(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("mark")))
    chunks = cut(make_chunks(given.select("vec_id", "label", F.col("vector").cast("array<double>").alias("vector"), "mark"), scale))
    anchors = cut(anchors_of(chunks))
    size = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("dims"), F.lit(1)).alias("dims"), F.least(F.min("low"), F.lit(0.0)).alias("low"), F.greatest(F.max("high"), F.lit(0.0)).alias("high")).first()
    asked = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight")).first()
    bias = -(size["low"] or 0.0)
    fields, width = field_plan(asked["weight"], -bias, size["high"] or 0.0)
    spark = rows.sparkSession
    mega = size["n"] * asked["n"] * size["dims"] >> 20
    tasks = max(spark.sparkContext.defaultParallelism, min(mega // TASK_MEGA, size["n"] * size["dims"] // CHUNK_NUMBERS + 1))
    per_block = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // size["dims"]))
    n_blocks = max(1, -(-asked["n"] // per_block))

    blocks = cut(make_blocks(anchors, asked["n"], size["dims"]))
    near = search(chunks, blocks, n_blocks, tasks, True, bias, fields, width)
    first = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = (
        near.withColumn("slot", (F.row_number().over(first) - 1).cast("int"))
        .filter(F.col("slot") < POSITIVES)
        .groupBy("row")
        .agg(F.collect_list(F.struct("slot", "score", "vec_id")).alias("found"))
    )
    ranged = cut(make_blocks(anchors.join(found, "row"), asked["n"], size["dims"]))
    far = search(chunks, ranged, n_blocks, tasks, False, bias, fields, width)
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
    return (
        far.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= NEGATIVES)
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
