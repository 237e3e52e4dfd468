"""Sharding by a minimax contiguous partition of atomic groups.

Groups of equal texts stand in the order of their smallest doc_id. The
smallest capacity with which a greedy pass needs no more than the given
number of shards is found by binary search, and the groups are cut there.

The driver never holds the groups. It holds sums over blocks of keys, of
which there are at most ``BLOCKS`` to begin with. A greedy pass over blocks
bounds every cut from both sides: blocks as atoms give the earliest place,
divisible blocks the latest. Only blocks between these bounds are split
further by another pass over the groups, until every cut is known to the
group.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import cut, gapless, text_or_empty
from glossa.operators.ids import dense_ids

ROW_BYTES = 16
BLOCKS = 1 << 14
_SIGN = 1 << 63
_ALL = (1 << 64) - 1


class _Line:
    """Blocks in order: ``start`` in key space, ``size`` and whether the block is a single key."""

    def __init__(self, blocks: list[tuple[int, int, bool]]):
        self.blocks = blocks
        self.ends = list(accumulate(b[1] for b in blocks))
        self.total = self.ends[-1] if blocks else 0

    def before(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def reach(self, at: int, capacity: int, divisible: bool) -> int:
        """The furthest place to cut after ``at`` with at most ``capacity`` between."""
        goal = at + capacity
        if goal >= self.total:
            return self.total
        i = bisect_right(self.ends, goal)  # the block that holds the goal
        if divisible and not self.blocks[i][2]:
            return goal
        return max(at, self.before(i))

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, divisible)
            out.append(at)
        return out

    def smallest(self, shards: int, divisible: bool) -> int:
        lo, hi = -(-self.total // max(1, shards)), max(self.total, 1)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, divisible)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def _unsigned(key):
    return F.col(key).bitwiseXOR(F.lit(-_SIGN).cast("bigint"))


def minimax_cuts(groups: DataFrame, shards: int, blocks: int = BLOCKS) -> tuple[list[int], int]:
    """(keys at which a new shard begins, the capacity) for ``groups`` (key bigint, bytes bigint).

    Groups with the same key stay together. No group may be larger than the
    mean shard for the shards to come out even; see ``shard_documents``.
    """
    span = groups.agg(F.min("key"), F.max("key")).first()
    if span[0] is None:
        return [], 0
    low, high = ((v + _SIGN) & _ALL for v in span)
    shift = max(0, (low ^ high).bit_length() - (blocks.bit_length() - 1))

    def sums(rows: DataFrame, s: int) -> list[tuple[int, int, int, bool]]:
        block = F.shiftrightunsigned(_unsigned("key"), s)
        got = rows.groupBy(block.alias("block")).agg(F.sum("bytes").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        return sorted((r["block"] & _ALL, (r["a"] + _SIGN) & _ALL, r["n"], r["a"] == r["b"]) for r in got)

    held = [(b, shift, a, n, one) for b, a, n, one in sums(groups, shift)]  # (block, shift, first key, size, single)
    while True:
        line = _Line([(a, n, one) for _, _, a, n, one in held])
        lo, hi = line.smallest(shards, True), line.smallest(shards, False)
        early, late = line.cuts(lo, shards, False), line.cuts(hi, shards, True)
        open_ = sorted(
            {
                i
                for x, y in zip(early, late, strict=True)
                for i in range(bisect_right(line.ends, x), min(len(held), bisect_right(line.ends, y) + 1))
                if not held[i][4]
            }
        )
        if not open_:
            break
        # The coarsest blocks first, so that a pass splits blocks of one width.
        width = max(held[i][1] for i in open_)
        split = [i for i in open_ if held[i][1] == width]
        finer = max(0, width - max(1, (blocks // len(split)).bit_length() - 1))
        ids = [held[i][0] if held[i][0] < _SIGN else held[i][0] - (1 << 64) for i in split]
        spark = groups.sparkSession
        wanted = spark.createDataFrame([(i,) for i in ids], "wide bigint")
        inside = groups.withColumn("wide", F.shiftrightunsigned(_unsigned("key"), width)).join(F.broadcast(wanted), "wide", "left_semi")
        gone = set(split)
        held = [h for i, h in enumerate(held) if i not in gone] + [(b, finer, a, n, one) for b, a, n, one in sums(inside, finer)]
        held.sort(key=lambda h: h[2])
    capacity = line.smallest(shards, False)
    starts = []
    for place in line.cuts(capacity, shards, False)[:-1]:
        i = bisect_right(line.ends, place)
        if i < len(held) and place:
            starts.append(held[i][2] - _SIGN)
    return sorted(set(starts)), capacity


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near-equal bytes.

    Equal texts share a shard; a null text counts as the empty one. A group of
    copies that alone exceeds the mean of what is left gets a shard of its
    own, the largest first; all other groups are cut by ``minimax_cuts``.
    Groups go in the order of their smallest doc_id, then of
    their digest. Repeated rows stay rows of their own. An empty table gives no rows. Null
    doc_ids are placed by their text. Columns other than doc_id and text are
    ignored.
    """
    rows = cut(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text_or_empty()) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
            F.crc32(text_or_empty()).alias("text_crc32"),
            F.unhex(F.md5(text_or_empty())).alias("digest"),
        )
    )
    summed = rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.xxhash64("digest")).alias("_least"), F.sum("size").alias("bytes"))
    # Texts may share their smallest doc_id, so their place in the order of (doc_id, digest) is the key.
    groups = cut(dense_ids(summed, ["_least", "digest"], "key").select("digest", "key", "bytes"))
    left, k = groups.agg(F.sum("bytes")).first()[0] or 0, shards
    alone: list[bytes] = []
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if k > 1 and r["bytes"] * k > left:
            alone.append(bytes(r["digest"]))
            left, k = left - r["bytes"], k - 1
    spark = docs.sparkSession
    own = spark.createDataFrame([(bytearray(d), i) for i, d in enumerate(alone)], "digest binary, own int")
    tagged = groups.join(F.broadcast(own), "digest", "left")  # no more rows than shards
    starts, _ = minimax_cuts(tagged.filter("own is null"), k)
    run = sum((F.when(F.col("key") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    placed = tagged.select("digest", F.coalesce("own", run + len(alone)).cast("int").alias("shard"))
    sharded = cut(rows.join(placed, "digest").drop("digest"))
    return gapless(sharded, "shard", ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
