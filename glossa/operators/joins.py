"""Joins that hold up under hot keys, and string-matching joins built from equi-joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.distance import around_piece, byte_characters
from glossa.functions.scoring import one_edit_prefix
from glossa.session import cut

# A key is hot when it holds at least this share of the rows, so there are at most 1/share hot keys.
HOT_SHARE = 0.001
# Smaller groups fit in any task.
HOT_ROWS = 10_000
SALTS = 64
# Deletion keys grow with the square of the length; longer terms have selective halves to use instead.
SHORT_TERM = 5
# Texts of more bytes in all are scanned for terms within one edit, if the terms are no more and no longer than this.
SCAN_BYTES, SCAN_TERMS, SCAN_LENGTH = 1 << 20, 256, 64


def hot_keys(keys: DataFrame, share: float = HOT_SHARE, min_rows: int = HOT_ROWS) -> DataFrame:
    """(key, hot) for keys with at least ``share`` of all rows: no more than 1/share rows."""
    (name,) = keys.columns
    return hot_from_counts(keys.groupBy(name).agg(F.count("*").alias("n")), share, min_rows)


def hot_from_counts(counts: DataFrame, share: float = HOT_SHARE, min_rows: int = HOT_ROWS) -> DataFrame:
    """The same from (key, rows per key), such as a stored vocabulary."""
    name, n = counts.columns
    all_rows = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) >= F.greatest(all_rows * share, F.lit(float(min_rows)))).select(
        name, F.lit(True).alias("hot")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    spread: Column | None = None,
    hot: DataFrame | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join where hot keys of ``left`` are spread over SALTS sub-keys.

    Only the rows of ``right`` with a hot key are repeated. The hot-key table
    is bounded by 1/HOT_SHARE rows, which is why it may be broadcast; pass
    ``hot`` where the counts are known, else ``left`` is read once more for
    them. ``how`` must keep left rows at most (inner, left, left_semi,
    left_anti).
    """
    spread = F.xxhash64(*left.columns) if spread is None else spread
    hot = hot_keys(left.select(key), min_rows=min_rows) if hot is None else hot
    left_s = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0)
    ).drop("hot")
    right_s = right.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("hot")
    return left_s.join(right_s, [key, "_salt"], how).drop("_salt")


# Needles of up to this many bytes in all are broadcast to the keys.
NEEDLE_BYTES = 64 << 20


def measure(needles: DataFrame, limit: int = NEEDLE_BYTES) -> tuple[bool, list[int]]:
    """Whether the one-column needles are small enough to broadcast, and the lengths that occur."""
    (name,) = needles.columns
    row = needles.agg(
        F.coalesce(F.sum(F.octet_length(name) * 4 + 64), F.lit(0)).alias("bytes"),
        F.collect_set(F.length(name)).alias("lengths"),
    ).first()
    return row["bytes"] <= limit, sorted(row["lengths"])


def gram_sizes_for(lengths: list[int]) -> tuple[int, ...]:
    return tuple(sorted({min(n, 3) for n in lengths if n > 0})) or (3,)


def _meet(keys: DataFrame, needles: DataFrame, on: str, small: bool) -> DataFrame:
    """Join exploded keys with the needles' keys; ``small`` says that the needles' size was measured."""
    return keys.join(F.broadcast(needles), on) if small else salted_join(keys, needles, on)


def anchor_gram(needle: Column) -> Column:
    """The middle three characters, or all of a shorter needle."""
    return F.substring(needle, F.greatest(F.floor(F.length(needle) / 2).cast("int"), F.lit(1)), F.lit(3))


def _with_grams(keys: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """A row for each ``gram`` of each key and its place ``_at``, in generated code."""
    placed = keys.withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1)))))
    placed = placed.withColumn("_size", F.explode(F.array(*[F.lit(n) for n in sizes]))) if len(sizes) > 1 else placed.withColumn("_size", F.lit(sizes[0]))
    every = placed.withColumn("gram", F.substring("key", F.col("_at"), F.col("_size")))
    return every.filter(F.length("gram") == F.col("_size")).drop("_size")


def containment_pairs(
    needles: DataFrame, keys: DataFrame, small: bool, gram_sizes: tuple[int, ...] = (1, 2, 3)
) -> DataFrame:
    """(needle, key, ...) wherever ``needle`` is a substring of ``key``; both inputs distinct.

    Keys meet a needle only over the needle's anchor gram and are then checked.
    A needle has one anchor, of which the first place in the key counts, so pairs are unique.
    ``gram_sizes`` are the sizes that occur among the anchors: 3, and 1 and 2 if
    there are such short needles.
    """
    needles = needles.filter(F.col("needle") != "").withColumn("gram", anchor_gram(F.col("needle")))
    met = _meet(_with_grams(keys, gram_sizes), needles, "gram", small)
    first = F.instr("key", anchor_gram(F.col("needle"))) == F.col("_at")
    return met.filter(F.contains("key", "needle") & first).drop("gram", "_at")


def _deletions(s: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))),
    )


def _tagged(tag: str, m: Column, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), m.cast("string"), F.lit(":"), v))


def _needle_edits(needle: Column) -> Column:
    m = F.length(needle)
    half = F.floor(m / 2).cast("int")
    short = F.concat(_tagged("d", m, _deletions(needle)), _tagged("i", m, F.array(needle)))
    long = F.concat(
        _tagged("p", m, F.array(F.left(needle, half))),
        _tagged("s", m, F.array(F.substring(needle, half + 1, m))),
    )
    return F.array_distinct(F.when(m <= SHORT_TERM, short).otherwise(long))


def _key_edits(key: Column, lengths: list[int]) -> Column:
    """What ``key`` offers to needles of each of the given lengths; nulls where it is too short.

    The few short lengths are spelled out, so that they run as generated code.
    """
    short = []
    for n in (n for n in lengths if n <= SHORT_TERM):
        short.append(F.when(F.length(key) >= n - 1, F.concat(F.lit(f"d{n}:"), F.left(key, F.lit(n - 1)))))
        for i in range(n + 1):
            dropped = F.concat(F.lit(f"i{n}:"), F.left(key, F.lit(i)), F.substring(key, F.lit(i + 2), F.lit(n - i)))
            short.append(F.when(F.length(key) >= n + 1, dropped))

    def long(n: Column) -> Column:
        h = F.floor(n / 2).cast("int")
        edits = F.concat(
            _tagged("p", n, F.array(F.left(key, h))),
            _tagged("s", n, F.array(F.substring(key, h + 2, n - h), F.substring(key, h, n - h))),
        )
        return F.when(F.length(key) >= n - 1, edits).otherwise(F.array().cast("array<string>"))

    parts = [F.array(*short)] if short else []
    longer = [F.lit(n) for n in lengths if n > SHORT_TERM]
    if longer:
        parts.append(F.flatten(F.transform(F.array(*longer), long)))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def fuzzy_prefix_pairs(needles: DataFrame, keys: DataFrame, small: bool, lengths: list[int]) -> DataFrame:
    """(needle, key, ...) wherever one insert/delete turns ``needle`` into a prefix of ``key``.

    Terms of up to SHORT_TERM characters meet on their deletions, which is
    exact. In longer ones a single edit leaves one half intact, so they meet on
    halves and are then verified. ``lengths`` are the needle lengths that occur.
    A pair may come out more than once.
    """
    needle = F.col("needle")
    needles = needles.filter((F.length(needle) > 1) & (F.octet_length(needle) == F.length(needle)))
    lengths = sorted(n for n in set(lengths) if n > 1)
    needle_keys = needles.withColumn("edit", F.explode(_needle_edits(needle)))
    key_keys = keys.withColumn("edit", F.explode(_key_edits(F.col("key"), lengths)))
    return _meet(key_keys, needle_keys, "edit", small).filter(one_edit_prefix(needle, F.col("key"))).drop("edit")


def _places(pieces: DataFrame, exploded: DataFrame, longer: bool, small: bool) -> DataFrame:
    """(.., gram, gram_at): the three bytes of each piece that the texts hold least often, or all of a shorter one."""
    size = F.octet_length("piece")
    starts = F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1)))
    every = pieces.withColumn("gram_at", F.explode(starts)).withColumn("gram", F.substring("piece", F.col("gram_at"), F.lit(3)))
    if not longer:
        return every
    asked = every.select("gram").distinct()
    counts = exploded.select("gram").join(F.broadcast(asked) if small else asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text holds is the rarest.
    seen = every.join(counts, "gram", "left").fillna(0, ["n"])
    keys = [c for c in pieces.columns]
    return seen.groupBy(*keys).agg(F.min(F.struct("n", "gram_at", "gram")).alias("g")).select(*keys, "g.gram_at", "g.gram")


def _within_one_edit(needle: bytes) -> str:
    """A pattern of bytes: the needle without one of them, or with another one for it or before it.

    Edits at either end need no pattern, as what is left of the needle is the needle without that byte.
    """
    of = lambda some: "".join(f"\\x{b:02x}" for b in some)
    n = len(needle)
    found = [of(needle[:i] + needle[i + 1 :]) for i in range(n)]
    found += [f"{of(needle[:i])}(?s:.){of(needle[i + 1 :])}" for i in range(1, n - 1)]
    found += [f"{of(needle[:i])}(?s:.){of(needle[i:])}" for i in range(1, n)]
    return "|".join(dict.fromkeys(found))


def _scanned(needles: list[str]):
    """(key, hits) of texts that hold a needle but for one edit, by whole columns; a needle of one byte has to be there."""
    raw = [x.encode() for x in needles]
    patterns = [_within_one_edit(x) if len(x) > 1 else None for x in raw]

    def run(batches):
        for batch in batches:
            keys = batch.column("key")
            texts = keys.cast(pa.large_binary() if pa.types.is_large_string(keys.type) else pa.binary())
            row, of, distance = [], [], []
            for i, (needle, pattern) in enumerate(zip(raw, patterns, strict=True)):
                near = pc.match_substring(texts, needle) if pattern is None else pc.match_substring_regex(texts, pattern)
                at = np.flatnonzero(pc.fill_null(near, False).to_numpy(zero_copy_only=False))
                row.append(at)
                of.append(np.full(len(at), i))
                distance.append(1 - pc.match_substring(texts.take(pa.array(at)), needle).to_numpy(zero_copy_only=False).astype(np.int32))
            row, of, distance = np.concatenate(row), np.concatenate(of), np.concatenate(distance)
            order = np.argsort(row, kind="stable")
            some, starts = np.unique(row[order], return_index=True)
            hits = pa.StructArray.from_arrays([pa.array(needles, pa.string()).take(pa.array(of[order])), pa.array(distance[order], pa.int32())], ["needle", "distance"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), hits)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), lists], ["key", "hits"])

    return run


def local_levenshtein_pairs(terms: DataFrame, texts: DataFrame, max_distance: int) -> DataFrame:
    """(needle, key, distance): terms within ``max_distance`` edits of some substring of a text; both inputs distinct.

    Edits are of bytes. A term cut into max_distance + 1 pieces keeps at least
    one piece intact. Texts meet the pieces by their rarest grams, at the place
    where a gram stands, and only what lies around a piece is compared with the
    rest of the term, so a text is not read again for each candidate. Texts
    travel as ids and short windows, and join again by their ids at the end.
    A term of no more than ``max_distance`` bytes is within reach of any text
    that is not empty: here come the texts that hold it, at distance 0, and
    ``within_reach_of_any`` tells its distance from all others.

    Pieces of short terms stand nearly everywhere. Few and short terms within
    one edit of large texts are therefore told by a scan for each term, which
    takes the same time for any place of a hit.
    """
    raw, size = F.col("_raw"), F.octet_length("_raw")
    count = max_distance + 1

    def bound(i: Column) -> Column:
        return F.floor(i * size / count).cast("int")

    def parts(i: Column) -> Column:
        return F.struct(
            F.substring(raw, F.lit(1), bound(i)).alias("before"),
            F.substring(raw, bound(i) + 1, bound(i + 1) - bound(i)).alias("piece"),
            F.substring(raw, bound(i + 1) + 1, size).alias("after"),
        )

    nothing = F.lit(b"")
    whole = F.array(F.struct(nothing.alias("before"), raw.alias("piece"), nothing.alias("after")))
    pieces = (
        terms.filter(F.col("needle") != "")
        .withColumn("_raw", F.col("needle").cast("binary"))
        .select("needle", F.explode(F.when(size > max_distance, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), parts)).otherwise(whole)).alias("p"))
        .select("needle", "p.*", byte_characters(F.col("p.before")).alias("before_text"), byte_characters(F.col("p.after")).alias("after_text"))
    )
    measured = pieces.agg(
        F.coalesce(F.sum(F.octet_length("needle") * 8 + 128), F.lit(0)).alias("bytes"),
        F.collect_set(F.least(F.octet_length("piece"), F.lit(4))).alias("sizes"),
        F.coalesce(F.max(F.octet_length("needle")), F.lit(0)).alias("longest"),
        F.count_distinct("needle").alias("terms"),
    ).first()
    small, sizes = measured["bytes"] <= NEEDLE_BYTES, sorted({min(n, 3) for n in measured["sizes"]}) or [3]
    reach = measured["longest"] + max_distance

    # Work per byte is high, so texts that adaptive execution has gathered in few tasks are dealt out again.
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = cut(texts.repartition(tasks, F.xxhash64("key")).select("key").withColumn("_id", F.monotonically_increasing_id()))
    scan = max_distance == 1 and 0 < measured["terms"] <= SCAN_TERMS and measured["longest"] <= SCAN_LENGTH
    if scan and (lines.agg(F.sum(F.octet_length("key"))).first()[0] or 0) > SCAN_BYTES:
        needles = sorted(r["needle"] for r in pieces.select("needle").distinct().collect())
        hits = lines.select("key").mapInArrow(_scanned(needles), "key string, hits array<struct<needle:string,distance:int>>")
        return hits.select(F.explode("hits").alias("hit"), "key").select("hit.needle", "key", "hit.distance")
    at = F.explode(F.sequence(F.lit(1), F.octet_length("raw")))
    bytes_of = lines.select("_id", F.col("key").cast("binary").alias("raw"))
    exploded = bytes_of.filter(F.octet_length("raw") > 0).withColumn("at", at).withColumn("gram", F.explode(F.array(*[F.substring("raw", F.col("at"), F.lit(n)) for n in sizes])))
    if not small:
        first = F.greatest(F.col("at") - reach, F.lit(1))
        exploded = exploded.select("_id", "gram", (F.col("at") - first + 1).alias("at"), F.substring("raw", first, F.lit(2 * reach + 3)).alias("raw"))
    met = _meet(exploded, _places(pieces, exploded, 4 in measured["sizes"], small), "gram", small)
    start = F.col("at") - F.col("gram_at") + 1
    met = met.withColumn("start", start).filter((F.col("start") > 0) & (F.substring("raw", F.col("start"), F.octet_length("piece")) == F.col("piece")))

    first = F.greatest(F.col("start") - F.octet_length("before") - max_distance, F.lit(1))
    left = F.substring("raw", first, F.col("start") - first)
    right = F.substring("raw", F.col("start") + F.octet_length("piece"), F.octet_length("after") + max_distance)
    # From here on a row has the bytes around its piece and no longer the text.
    met = met.select("needle", "_id", "before_text", "after_text", left.alias("left"), right.alias("right"))
    around = around_piece(F.col("before_text"), F.col("after_text"), byte_characters(F.col("left")), byte_characters(F.col("right")), max_distance)
    # Exploding an array of one or none computes and filters in a single evaluation.
    distance = F.explode(F.filter(F.array(around), lambda x: x <= max_distance))
    found = met.select("needle", "_id", distance.alias("distance")).groupBy("needle", "_id").agg(F.min("distance").alias("distance"))
    return found.join(lines, "_id").select("needle", "key", "distance")


def within_reach_of_any(terms: DataFrame, max_distance: int) -> DataFrame:
    """(needle, distance): terms of at most ``max_distance`` bytes, and the most edits that any text which is not empty takes."""
    size = F.octet_length("needle")
    return terms.filter((size > 0) & (size <= max_distance)).select("needle", size.alias("distance"))
