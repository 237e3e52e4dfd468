"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so that a question asked
again with other parameters keeps its template. Windows of template tokens of
the benchmark and of the documents meet in a hash join. Windows that line up
form an alignment of an item with a document; it counts when its slots are
consistent, that is, when every value of the item stands for one value in the
document throughout; windows with a slot that contradicts the most frequent
value of the document in its place are left out of their alignment. A document
is contaminated by an item when consistent windows cover at least half of it.

A template says little where over half of a window are slots, or where an item
is shorter than a window. Such windows meet by their exact tokens, values
included, so that copies of sums and of short questions are found, but not
every list of numbers. Items of fewer than LEAST tokens are found in documents
that hold nothing else.

Only built-in functions run here. Before any window leaves its row, it is
looked up in a bit map of the benchmark's windows, whose size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import broadcast_if_small, cut, free_name

WINDOW = 8
COVER = 0.5
#: Tokens from which on an item is looked for within documents.
LEAST = 4
#: Bits of the map of benchmark windows; more windows only make it let more rows through.
MAP_BITS = 20
# Marks of a number, a name and a unit, from the private use area.
_NUMBER, _NAME, _UNIT = "", "", ""
# Units that may follow a number.
UNITS = (
    "%|percent|kg|g|mg|t|lb|lbs|oz|km|m|cm|mm|mi|miles?|feet|foot|ft|inch|inches|yards?|l|ml|litres?|liters?|"
    "s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kmh|hz|khz|mhz|ghz|w|kw|v|a|j|kj|cal|kcal|"
    "°c|°f|°|euros?|dollars?|cents?|pounds?|usd|eur|gbp|kb|mb|gb|tb"
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def typed_tokens(text: Column) -> Column:
    """Words in lower case; a slot is its mark followed by its value.

    A name is a capitalised word that does not begin a sentence: the start of
    a sentence says nothing about a word. Punctuation is left out.
    """
    t = F.translate(text, _NUMBER + _NAME + _UNIT, "   ")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[^.!?:\s]\s)\p{Lu}[\p{L}\p{M}]*+", f"{_NAME}$0 ")
    t = F.regexp_replace(t, r"(?<![\p{N}])\p{N}++(?:[.,:/]\p{N}++)*+", f" {_NUMBER}$0 ")
    t = F.regexp_replace(t, rf"({_NUMBER}\S++\s{{1,2}})((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", f"$1 {_UNIT}$2 ")
    t = F.regexp_replace(t, rf"[$€£](?=\s?{_NUMBER})", f" {_UNIT}$0 ")
    return F.regexp_extract_all(F.lower(t), F.lit(rf"[{_NUMBER}-{_UNIT}]\S+|[\p{{L}}\p{{M}}]+"), F.lit(0))


def _is_slot(token: Column) -> Column:
    return (token >= _NUMBER) & (token < "\ue013")


def template(tokens: Column) -> Column:
    """Tokens with the values of the slots left out."""
    return F.transform(tokens, lambda t: F.when(_is_slot(t), F.substring(t, 1, 1)).otherwise(t))


def mostly_slots(window: Column) -> Column:
    return F.size(F.filter(window, _is_slot)) * 2 > F.size(window)


def window_hashes(tokens: Column, size: int) -> Column:
    """Hash of each window of ``size`` tokens of an array; none for a shorter array."""
    last = F.size(tokens) - size
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(tokens, i + 1, size)))
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, item_tokens, off, h, key, item_window) of the items with any token.

    h is the hash of the window's template, key what it is joined by: h, or
    the hash of its exact tokens where most are slots or the item is shorter
    than ``size`` and is one window.
    """
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), typed_tokens(F.col("text")).alias("typed"))
    items = items.filter(F.size("typed") > 0).withColumn("plain", template(F.col("typed"))).withColumn("item_tokens", F.size("typed"))
    rows = items.select(
        "item_id",
        "item_tokens",
        "typed",
        F.posexplode(
            F.when(F.col("item_tokens") >= size, window_hashes(F.col("plain"), size)).otherwise(F.array(F.xxhash64("typed")))
        ).alias("off", "h"),
    )
    window = F.slice("typed", F.col("off") + 1, size)
    exact = mostly_slots(F.col("item_window")) | (F.col("item_tokens") < size)
    key = F.when(exact, F.xxhash64("item_window")).otherwise(F.col("h"))
    return rows.withColumn("item_window", window).select("item_id", "item_tokens", "off", "h", key.alias("key"), "item_window")


def _bit_map(windows: DataFrame) -> Column:
    """The bit map as an array of 2 ** (MAP_BITS - 6) longs that the optimizer folds into one literal."""
    marks = windows.select(F.explode(F.array("h", "key")).alias("h"))
    at = F.col("h").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    rows = marks.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("b")).collect()
    held = {r["w"]: r["b"] for r in rows}
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(1 << (MAP_BITS - 6)))), ",").cast("array<bigint>")


def alignments(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, crc, item_id, item_tokens, align, offs, pairs): windows of an item that line up in a document."""
    windows = cut(benchmark_windows(benchmark, size))
    bits = _bit_map(windows)
    marked = lambda h: F.element_at(bits, (F.shiftright(h.bitwiseAND(F.lit((1 << MAP_BITS) - 1)), 6) + 1).cast("int"))
    hit = lambda h: F.call_function("shiftright", marked(h), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    none = F.array().cast("array<struct<pos:int,h:bigint>>")
    lengths = [r[0] for r in windows.filter(F.col("item_tokens") < size).select("item_tokens").distinct().collect()]

    def places(tokens: Column, n: int) -> Column:
        """Windows of ``n`` tokens whose hash is in the map."""
        last = F.size(tokens) - n
        at = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(tokens, i + 1, n)).alias("h")))
        return F.when(last >= 0 if n >= LEAST else last == 0, F.filter(at, lambda w: hit(w["h"]))).otherwise(none)

    def hits(typed: Column) -> Column:
        held = lambda w, n: F.slice(typed, w["pos"] + 1, n)
        whole = F.transform(
            _let(template(typed), lambda plain: places(plain, size)),
            lambda w: _let(
                held(w, size),
                lambda window: F.struct(
                    w["pos"].alias("pos"), F.when(mostly_slots(window), F.xxhash64(window)).otherwise(w["h"]).alias("key"), window.alias("window")
                ),
            ),
        )
        exact = lambda n: F.transform(
            places(typed, n), lambda w: F.struct(w["pos"].alias("pos"), w["h"].alias("key"), held(w, n).alias("window"))
        )
        short = [exact(n) for n in sorted(lengths)]
        return F.filter(F.concat(whole, *short) if short else whole, lambda w: hit(w["key"]))

    found = docs.filter("text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.crc32("text").alias("crc"), F.explode(_let(typed_tokens(F.col("text")), hits)).alias("w")
    )
    found = found.select("doc_id", "crc", F.col("w.pos").alias("pos"), F.col("w.key").alias("key"), F.col("w.window").alias("window"))
    met = found.join(broadcast_rows(windows), "key").filter(F.size("window") == F.size("item_window"))
    pairs = F.filter(
        F.arrays_zip(F.col("item_window").alias("item"), F.col("window").alias("doc")), lambda p: _is_slot(p["item"])
    )
    lined_up = (
        met.select("doc_id", "crc", "item_id", "item_tokens", (F.col("pos") - F.col("off")).alias("align"), "off", pairs.alias("pairs"))
        .groupBy("doc_id", "crc", "item_id", "item_tokens", "align")
        .agg(F.collect_set(F.struct("off", "pairs")).alias("windows"))
    )
    every = F.flatten(F.col("windows.pairs"))
    lined_up = lined_up.withColumn("pairs", F.array_distinct(every))
    items = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: p["item"]))
    # The value most slots of an item's value have; of equals the unchanged one, then the least.
    votes = lambda of, p: F.struct(
        F.size(F.filter(of, lambda q: q == p)).alias("n"), (p["item"] == p["doc"]).alias("same"), p.alias("pair")
    )
    order = lambda a, b: (
        F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["same"] != b["same"], b["same"].cast("int") - a["same"].cast("int"))
        .when(a["pair"] < b["pair"], -1).when(a["pair"] > b["pair"], 1).otherwise(0)
    )
    elected = _let(
        every,
        lambda of: F.transform(
            items(of),
            lambda item: F.array_sort(F.transform(F.filter(F.array_distinct(of), lambda p: p["item"] == item), lambda p: votes(of, p)), order)[0]["pair"],
        ),
    )
    agreed = F.filter("windows", lambda w: F.forall(w["pairs"], lambda p: F.array_contains(F.col("elected"), p)))
    kept = lined_up.withColumn("elected", F.when(F.size(items(F.col("pairs"))) == F.size("pairs"), F.col("pairs")).otherwise(elected)).withColumn("kept", agreed)
    return kept.select(
        "doc_id", "crc", "item_id", "item_tokens", "align", F.col("kept.off").alias("offs"), F.array_distinct(F.flatten(F.col("kept.pairs"))).alias("pairs")
    )


def broadcast_rows(windows: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``windows`` with a broadcast hint where their measured bytes stay below ``limit``."""
    size = windows.agg(F.sum(F.octet_length(F.array_join("item_window", " ")) + F.lit(160))).first()[0] or 0
    return F.broadcast(windows) if size <= limit else windows


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, cover: float = COVER) -> DataFrame:
    """(doc_id, crc, item_id, windows, cover, reparametrised): the contaminated documents with their items.

    crc is crc32 of the text, which tells documents with the same doc_id
    apart; of rows repeated with the same text one is told. An item shorter
    than the window is covered by an exact copy. Null or empty texts and items
    match nothing. Null ids stay null. Extra columns are ignored.
    """
    aligned = alignments(docs, benchmark, size)
    changed = F.exists("pairs", lambda p: p["item"] != p["doc"])
    consistent = aligned.filter(F.size("offs") > 0).withColumn("changed", changed)
    merged = consistent.groupBy("doc_id", "crc", "item_id", "item_tokens").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("offs")))).alias("offs"), F.max("changed").alias("reparametrised")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    span = F.least(F.lit(size), F.col("item_tokens"))
    covered = F.aggregate(
        "offs",
        zero,
        lambda a, o: F.struct((a["n"] + o + span - F.greatest(a["upto"], o)).cast("int").alias("n"), (o + span).cast("int").alias("upto")),
    )["n"]
    share = covered / F.col("item_tokens")
    return merged.select("doc_id", "crc", "item_id", F.size("offs").alias("windows"), share.alias("cover"), "reparametrised").filter(F.col("cover") >= cover)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay as they are."""
    id_, crc = free_name(docs, "_bad_id"), free_name(docs, "_bad_crc")
    bad = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("crc").alias(crc)).distinct())
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.crc32("text") == F.col(crc))
    return docs.join(broadcast_if_small(bad, 48), same, "left_anti")
