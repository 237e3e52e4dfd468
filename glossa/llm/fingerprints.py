"""Document fingerprints by a homomorphic multiset hash.

Every paragraph is hashed to a wide vector of two sections:

* ``LANES`` lanes of 64 uniform bits, summed modulo 2**64. Two documents with
  the same multiset of paragraphs have the same sums, in whatever order the
  paragraphs stand, and no other documents do but by chance of 2**-1024.
* 64 lanes that count, for each bit, the word triples of the paragraph whose
  hash has the bit set, summed modulo 2**32, and the number of triples. Their
  angle estimates how much of two documents is alike.

The fingerprint of a document is the sum of the vectors of its paragraphs, so
a paragraph is inserted or deleted by adding or subtracting its vector
(``insert``, ``delete``), without the rest of the text.

Built-in functions only. The count lanes are added 64 at a time: a mask
spreads the bits of a hash over eight numbers of eight narrow fields, which
are summed for up to 127 triples and then unpacked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import cut

LANES = 16
SHINGLE = 3
#: Triples summed in one-byte fields before they are unpacked; more could reach the sign.
_CHUNK = 127
_FIELDS = 0x0101010101010101
#: Rows aimed at per range of neighbouring documents.
RANGE_ROWS = 2_000
#: Ranges whose heads are compared in one task, and the most there are in all (about; their heads are broadcast).
TOP_RANGES = 4_096
MOST_RANGES = 500_000
#: Stretches of ids between quantiles.
STRETCHES = 512


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    """Lines that are not blank, without white space around them."""
    return F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def _wrapped(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, which plain addition refuses on overflow: the halves are added apart."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def _lanes(parts: Column) -> Column:
    """The uniform section: for each lane the sum over the paragraphs."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(LANES - 1)),
        lambda k: F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: _wrapped(a, F.xxhash64(p, k))),
    )


def _triples(paragraph: Column) -> Column:
    """Hashes of the word triples of a paragraph; a shorter paragraph is one."""
    words = F.split(F.lower(paragraph), r"\s+")

    def hashes(w: Column) -> Column:
        return F.when(
            F.size(w) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
        ).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))

    return _let(words, hashes)


def _bit_counts(hashes: Column) -> Column:
    """For each of 64 bits the number of hashes that have it."""
    n = F.size(hashes)
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: F.slice(hashes, c * _CHUNK + 1, _CHUNK)))
    chunks = F.coalesce(chunks, F.array().cast("array<array<bigint>>"))
    fields = [f"f{k}" for k in range(8)]
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f) for f in fields])
    mask = F.lit(_FIELDS).cast("bigint")

    def step(a: Column, h: Column) -> Column:
        return F.struct(*[(a[f] + F.shiftrightunsigned(h, k).bitwiseAND(mask)).alias(f) for k, f in enumerate(fields)])

    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, step))
    count = lambda all_, k, j: F.aggregate(
        all_, F.lit(0).cast("bigint"), lambda a, s: a + F.shiftrightunsigned(s[f"f{k}"], 8 * j).bitwiseAND(F.lit(0xFF))
    )
    return _let(sums, lambda all_: F.array(*[count(all_, b % 8, b // 8) for b in range(64)]))


def vector(text: Column) -> Column:
    """struct(lanes array<bigint>, counts array<bigint>, n bigint): the sum over the paragraphs of a text."""

    def both(parts: Column) -> Column:
        hashes = F.flatten(F.transform(parts, _triples))
        return F.struct(
            _lanes(parts).alias("lanes"),
            _let(hashes, lambda h: F.struct(_bit_counts(h).alias("counts"), F.size(h).cast("bigint").alias("n"))).alias("t"),
        )

    return _let(_let(paragraphs(text), both), lambda v: F.struct(v["lanes"].alias("lanes"), v["t"]["counts"].alias("counts"), v["t"]["n"].alias("n")))


def insert(fingerprint: Column, paragraph: Column) -> Column:
    """The vector of a document after a paragraph has been put in."""
    return _combine(fingerprint, vector(paragraph), _wrapped, lambda a, b: (a + b) % (1 << 32))


def delete(fingerprint: Column, paragraph: Column) -> Column:
    """The vector of a document after one occurrence of a paragraph has been taken out."""
    negated = lambda a, b: _wrapped(a, _wrapped(b.bitwiseXOR(F.lit(-1).cast("bigint")), F.lit(1).cast("bigint")))
    return _combine(fingerprint, vector(paragraph), negated, lambda a, b: F.pmod(a - b, F.lit(1 << 32)))


def _combine(a: Column, b: Column, lane, count) -> Column:
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lane).alias("lanes"), F.zip_with(a["counts"], b["counts"], count).alias("counts"), count(a["n"], b["n"]).alias("n")
    )


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the centred counts, 1 for equal fingerprints."""
    centred = lambda v: F.transform(v["counts"], lambda c: (2 * c - v["n"]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    def cosine(x: Column, y: Column) -> Column:
        size = F.sqrt(dot(x, x) * dot(y, y))
        return F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / size))).otherwise(0.0)

    close = _let(F.struct(centred(a).alias("x"), centred(b).alias("y")), lambda p: cosine(p["x"], p["y"]))
    return F.when((a["lanes"] == b["lanes"]) & (a["counts"] == b["counts"]), 1.0).otherwise(close)


def as_hex(v: Column) -> Column:
    """The fingerprint as text: the lanes in 16 hexadecimal digits, then the counts and their number in 8."""
    lanes = F.array_join(F.transform(v["lanes"], lambda x: F.lpad(F.hex(x), 16, "0")), "")
    counts = F.array_join(F.transform(F.concat(v["counts"], F.array(v["n"])), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << 32))), 8, "0")), "")
    return F.lower(F.concat(lanes, counts))


def _range_of(docs: DataFrame, tie: Column) -> Column | None:
    """A range number that grows with doc_id, then ``tie``, with about RANGE_ROWS rows to a range.

    Approximate quantiles cut the ids into stretches of like size, and each
    stretch is cut evenly. Null ids come before all others, in ranges of their
    tie. None for no rows.
    """
    n, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    if not n:
        return None
    rows = max(RANGE_ROWS, n // MOST_RANGES)
    points = min(STRETCHES, max(1, ids // rows))
    marks = [i / points for i in range(points + 1)]
    bounds = docs.agg(F.percentile_approx("doc_id", marks)).first()[0] if ids else [0, 0]
    low = sorted(set(bounds))
    high = low[1:] + [low[-1] + 1]
    inner = max(1, ids // points // rows)
    width = [max(1.0, (b - a) / inner) for a, b in zip(low, high, strict=True)]
    literal = lambda xs, t: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{t}>")
    at = F.greatest(F.lit(1), F.size(F.filter(literal(low, "bigint"), lambda x: x <= F.col("doc_id"))))
    inside = F.floor((F.col("doc_id").cast("double") - F.element_at(literal(low, "double"), at)) / F.element_at(literal(width, "double"), at))
    kept = F.least(F.greatest(inside, F.lit(0)), F.lit(2 * inner)).cast("bigint")
    bits = max(1, ((n - ids) // rows).bit_length())
    unknown = F.shiftright(tie, 64 - bits) + F.lit((1 << (bits - 1)) - (1 << bits)).cast("bigint")
    return F.when(F.col("doc_id").isNull(), unknown).otherwise(at.cast("bigint") * (2 * inner + 1) + kept)


def with_next(docs: DataFrame, value: str, name: str, derive) -> DataFrame:
    """``docs`` with ``derive`` applied, and ``name``: the struct of ``value`` and the derived columns of the next row.

    Next is by descending doc_id; the first row follows the last. Rows lie in
    ranges of doc_id. Each range is one window, and the first row of the range
    below is copied into it as a guest, so texts are shuffled once. Of equal
    ids the order is that of a hash of the value; null ids come last. There are
    at most about MOST_RANGES ranges, whose heads are broadcast.
    """
    tie = F.xxhash64(value)
    where = _range_of(docs, tie)
    if where is None:
        return derive(docs).withColumn(name, F.struct(*derive(docs).drop("doc_id").columns))
    keys = docs.select("doc_id", tie.alias("_tie"), where.alias("range"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie")
    heads = cut(keys.groupBy("range").agg(F.max(order).alias("head")))
    block = F.floor(F.col("range") / TOP_RANGES).cast("bigint")
    blocks = heads.groupBy(block.alias("_block")).agg(F.max_by("head", "range").alias("head"))
    # Blocks of ranges are few: one task looks over them, each of the others over a block.
    above = blocks.select("_block", F.coalesce(F.lead("head").over(Window.orderBy(F.desc("_block"))), F.first("head").over(Window.orderBy(F.desc("_block")))).alias("_above"))
    within = F.lead("head").over(Window.partitionBy("_block").orderBy(F.desc("range")))
    hosts = (
        heads.withColumn("_block", block)
        .withColumn("_in", within)
        .join(above, "_block")
        .select(F.col("range").alias("_host"), F.coalesce("_in", "_above").alias("_head"))
        .select("_host", F.col("_head.doc_id").alias("_gid"), F.col("_head._tie").alias("_gtie"))
    )
    visiting = docs.withColumn("_tie", tie).join(
        F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("_gid")) & (F.col("_tie") == F.col("_gtie"))
    )
    # A head may be repeated; one copy of it is enough.
    guests = derive(visiting.groupBy(F.col("_host").alias("_range")).agg(F.min(value).alias(value)).withColumn("doc_id", F.lit(None).cast("bigint")))
    own = derive(docs.withColumn("_range", where)).withColumn("_guest", F.lit(False))
    both = own.unionByName(guests.withColumn("_guest", F.lit(True)))
    line = Window.partitionBy("_range").orderBy(F.col("_guest"), F.desc_nulls_last("doc_id"), F.desc(tie))
    carried = [c for c in own.columns if c not in ("_range", "_guest", "doc_id")]
    return both.withColumn(name, F.lead(F.struct(*carried)).over(line)).filter(~F.col("_guest")).drop("_range", "_guest")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last floor(n_chars / 2) code points replaced by as
    many from the start of the next document's text, in descending doc_id; the
    last document's next is the first, and a single document's is itself. A
    null text counts as empty; an empty text has the fingerprint zero.
    Repeated rows follow each other. Extra columns are ignored.
    """
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(given, "text", "next", lambda rows: rows.withColumn("v", vector(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    # Where nothing is replaced, the next text is not looked at.
    edited = F.when(half > 0, F.concat(F.substring("text", F.lit(1), n - half), F.left(F.col("next.text"), half))).otherwise(F.col("text"))
    hashed = paired.select("doc_id", n.cast("bigint").alias("n_chars"), "v", F.col("next.v").alias("next_v"), edited.alias("edited"))
    vectors = hashed.select("doc_id", "n_chars", "v", "next_v", F.sha2("edited", 256).alias("edited_sha256"), F.array(vector(F.col("edited"))).alias("w"))
    w = F.col("w")[0]
    return vectors.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("v")).alias("fingerprint"),
        as_hex(w).alias("edited_fingerprint"),
        likeness(F.col("v"), w).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
