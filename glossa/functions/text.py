"""String helpers as Column expressions.

Case folding is ASCII-only throughout and offsets are UTF-8 byte offsets, so
accented, CJK and emoji text behaves the same as plain text.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACES = (" ", "\t", "\n", "\r", "\f")
ASCII_SPACE = "[ \\t\\n\\r\\f]"
_TOKEN_BODY = "A-Za-z\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F"
SYLLABLE_TOKEN = f"([0-9{_TOKEN_BODY}][{_TOKEN_BODY}]*[0-9])"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def fold(c: Column) -> Column:
    """ASCII lower-casing; ``lower`` is only safe when every character is one byte."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, ascii_uppercase, ascii_lowercase)
    )


def ci_equals(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def byte_offset(text: Column, char_pos: Column) -> Column:
    """Byte offset of the 1-based character position ``char_pos``."""
    return F.octet_length(F.substring(text, F.lit(1), char_pos - 1))


def ci_index_of(needle: Column, haystack: Column) -> Column:
    """Byte offset of the first ASCII-case-insensitive hit, null if there is none."""
    pos = F.instr(fold(haystack), fold(needle))
    return F.when((F.length(needle) > 0) & (pos > 0), byte_offset(haystack, pos))


def characters(c: Column) -> Column:
    return F.array_remove(F.split(c, ""), "")


def split_ascii_space(c: Column) -> Column:
    return F.array_remove(F.split(c, ASCII_SPACE + "+"), "")


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def parse_definitions(body: Column) -> Column:
    """``/``-separated definitions: cut at the first ``#``, trim, drop empties."""
    parts = F.split(F.substring_index(body, "#", 1), "/")
    return F.filter(F.transform(parts, trim_unicode), lambda x: x != "")


def ordered_ci_distinct(items: Column) -> Column:
    """Drop later items equal to an earlier one but for ASCII case; keeps order.

    Sort, compare neighbours, sort back: n log n also for very long lists.
    """
    tagged = F.sort_array(
        F.transform(
            items,
            lambda x, i: F.struct(fold(x).alias("f"), i.alias("i"), x.alias("x")),
        )
    )
    firsts = let(
        tagged,
        lambda s: F.filter(s, lambda x, i: (i == 0) | (x["f"] != F.get(s, i - 1)["f"])),
    )
    back = F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"))))
    return F.transform(back, lambda x: x["x"])


def syllable_tokens(reading: Column) -> Column:
    """Maximal ASCII runs that end at their first digit."""
    return F.regexp_extract_all(reading, F.lit(SYLLABLE_TOKEN), F.lit(1))


def token_tone(tok: Column) -> Column:
    last = F.right(tok, F.lit(1))
    return F.when(last.rlike("^[0-9]$"), last.cast("int"))


def token_base(tok: Column) -> Column:
    return F.when(
        F.right(tok, F.lit(1)).rlike("^[0-9]$"),
        F.substring(tok, F.lit(1), F.length(tok) - 1),
    ).otherwise(tok)


def syllables(reading: Column) -> Column:
    """ARRAY<STRUCT<base STRING, tone INT>> of a reading."""
    return F.transform(
        syllable_tokens(reading),
        lambda t: F.struct(
            F.substring(t, F.lit(1), F.length(t) - 1).alias("base"),
            F.right(t, F.lit(1)).cast("int").alias("tone"),
        ),
    )


def display_reading(syl: Column) -> Column:
    return F.array_join(F.transform(syl, lambda s: F.concat(s["base"], s["tone"].cast("string"))), " ")


def definition_block(definitions: Column) -> Column:
    """All definitions back to back, without separators."""
    return F.concat_ws("", definitions)


def search_block(definitions: Column) -> Column:
    """The folded definition block with every ASCII space made a blank and one blank at either end.

    Blanks keep their width, so offsets are those of the block plus one, and
    every word is a blank-delimited run.
    """
    blanks = F.translate(fold(definition_block(definitions)), "".join(ASCII_SPACES), " " * len(ASCII_SPACES))
    return F.concat(F.lit(" "), blanks, F.lit(" "))


def block_words(block: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(block, " +"), ""))


def non_ascii_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def escape_html(c: Column) -> Column:
    # The five escaped characters; & has to go first.
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _chunked(xs: Column, chunk: int, body) -> Column:
    """``body(chunks)`` for the elements, as BIGINT, in arrays of ``chunk``.

    The elements are bound, as each chunk would compute them all anew.
    """

    def chunks(xs: Column) -> Column:
        whole = F.floor((F.size(xs) - 1) / chunk).cast("int")
        some = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), whole), lambda c: F.slice(xs, c * chunk + 1, chunk)))
        return let(F.coalesce(some, F.array().cast("array<array<bigint>>")), body)

    return let(F.transform(xs, lambda x: x.cast("bigint")), chunks)


def _running(xs: Column, start: Column, op, inclusive: bool) -> Column:
    """The fold of ``start`` and the elements up to each element, or before it."""

    def grow(a: Column, x: Column) -> Column:
        after = op(a["run"], x)
        return F.struct(F.concat(a["out"], F.array(after if inclusive else a["run"])).alias("out"), after.alias("run"))

    return F.aggregate(xs, F.struct(F.array().cast("array<bigint>").alias("out"), start.alias("run")), grow)["out"]


def totals_before(sizes: Column, chunk: int = 64) -> Column:
    """Sum of the elements before each element.

    In two levels, as an array grown by one element at a time is copied each
    time: chunks first, then within a chunk.
    """
    zero = F.lit(0).cast("bigint")
    add = lambda a, x: a + x
    return _chunked(
        sizes,
        chunk,
        lambda cs: let(
            _running(F.transform(cs, lambda c: F.aggregate(c, zero, add)), zero, add, False),
            lambda starts: F.flatten(F.transform(cs, lambda c, i: _running(c, F.get(starts, i), add, False))),
        ),
    )


def running_max(xs: Column, chunk: int = 64) -> Column:
    """The highest of the elements up to each element, in two levels too."""
    least = F.lit(-(2**63)).cast("bigint")
    return _chunked(
        xs,
        chunk,
        lambda cs: let(
            _running(F.transform(cs, F.array_max), least, F.greatest, False),
            lambda starts: F.flatten(F.transform(cs, lambda c, i: _running(c, F.get(starts, i), F.greatest, True))),
        ),
    )


def grams(c: Column, n: int) -> Column:
    """Distinct overlapping n-character substrings."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
