"""The additive match costs as row-local Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.costs import DEFAULT_COSTS, HEURISTICS, CostModel
from glossa.functions.text import byte_offset, fold

#: The costs of a match beside its entry's own.
COSTS = ("term_match_cost", "unmatched_position_cost", "inversion_cost")
_SHIFT = 31
_LOW = (1 << _SHIFT) - 1


def one_edit_prefix(q: Column, t: Column) -> Column:
    """True if one insertion or deletion turns ``q`` into a non-empty prefix of ``t``.

    Lengths that differ by one make an edit distance of 1 a single deletion.
    Edits are of bytes, so a multi-byte character costs two or more: the query
    must be ASCII (no other is one edit from an ASCII text), and so must the longer prefix. A shorter prefix is what is
    left of the query.
    """
    m = F.length(q)
    shorter = (m >= 2) & (F.length(t) >= m - 1) & (F.levenshtein(q, F.left(t, m - 1), 1) == 1)
    prefix = F.left(t, m + 1)
    longer = (F.length(t) >= m + 1) & (F.octet_length(prefix) == m + 1) & (F.levenshtein(q, prefix, 1) == 1)
    return (F.octet_length(q) == m) & (m > 0) & (shorter | longer)


def fuzzy_prefix_distance(q: Column, t: Column) -> Column:
    """0 or 1 if ``q`` is within one insert/delete of a prefix of ``t``, else null."""
    return F.when(F.startswith(t, q), 0).when(one_edit_prefix(q, t), 1)


def term_syllable_cost(q: Column, q_fold: Column, s: Column, costs: CostModel = DEFAULT_COSTS) -> Column:
    """Cost of matching term ``q`` with syllable ``s``; null if they do not match."""
    s_fold = fold(s)
    pos = F.instr(s_fold, q_fold)
    return (
        F.when(q == "", None)
        .when(s_fold == q_fold, 0)
        .when(
            pos > 0,
            byte_offset(s_fold, pos) * costs.substring_offset
            + (F.octet_length(s) - F.octet_length(q)) * costs.completion,
        )
        .when(one_edit_prefix(q, s), costs.fuzzy)
    )


def best_positions(terms: Column, syl: Column, costs: CostModel = DEFAULT_COSTS) -> Column:
    """Per term the cheapest, then earliest syllable, packed as cost * 2^31 + position."""

    def best(t: Column) -> Column:
        def hit(s: Column, i: Column) -> Column:
            cost = term_syllable_cost(t["base"], t["base_fold"], s["base"], costs)
            tone_ok = t["tone"].isNull() | (t["tone"] == s["tone"])
            return F.when(tone_ok, F.shiftleft(cost.cast("bigint"), _SHIFT) + i)

        return F.array_min(F.transform(syl, hit))

    return F.when(
        (F.size(terms) > 0) & (F.size(syl) >= F.size(terms)), F.transform(terms, best)
    )


def packed_cost(b: Column) -> Column:
    return F.shiftright(b, _SHIFT)


def packed_position(b: Column) -> Column:
    return b.bitwiseAND(F.lit(_LOW).cast("bigint"))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def inversion_count(positions: Column) -> Column:
    n = F.size(positions)
    later_smaller = F.transform(
        positions, lambda x, i: F.size(F.filter(F.slice(positions, i + 2, n), lambda y: x > y))
    )
    return total(later_smaller)


def unmatched_cost(positions: Column, n_syllables: Column, costs: CostModel = DEFAULT_COSTS) -> Column:
    """An unmatched syllable i of n weighs n + 1 - i, so subtract the matched weights from the sum."""
    n = n_syllables.cast("bigint")
    every = F.floor(n * (n + 3) / 2)
    matched = total(F.transform(F.array_distinct(positions), lambda p: n + 1 - p))
    return (every - matched) * costs.unmatched_syllable


def syllable_score(terms: Column, syl: Column, costs: CostModel = DEFAULT_COSTS) -> Column:
    """STRUCT of the three costs, null unless every term matches some syllable."""
    best = best_positions(terms, syl, costs)

    def to_costs(b: Column) -> Column:
        positions = F.transform(b, packed_position)
        return F.when(
            F.forall(b, lambda x: x.isNotNull()),
            F.struct(
                total(F.transform(b, packed_cost)).alias("term_match_cost"),
                unmatched_cost(positions, F.size(syl), costs).alias("unmatched_position_cost"),
                (inversion_count(positions) * costs.inversion).alias("inversion_cost"),
            ),
        )

    return F.transform(F.array(best), to_costs)[0]


def definition_score(terms: Column, non_ascii: Column, block: Column, costs: CostModel = DEFAULT_COSTS) -> Column:
    """STRUCT of the three costs of finding every term in the ``search_block``, else null.

    A hit costs by its byte offset, and more if it neither starts the block nor
    follows a space or a hyphen; the block's leading blank covers its start.
    """
    found = F.transform(terms, lambda t: F.instr(block, t["tok_fold"]))

    def hit_cost(p: Column) -> Column:
        at_word = F.substring(block, p - 1, F.lit(1)).isin(" ", "-")
        return (byte_offset(block, p).cast("bigint") - 1) * costs.english_offset + F.when(at_word, 0).otherwise(
            costs.english_mid_word
        )

    def to_costs(ps: Column) -> Column:
        return F.when(
            (F.size(ps) > 0) & F.forall(ps, lambda p: p > 0),
            F.struct(
                (
                    costs.english_base
                    + non_ascii.cast("bigint") * costs.english_non_ascii
                    + total(F.transform(ps, hit_cost))
                ).alias("term_match_cost"),
                F.lit(0).cast("bigint").alias("unmatched_position_cost"),
                (inversion_count(ps) * costs.inversion).alias("inversion_cost"),
            ),
        )

    return F.transform(F.array(found), to_costs)[0]


def heuristic_cost(definitions: Column, rules=HEURISTICS) -> Column:
    """Sum of the rules that apply; a rule looks for its substrings in any of the definitions."""

    def holds_any(needles: tuple[str, ...]):
        return lambda d: reduce(or_, [F.contains(d, F.lit(n)) for n in needles])

    cost = F.lit(0)
    for needles, mode, amount in rules:
        present = F.exists(definitions, holds_any(needles))
        cost = cost + F.when(present if mode == "present" else ~present, amount).otherwise(0)
    return cost


def frequency_cost(frequency: Column, costs: CostModel = DEFAULT_COSTS) -> Column:
    """clamp(-1000 ln f, 1, max) in single precision, truncated; ln(0) is +inf, ln(<0) is NaN -> 0."""
    f = frequency.cast("float")
    raw = (F.lit(-1000.0).cast("float") * F.ln(f).cast("float")).cast("float")
    return (
        F.when(f < 0, 0)
        .when(f == 0, costs.max_char_cost)
        .otherwise(F.least(F.greatest(raw, F.lit(1.0).cast("float")), F.lit(float(costs.max_char_cost)).cast("float")).cast("int"))
    )
