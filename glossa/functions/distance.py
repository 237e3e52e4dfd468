"""Edit distances to a part of the target, as Column expressions.

Only used on candidate pairs that an equi-join has already produced. Distances
are over UTF-8 bytes and case-sensitive; ``byte_characters`` makes strings whose
characters are bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import let


def byte_characters(s: Column) -> Column:
    """The string, or binary, with one character for each of its (UTF-8) bytes."""
    return F.decode(s.cast("binary"), "ISO-8859-1")


def around_piece(before: Column, after: Column, left: Column, right: Column, bound: int) -> Column:
    """Edits that turn ``before`` into an end of ``left`` and ``after`` into a start of ``right``.

    What ``bound`` edits can reach differs by no more than ``bound`` in length,
    so these few lengths are compared.
    """

    def nearest(query: Column, part) -> Column:
        lengths = [F.levenshtein(query, part(F.length(query) + k)) for k in range(-bound, bound + 1)]
        return F.when(query == "", 0).otherwise(reduce(F.least, lengths) if bound else lengths[0])

    return nearest(before, lambda n: F.right(left, n)) + nearest(after, lambda n: F.left(right, n))


def prefix_indel(query: Column, target: Column) -> Column:
    """Inserts and deletes from ``query`` to the nearest non-empty prefix of ``target``.

    The column of the edit table is folded along the target: element i is the
    distance of the first i bytes of the query to the target so far.
    """
    one = lambda s: F.array_remove(F.split(byte_characters(s), ""), "")

    def distance(q: Column, t: Column) -> Column:
        state = "struct<column:array<int>,best:int>"
        first = F.sequence(F.lit(0), F.size(q))

        def along(a: Column, c: Column) -> Column:
            column = a["column"]

            def down(done: Column, x: Column, i: Column) -> Column:
                same = F.when(x == c, F.get(column, i)).otherwise(F.get(column, i + 1) + 1)
                return F.concat(done, F.array(F.least(same, F.get(column, i + 1) + 1, F.element_at(done, -1) + 1)))

            indexed = F.transform(q, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
            new = F.aggregate(indexed, F.array(F.element_at(column, 1) + 1), lambda done, x: down(done, x["x"], x["i"]))
            return let(new, lambda n: F.struct(n.alias("column"), F.least(a["best"], F.element_at(n, -1)).alias("best")).cast(state))

        # The empty prefix does not count: begin with more than any distance.
        start = F.struct(first.alias("column"), (F.size(q) + F.size(t)).alias("best")).cast(state)
        return F.aggregate(t, start, along)["best"]

    whole = let(one(query), lambda q: let(one(target), lambda t: distance(q, t)))
    return F.when((F.octet_length(query) == 0) | (F.octet_length(target) == 0), F.octet_length(query)).otherwise(whole).cast("int")
