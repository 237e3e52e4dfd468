"""How many results a page holds: a first size, doubled by every press of "more"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: results on the first page.
FIRST_PAGE = 12
LARGEST = (1 << 63) - 1


def doublings(first: int = FIRST_PAGE) -> int:
    """Presses up to which the size fits a BIGINT; further ones ask for LARGEST results, which is all there are."""
    return 63 - first.bit_length()


def page_size(first: int, presses: Column) -> Column:
    size = F.call_function("shiftleft", F.lit(first).cast("bigint"), F.least(presses, F.lit(doublings(first))).cast("int"))
    return F.when(presses <= doublings(first), size).otherwise(F.lit(LARGEST).cast("bigint"))


def page_size_of(first: int, presses: int) -> int:
    """The same for one number."""
    return first << presses if presses <= doublings(first) else LARGEST
