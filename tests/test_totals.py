"""Running totals in two levels."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from glossa.functions.text import totals_before


def test_totals_before(spark):
    rng = random.Random(51)
    cases = [[rng.randint(0, 2**31 - 1) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 200, 4097)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x array<int>").coalesce(1)
    got = [r["t"] for r in df.orderBy("i").select(totals_before(F.col("x")).alias("t")).collect()]
    assert got == [list(accumulate(c, initial=0))[:-1] for c in cases]
