"""Thresholds of the quality classifier, by brute force and on a thin language."""

import math
import random

import numpy as np
import pytest

from glossa.llm import quality


def brute(rows, quantile):
    def reached(values):
        values = sorted(math.ceil(v * quality.BINS) for v in values)
        return next(v for i, v in enumerate(values, 1) if i / len(values) >= quantile and (i == len(values) or values[i] > v))

    held = [r for r in rows if r[2]]
    common = reached([r[1] for r in held] or [r[1] for r in rows])
    out = {}
    for lang in {r[0] or "" for r in rows}:
        own = [r[1] for r in held if (r[0] or "") == lang]
        n = len(own)
        out[lang] = ((reached(own) if n else common) * n + common * quality.LEAST_HELD) / (n + quality.LEAST_HELD) / quality.BINS
    return out


@pytest.mark.parametrize("quantile", [0.5, 0.97])
def test_threshold_is_the_blended_quantile(spark, quantile):
    rng = random.Random(2)
    rows = [(lang, round(rng.gauss(centre, 0.4), 4), rng.random() < share) for lang, centre, share, n in (("en", 4, 0.3, 300), ("de", 6, 0.05, 60), (None, 9, 0, 30)) for _ in range(n)]
    for given in (rows, [(a, b, False) for a, b, _ in rows]):
        got = quality.thresholds(spark.createDataFrame(given, "lang string, log_perplexity double, held boolean"), quantile).collect()
        want = brute(given, quantile)
        assert {r[0] for r in got} == set(want) and all(r[1] == pytest.approx(want[r[0]]) for r in got)
    assert quality.thresholds(spark.createDataFrame([], "lang string, log_perplexity double, held boolean")).count() == 0


def test_a_thin_language_of_junk_goes(spark):
    rng = random.Random(3)
    words = "the of and river stone cloud green walking slowly under seven lamps".split()
    good = [(i, "en", " ".join(rng.choice(words) for _ in range(60))) for i in range(400)]
    junk = [(1000 + i, "xx", " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame(good + junk, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400)], "doc_id bigint, quality int")
    out = quality.classify(docs, labels).collect()
    assert sum(r["keep"] for r in out if r["lang"] == "xx") < 20
    assert sum(r["keep"] for r in out if r["lang"] == "en") > 380
    assert all(r["keep"] == (math.log(r["perplexity"]) <= math.log(r["threshold"])) for r in out if abs(math.log(r["perplexity"]) - math.log(r["threshold"])) > 1e-9)


def test_places_in_runs():
    rng = np.random.default_rng(1)
    times = rng.integers(1, 5, 200).astype(np.uint32)
    places = np.concatenate([np.sort(rng.integers(0, 8192, t)) for t in times])
    assert (quality.unpack_places(quality.pack_places(places, times), times) == places).all()
