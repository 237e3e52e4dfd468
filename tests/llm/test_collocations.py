"""Collocations against brute force with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import collocations as col

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, best=2000, least=10):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        chosen = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and c >= least and p in (q[:2], q[1:]) and 100 * c >= 50 * a for q, c in counts.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            chosen.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(chosen)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string").repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("w1", "w2", "n", "f", "group", "phrase", "heavy", "l")})
    return sorted(map(tuple, col.collocations(df, **options).collect()))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "über", "naïve", "x\x01y", "a-b", "o'c", "日本", "run", "\x00"]
    seps = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "!", "\r\n", "; "]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "de", None]), rng.choice([t, t, "new york city hall " * rng.randint(0, 4) + t])))
    return out + [("en", None), ("de", ""), (None, " \t\n.,"), *([("fr", "copy of a text of copies")] * 12), ("fr", "copy of")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_brute_force(spark, seed):
    rows = texts(seed, 80)
    assert run(spark, rows) == brute(rows)


def test_extended_prefixes_and_few_results(spark):
    rows = texts(4, 120)
    # Nearly every first word is over an eighth of the budget, and there are many groups.
    assert run(spark, rows, budget=64, best=7, least=3) == brute(rows, 7, 3)


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [("en", None), ("en", "")]) == []


def test_many_distinct_words(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 997) for i in range(3000)) + b"\nlast"
    words, columns, n = col.suffix_counts(text)
    plain = Counter(zip(*([words.take(pa.array(c, mask=c < 0)).to_pylist() for c in columns]), n.tolist(), strict=True))
    monkeypatch.setattr(col, "PACKED_WORDS", 10)
    words, columns, n = col.suffix_counts(text)
    assert plain == Counter(zip(*([words.take(pa.array(c, mask=c < 0)).to_pylist() for c in columns]), n.tolist(), strict=True))


def test_long_text(spark):
    row = ("en", "one two three. " * 200_000)
    assert run(spark, [row]) == [("en", 1, "one two three", 200000, 200000, 200000, 600000, 1000000)]
