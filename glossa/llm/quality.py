"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted text, the documents labelled as good, and keeps
all words of that text. A word is a 64-bit code: the most frequent ones have
short codes, and what is kept of them, of bounded size, travels with the tasks;
every other word is coded by its hash. Which words have short codes changes
what is shuffled, not the result.

Bigram counts grow with the corpus. A bigram belongs to the shard of its second
word if that has no short code, else to that of its first word, else to one by
a hash of both. So all that is known of a word without a short code lies in its
shard, but for the counts of its bigrams with another such word, which the
shards tell each other. No such word is frequent, and no shard gets a hot key.

The log-probability of a bigram that was not seen is the sum of what its context
and its word give; a seen one adds a difference. So the words with short codes
and the most frequent bigrams, a bounded number, are scored where the documents
are read. The other bigrams travel as sorted, compressed blocks, a block per
shard and chunk of documents, and meet their counts; their shares are summed
per document.

A tenth of the trusted documents is left out of the training. A document is
kept if its perplexity does not exceed a quantile of these in its language.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import broadcast_if_small, cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words with short codes, and the longest of them. Others are coded by their hash; the result is the same.
SHORT_CODES = 1 << 18
LONGEST_SHORT = 64
#: One in so many documents is asked for frequent words.
ASKED = 8
#: Bigrams scored where the documents are read.
FREQUENT = 1 << 18
#: Text bytes per shard.
SHARD_BYTES = 1 << 26
LEAST_SHARDS = 16
#: Documents and tokens per chunk.
CHUNK_DOCS, CHUNK_TOKENS = 8_192, 1_000_000
QUANTILE = 0.97
#: Held-out documents of a language that weigh as much in its threshold as those of all languages together.
LEAST_HELD = 20
#: Bins of log-perplexity per unit, for the quantiles.
BINS = 1_000

NOTHING, EDGE, FIRST = 0, 1, 2
#: Set in the codes that are hashes.
_HASHED = 1 << 63
_TOKEN = re.compile(r"\w+|[^\w\s]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def word_codes(text: str, index: dict[str, int]) -> np.ndarray:
    """Codes of the words of a text between two edges."""
    words = tokens(text)
    codes = np.empty(len(words) + 2, dtype=np.uint64)
    codes[0] = codes[-1] = EDGE
    get, h = index.get, xxhash.xxh64_intdigest
    codes[1:-1] = [get(w) or h(w.encode("utf-8", "surrogatepass")) | _HASHED for w in words]
    return codes


def hashed(codes: np.ndarray) -> np.ndarray:
    return codes >= np.uint64(_HASHED)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _ODD2
    return x ^ (x >> np.uint64(32))


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of bigrams."""
    return _mix(_mix(context) + word * _ODD)


def shard_of(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    home = np.where(hashed(word), _mix(word), np.where(hashed(context), _mix(context), pair_keys(context, word)))
    return ((home >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal rows of sorted arrays begins."""
    n = len(sorted_[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def pack_codes(codes: np.ndarray, sorted_: bool = False) -> bytes:
    """Codes, or the differences of sorted ones, byte planes apart, compressed."""
    steps = (np.diff(codes, prepend=np.uint64(0)) if sorted_ else codes).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_codes(blob: bytes, sorted_: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    codes = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    return np.cumsum(codes, dtype=np.uint64) if sorted_ else codes


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=kind)


def pack_places(places: np.ndarray, times: np.ndarray) -> bytes:
    """Places that rise within runs of ``times``: a run's first one and then the steps, byte planes apart, compressed."""
    steps = np.diff(places, prepend=0)
    first = np.cumsum(times) - times
    steps[first] = places[first]
    return zlib.compress(np.ascontiguousarray(steps.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes(), 1)


def unpack_places(blob: bytes, times: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(2, -1).T).view("<u2").reshape(-1).astype(np.int64)
    first = np.cumsum(times, dtype=np.int64) - times
    upto = np.cumsum(steps)
    return upto - np.repeat(upto[first] - steps[first], times)


def trusted_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text, trusted): trusted where labelled quality 1. Labels are broadcast if their counted size allows."""
    good = cut(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(broadcast_if_small(good.withColumn("trusted", F.lit(True)), 24), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 10 == 0


def frequent_words(docs: DataFrame, size: int | None = None) -> list[str]:
    """The words of ``docs`` from some count on, at most ``size``, most frequent first."""
    size = SHORT_CODES if size is None else size

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(w for w in tokens(text) if len(w) <= LONGEST_SHORT)
            if len(held) > 400_000:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    counts = cut(docs.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 32).cast("int")
    # Few levels, whatever the counts: 32 for each doubling.
    levels = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    taken, lowest = 0, None
    for at in sorted(levels, reverse=True):
        if taken + levels[at] > size:
            break
        taken, lowest = taken + levels[at], at
    if lowest is None:
        return []
    words = counts.filter(level >= lowest).collect()
    return [r["word"] for r in sorted(words, key=lambda r: (-r["n"], r["word"]))]


_STATS = ("total", "n1", "n2", "n3")
_COUNTED = (
    "kind int, shard int, source int, a binary, w binary, counts binary, "
    + ", ".join(f"{x} array<bigint>" for x in ("word", *_STATS, "before", "spectrum", "befores"))
)


def count_bigrams(training: DataFrame, index: dict[str, int], shards: int) -> DataFrame:
    """Rows of ``_COUNTED``.

    Kind 0, one row per shard: its bigrams (a, w) with their counts, sums for
    the words with short codes, counts of counts, and of its other words the
    numbers of those seen in 1, 2, 3, 4 and in 3 or more contexts, the sum of
    contexts and the number of words. Kind 1: sums of contexts without short
    codes in the bigrams of shard ``source``, for the shard of the context.
    """
    width = FIRST + len(index)

    def count(batches):
        held, n = [], 0

        def flush():
            a, w = np.concatenate([k[:-1] for k in held]), np.concatenate([k[1:] for k in held])
            order = np.lexsort((w, a))
            a, w = a[order], w[order]
            first = _runs(a, w)
            a, w, counts = a[first], w[first], np.diff(first, append=len(a))
            where = shard_of(a, w, shards)
            rows = []
            for s in np.unique(where):
                own = where == s
                rows.append((s, pack_codes(a[own], True), pack_codes(w[own]), _pack(counts[own], "<i8")))
            return pd.DataFrame(rows, columns=["shard", "a", "w", "counts"]).astype({"shard": "int32"})

        for batch in batches:
            for text in batch["text"]:
                codes = word_codes(text, index)
                held.append(codes)
                n += len(codes)
                if n > 2 * CHUNK_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        a = np.concatenate([unpack_codes(b, True) for b in group["a"]])
        w = np.concatenate([unpack_codes(b) for b in group["w"]])
        counts = np.concatenate([_unpack(b, "<i8") for b in group["counts"]])
        order = np.lexsort((w, a))
        a, w, counts = a[order], w[order], counts[order]
        first = _runs(a, w)
        a, w, counts = a[first], w[first], np.add.reduceat(counts, first)
        rare_a, rare_w = hashed(a), hashed(w)
        marks = (counts == 1, counts == 2, counts >= 3)
        short, known = a[~rare_a].astype(np.int64), counts[~rare_a]
        per = np.stack(
            [
                np.bincount(short, known, width),
                *(np.bincount(short, hit[~rare_a], width) for hit in marks),
                np.bincount(w[~rare_w].astype(np.int64), minlength=width),
            ]
        ).astype(np.int64)
        used = np.flatnonzero(per.any(axis=0))
        _, before = np.unique(w[rare_w], return_counts=True)
        blank = dict.fromkeys(c.split()[0] for c in _COUNTED.split(", "))
        row = blank | {"kind": 0, "shard": shard, "a": pack_codes(a, True), "w": pack_codes(w), "counts": _pack(counts, "<i8"), "word": used.tolist()}
        row |= {name: per[i, used].tolist() for i, name in enumerate((*_STATS, "before"))}
        row["spectrum"] = [int((counts == c).sum()) for c in (1, 2, 3, 4)]
        row["befores"] = [*(int((before == c).sum()) for c in (1, 2, 3, 4)), int((before >= 3).sum()), int(before.sum()), len(before)]
        rows = [row]
        at = np.flatnonzero(rare_a)
        first = _runs(a[at])
        if len(first):
            codes = a[at[first]]
            sums = np.stack([np.add.reduceat(x[at].astype(np.int64), first) for x in (counts, *marks)])
            to = shard_of(codes, np.zeros_like(codes), shards)
            for t in np.unique(to):
                own = to == t
                rows.append(blank | {"kind": 1, "shard": int(t), "source": shard, "a": pack_codes(codes[own], True), "counts": _pack(sums[:, own], "<i8")})
        return pd.DataFrame(rows).astype({"source": "Int32"})

    return (
        training.select("text")
        .mapInPandas(count, "shard int, a binary, w binary, counts binary")
        .groupBy("shard")
        .applyInPandas(merge, _COUNTED)
    )


def context_sums(table: DataFrame) -> DataFrame:
    """(shard, a, counts): whole sums of the contexts without short codes, told to each shard that has bigrams of them."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_codes(b, True) for b in group["a"]]
        codes, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.zeros((4, len(codes)), dtype=np.int64)
        given = np.concatenate([_unpack(b, "<i8").reshape(4, -1) for b in group["counts"]], axis=1)
        np.add.at(sums, (slice(None), at), given)
        home, sources = int(group["shard"].iloc[0]), group["source"].tolist()
        rows = [(home, pack_codes(codes, True), _pack(sums, "<i8"))]
        rows += [(s, b, _pack(sums[:, np.searchsorted(codes, c)], "<i8")) for s, b, c in zip(sources, group["a"], asked, strict=True) if s != home]
        return pd.DataFrame(rows, columns=["shard", "a", "counts"])

    return table.filter("kind = 1").groupBy("shard").applyInPandas(answer, "shard int, a binary, counts binary")


def discounts(spectrum: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more from the numbers of things seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(max(n, 1)) for n in spectrum)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0] + [min(max(d, 0.1 * k), k - 0.05) for k, d in enumerate(raw, 1)])


class BigramModel:
    """The discounts, what is kept of the words with short codes, and the frequent bigrams. All else comes from the shards."""

    def __init__(self, per_word: dict[int, tuple], width: int, spectrum: list[int], befores: list[int]):
        stats, before = np.zeros((4, width)), np.zeros(width)
        for w, row in per_word.items():
            stats[:, w], before[w] = row[:4], row[4]
        self.discount = discounts(spectrum)
        # The lower order: in how many contexts a word was seen, discounted in the same way, over a uniform share.
        seen = [int((before == c).sum()) + befores[c - 1] for c in (1, 2, 3, 4)]
        self.lower = e = discounts(seen)
        self.contexts = max(before.sum() + befores[5], 1.0)
        more = int((before >= 3).sum()) + befores[4]
        discounted = seen[0] * min(1, e[1]) + seen[1] * min(2, e[2]) + more * e[3]
        words = int((before[FIRST:] > 0).sum()) + befores[6] + FIRST
        self.uniform = (discounted / self.contexts if seen[0] + seen[1] + more else 1.0) / words
        self.total, self.back, self.single = stats[0], self.backing(stats), self.lower_order(before)
        self.frequent_keys = np.zeros(0, dtype=np.uint64)
        self.frequent_gains = np.zeros(0)

    def backing(self, stats: np.ndarray) -> np.ndarray:
        """Weight of the lower order after contexts with the sums (total, n1, n2, n3); 1 after one that was not seen."""
        d = self.discount
        return np.where(stats[0] > 0, (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]) / np.maximum(stats[0], 1), 1.0)

    def lower_order(self, before: np.ndarray) -> np.ndarray:
        return (before - np.minimum(before, self.lower[np.minimum(before, 3).astype(int)])) / self.contexts + self.uniform

    def gain(self, counts: np.ndarray, total: np.ndarray, back: np.ndarray, single: np.ndarray) -> np.ndarray:
        """What a bigram seen ``counts`` times has over the lower order, in log-probability; 0 where not seen."""
        seen = np.maximum(counts - self.discount[np.minimum(counts, 3)], 0) / np.maximum(total, 1)
        return np.where(counts > 0, np.log1p(seen / (back * single)), 0.0)


def train(training: DataFrame, asked: DataFrame, shards: int) -> tuple[list[str], BigramModel, DataFrame]:
    """(words with short codes, model, rows (shard, a, w, counts) of bigrams and, without w, of contexts)."""
    words = frequent_words(asked)
    index = {w: i for i, w in enumerate(words, FIRST)}
    table = cut(count_bigrams(training, index, shards))
    names = [*_STATS, "before"]
    each = table.filter("kind = 0").select(F.explode(F.arrays_zip("word", *names)).alias("w")).groupBy("w.word").agg(*[F.sum(f"w.{n}").alias(n) for n in names])
    per_word = {r["word"]: tuple(r[n] for n in names) for r in each.collect()}  # no more rows than short codes
    sums = table.select(*[F.sum(F.col("spectrum")[i]) for i in range(4)], *[F.sum(F.col("befores")[i]) for i in range(7)]).first()
    sums = [int(s or 0) for s in sums]
    model = BigramModel(per_word, FIRST + len(words), sums[:4], sums[4:])

    def short(a, w, counts):
        a, w, counts = unpack_codes(a, True), unpack_codes(w), _unpack(counts, "<i8")
        own = ~hashed(a) & ~hashed(w)
        return a[own], w[own], counts[own], np.floor(np.log2(counts[own]) * 8).astype(int)

    def levels(batches):
        for batch in batches:
            held: Counter = Counter()
            for row in zip(batch["a"], batch["w"], batch["counts"], strict=True):
                held.update(dict(zip(*(x.tolist() for x in np.unique(short(*row)[3], return_counts=True)), strict=True)))
            if held:
                yield pd.DataFrame({"level": list(held), "n": list(held.values())}).astype("int64")

    bigrams = table.filter("kind = 0").select("a", "w", "counts")
    found = bigrams.mapInPandas(levels, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    taken, lowest = 0, None
    for r in sorted(found, reverse=True):
        if taken + r["n"] > FREQUENT:
            break
        taken, lowest = taken + r["n"], r["level"]

    def frequent(batches):
        for batch in batches:
            for row in zip(batch["a"], batch["w"], batch["counts"], strict=True):
                a, w, c, level = short(*row)
                hit = level >= lowest
                yield pd.DataFrame({"a": a[hit].astype(np.int64), "w": w[hit].astype(np.int64), "n": c[hit]})

    if lowest is not None:
        rows = bigrams.mapInPandas(frequent, "a bigint, w bigint, n bigint").toPandas().sort_values(["a", "w"])  # at most FREQUENT rows
        a, w, n = (rows[c].to_numpy(dtype=np.int64) for c in ("a", "w", "n"))
        model.frequent_keys = (a.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
        model.frequent_gains = model.gain(n, model.total[a], model.back[a], model.single[w])
    contexts = cut(context_sums(table)).select("shard", "a", F.lit(None).cast("binary").alias("w"), "counts")
    return words, model, table.filter("kind = 0").select("shard", "a", "w", "counts").union(contexts)


_HEAD = "ids array<bigint>, langs array<string>, n array<int>, held array<boolean>, local array<double>"


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    """``values`` at the ``wanted`` of the sorted ``keys``."""
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class Shard:
    """What a shard knows: its bigrams and its words without short codes."""

    def __init__(self, model: BigramModel, counted: pd.DataFrame):
        self.model = model
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.words, self.single = np.zeros(0, dtype=np.uint64), np.zeros(0)
        codes, sums = [np.zeros(0, dtype=np.uint64)], [np.zeros((4, 0), dtype=np.int64)]
        for r in counted.itertuples(index=False):
            a = unpack_codes(r.a, True)
            if r.w is None:
                codes.append(a)
                sums.append(_unpack(r.counts, "<i8").reshape(4, -1))
                continue
            w = unpack_codes(r.w)
            keys = pair_keys(a, w)
            order = np.argsort(keys)
            self.keys, self.counts = keys[order], _unpack(r.counts, "<i8")[order]
            self.words, before = np.unique(w[hashed(w)], return_counts=True)
            self.single = model.lower_order(before)
        self.contexts, first = np.unique(np.concatenate(codes), return_index=True)
        stats = np.concatenate(sums, axis=1)[:, first]
        self.total, self.back = stats[0], model.backing(stats)

    def shares(self, a: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What bigrams add to a text beyond what is known where it is read."""
        m, rare_a, rare_w = self.model, hashed(a), hashed(w)
        total, back, single = np.zeros(len(a)), np.ones(len(a)), np.full(len(a), m.uniform)
        at = a[~rare_a].astype(np.int64)
        total[~rare_a], back[~rare_a] = m.total[at], m.back[at]
        total[rare_a], back[rare_a] = _find(self.contexts, self.total, a[rare_a], 0), _find(self.contexts, self.back, a[rare_a], 1.0)
        single[~rare_w] = m.single[w[~rare_w].astype(np.int64)]
        single[rare_w] = _find(self.words, self.single, w[rare_w], m.uniform)
        out = m.gain(_find(self.keys, self.counts, pair_keys(a, w), 0), total, back, single)
        out[rare_w] += np.log(single[rare_w] / m.uniform)
        context = rare_a & ~rare_w
        out[context] += np.log(back[context])
        return out


def score(docs: DataFrame, words: list[str], model: BigramModel, table: DataFrame, shards: int) -> DataFrame:
    """(doc_id, lang, held, n_tokens, log_probability) for ``docs`` (doc_id, lang, text, held)."""
    index = {w: i for i, w in enumerate(words, FIRST)}

    def encode(batches):
        part, made = TaskContext.get().partitionId(), 0
        rows, codes, n = [], [], 0
        log_single, log_back, log_uniform = np.log(model.single), np.log(model.back), np.log(model.uniform)

        def flush():
            nonlocal made
            chunk = (part << 32) | made
            made += 1
            sizes = [len(k) - 1 for k in codes]
            at = np.repeat(np.arange(len(rows)), sizes)
            a, w = np.concatenate([k[:-1] for k in codes]), np.concatenate([k[1:] for k in codes])
            rare_a, rare_w = hashed(a), hashed(w)
            known = np.where(rare_w, log_uniform, log_single[np.where(rare_w, 0, w).astype(np.int64)])
            known += np.where(rare_a, 0.0, log_back[np.where(rare_a, 0, a).astype(np.int64)])
            both = ~rare_a & ~rare_w
            gain = np.zeros(len(a))
            gain[both] = _find(model.frequent_keys, model.frequent_gains, (a[both] << np.uint64(32)) | w[both], np.nan)
            hot = ~np.isnan(gain) & both
            local = np.bincount(at, known + np.where(hot, gain, 0.0), len(rows))
            # A context without a short code before such a word is known in another shard than their bigram.
            apart = rare_a & rare_w
            a, w, at = np.concatenate([a[~hot], a[apart]]), np.concatenate([w[~hot], np.full(apart.sum(), NOTHING, dtype=np.uint64)]), np.concatenate([at[~hot], at[apart]])
            where = shard_of(a, w, shards)
            by_shard = np.argsort(where, kind="stable")
            columns = ["shard", "chunk", "size", "a", "w", "times", "docs", "ids", "langs", "n", "held", "local"]
            blank = dict.fromkeys(columns)
            out = [
                blank
                | {
                    "shard": chunk % shards,
                    "chunk": chunk,
                    "ids": [r[0] for r in rows],
                    "langs": [r[1] for r in rows],
                    "n": sizes,
                    "held": [r[2] for r in rows],
                    "local": local.tolist(),
                }
            ]
            edges = np.flatnonzero(np.diff(where[by_shard])) + 1
            for rows_of in np.split(by_shard, edges):
                if len(rows_of):
                    own_a, own_w, own_at = a[rows_of], w[rows_of], at[rows_of]
                    order = np.lexsort((own_at, own_w, own_a))
                    own_a, own_w = own_a[order], own_w[order]
                    first = _runs(own_a, own_w)
                    times = np.diff(first, append=len(order))
                    own = {"a": pack_codes(own_a[first], True), "w": pack_codes(own_w[first]), "times": _pack(times, "<u4"), "docs": pack_places(own_at[order], times)}
                    out.append(blank | own | {"shard": int(where[rows_of[0]]), "chunk": chunk, "size": len(rows)})
            return pd.DataFrame(out, columns=columns).astype({"size": "Int32"})

        for batch in batches:
            for doc, lang, text, held in zip(batch["doc_id"], batch["lang"], batch["text"], batch["held"], strict=True):
                k = word_codes(text, index)
                rows.append((None if pd.isna(doc) else int(doc), lang, bool(held)))
                codes.append(k)
                n += len(k)
                if len(rows) >= CHUNK_DOCS or n >= CHUNK_TOKENS:
                    yield flush()
                    rows, codes, n = [], [], 0
        if rows:
            yield flush()

    def meet(blocks: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        out, shard = [], None
        for r in blocks.itertuples(index=False):
            row = {"chunk": r.chunk, "shard": r.shard, "sums": None, "ids": r.ids, "langs": r.langs, "n": r.n, "held": r.held, "local": r.local}
            if r.a is not None:
                shard = shard or Shard(model, counted)
                times = _unpack(r.times, "<u4")
                shares = np.repeat(shard.shares(unpack_codes(r.a, True), unpack_codes(r.w)), times)
                row["sums"] = np.bincount(unpack_places(r.docs, times), shares, int(r.size)).astype("<f4").tobytes()
            out.append(row)
        return pd.DataFrame(out, columns=["chunk", "shard", "sums", "ids", "langs", "n", "held", "local"])

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["ids"].notna()].iloc[0]
        total = np.array(head["local"], dtype=float)
        for blob in group[group["sums"].notna()].sort_values("shard")["sums"]:
            total += np.frombuffer(blob, dtype="<f4")
        out = pd.DataFrame({"doc_id": pd.array(list(head["ids"]), dtype="Int64"), "lang": list(head["langs"]), "held": list(head["held"]), "n_tokens": list(head["n"])})
        return out.assign(log_probability=total)

    blocks = docs.select("doc_id", "lang", "text", "held").mapInPandas(
        encode, f"shard int, chunk bigint, size int, a binary, w binary, times binary, docs binary, {_HEAD}"
    )
    met = blocks.groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(meet, f"chunk bigint, shard int, sums binary, {_HEAD}")
    return met.groupBy("chunk").applyInPandas(combine, "doc_id bigint, lang string, held boolean, n_tokens int, log_probability double")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(_lang, threshold): the quantile of log-perplexity over held-out trusted documents, to a bin.

    A language's own quantile and that of all languages are averaged, weighted
    by its held-out documents and by LEAST_HELD: a language that has few or
    none is measured by the others. Where nothing is held out at all, the
    quantile of all documents serves. A null language is ''.
    """
    bins = cut(
        scored.groupBy(F.coalesce("lang", F.lit("")).alias("_lang"), F.ceil(F.col("log_perplexity") * BINS).alias("bin")).agg(
            F.count("*").alias("all"), F.sum(F.col("held").cast("int")).alias("held")
        )
    )

    def reached(rows: DataFrame, use: str, by: list[str]) -> DataFrame:
        whole = Window.partitionBy(*by)
        share = rows.withColumn("share", F.sum(use).over(whole.orderBy("bin")) / F.sum(use).over(whole))
        return share.filter(F.col("share") >= quantile).groupBy(*by).agg(F.min("bin").alias("own"))

    totals = bins.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held")).first()
    # No more rows than bins, whatever the input.
    together = bins.groupBy("bin").agg(F.sum("all").alias("all"), F.sum("held").alias("held"))
    everyone = reached(together, "held" if totals["held"] else "all", []).first()["own"]
    own = reached(bins.filter("held > 0"), "held", ["_lang"])
    held = bins.groupBy("_lang").agg(F.sum("held").alias("held"))
    common = F.lit(float(everyone or 0))
    blended = (F.coalesce("own", common) * F.col("held") + common * LEAST_HELD) / (F.col("held") + LEAST_HELD)
    return held.join(own, "_lang", "left").select("_lang", (blended / BINS).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, keep), one row per document.

    n_tokens counts the end of the text, so a null or empty text has one token
    and is scored by how likely a text ends at once. Without trusted text all
    words are equally likely. Null languages are a language of their own.
    Repeated rows are told again; an empty table gives no rows. Other columns
    are ignored.
    """
    flagged = trusted_flags(docs, labels)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, size // SHARD_BYTES)
    held = F.col("trusted") & F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    used = F.col("trusted") & ~held
    # A part of the documents is asked, as it only says which words have short codes.
    asked = flagged.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % ASKED == 0)
    words, model, table = train(flagged.filter(used), asked, shards)
    scored = cut(
        score(flagged.withColumn("held", held), words, model, table, shards).withColumn("log_perplexity", -F.col("log_probability") / F.col("n_tokens"))
    )
    limits = broadcast_if_small(thresholds(scored, quantile), 64)
    return scored.join(limits, F.coalesce("lang", F.lit("")) == F.col("_lang")).select(
        "doc_id", "lang", "n_tokens", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), (F.col("log_perplexity") <= F.col("threshold")).alias("keep")
    )
