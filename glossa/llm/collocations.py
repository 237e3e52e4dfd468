"""Phrase collocations from depth-truncated suffix subtrees, in the manner of ERA.

Every word is the start of a suffix, cut after three words or at the end of
its piece. Suffixes are partitioned vertically: those that begin with the same
word belong to one group, and groups are sized by a memory budget from the
counts of words. A first word with more suffixes than its share of the budget
is extended by the second word; as a pair is no more frequent than either word,
only a second word over the share too extends it to the whole suffix. Each group
builds its subtrees by itself: it sorts its suffixes, adds up equal ones to leaf
totals, and reads the counts of two-word nodes off the totals below them.

What a part of a task has for a group travels as one cell: its distinct words
once, and the suffixes as compressed columns of numbers.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Suffixes of a group, on average at most half of it; a first word with over an eighth of it is extended.
BUDGET = 1 << 21
DEPTH = 3
LEAST = 10
#: A phrase goes if a longer candidate around it has this many hundredths of its occurrences.
INSIDE = 50
BEST = 2000
SCALE = 1_000_000
#: Bits of a map of heavy first words, whatever their number; words that share a bit count together.
MAP_BITS = 1 << 20
#: Bytes of text counted at a time in a task, and rows of an Arrow batch that it gives.
TEXT_BYTES = 16 << 20
ROWS = 1 << 18
#: Three ids of fewer words than this fit 63 bits.
PACKED_WORDS = 1 << 21
_BREAK, _BLANK = 0x0A, 0x20
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(_BREAK if c in _BREAKS else _BLANK if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def tokens(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, id of each word, piece of each word) of cleaned ``text``: blanks and breaks are the only separators."""
    buf = np.frombuffer(text, dtype=np.uint8)
    sep = (buf == _BREAK) | (buf == _BLANK)
    edge = np.diff(np.concatenate([[True], sep, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(buf[~sep].tobytes())).dictionary_encode()
    breaks = np.flatnonzero(buf == _BREAK)
    return words.dictionary, words.indices.to_numpy(), np.searchsorted(breaks, starts)


def ranked_pairs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct a, distinct b, place of each pair, count): pairs of numbers below 2^31, of which those in b are below ``size``."""
    pairs, place, count = np.unique(a.astype(np.int64) * size + b, return_inverse=True, return_counts=True)
    return pairs // size, pairs % size, place, count


def suffix_counts(text: bytes) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """(distinct words, [w1, w2, w3], count): distinct suffixes of at most three words; a word that is not there is -1."""
    words, ids, piece = tokens(text)
    ids = ids.astype(np.int64)
    after = [ids]
    for k in range(1, DEPTH):
        w = np.full(len(ids), -1, dtype=np.int64)
        if len(ids) > k:
            w[:-k] = np.where(piece[:-k] == piece[k:], ids[k:], -1)
        after.append(w)
    size = len(words) + 1
    if size < PACKED_WORDS:
        leaf, count = np.unique((after[0] * size + after[1] + 1) * size + after[2] + 1, return_counts=True)
        return words, [leaf // size // size, leaf // size % size - 1, leaf % size - 1], count
    first, second, place, _ = ranked_pairs(after[0], after[1] + 1, size)
    pair, third, _, count = ranked_pairs(place, after[2] + 1, size)
    return words, [first[pair], second[pair] - 1, third - 1], count


def _texts(batch: pa.RecordBatch):
    """(lang, cleaned text) of bounded size, or of a single document; documents end a piece."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
        held.setdefault(lang, []).append(text.as_buffer().to_pybytes().translate(_CLEAN))
        size[lang] = size.get(lang, 0) + len(held[lang][-1])
        if size[lang] >= TEXT_BYTES:
            yield lang, b"\n".join(held.pop(lang))
            size[lang] = 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _rows(names: list[str], columns: list) -> list[pa.RecordBatch]:
    return pa.table(columns, names=names).to_batches(max_chunksize=ROWS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w1, n): occurrences of each word, added up within a task first."""

    def run(batches):
        for batch in batches:
            for lang, text in _texts(batch):
                words, ids, _ = tokens(text)
                if len(words):
                    n = np.bincount(ids, minlength=len(words))
                    yield from _rows(["lang", "w1", "n"], [pa.repeat(lang, len(words)), words, pa.array(n)])

    return docs.mapInArrow(run, "lang string, w1 string, n bigint").groupBy("lang", "w1").agg(F.sum("n").alias("n"))


def word_hash(lang: str, words: pa.Array) -> np.ndarray:
    """Spark's xxhash64(lang, word) of each word, unsigned."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all first bytes first, which compress better."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def make_cell(words: pa.Array, extended: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Suffixes as bytes: sizes, the differences of the first column, the other columns, the counts, the words that occur and their marks."""
    used, local = np.unique(np.concatenate(columns), return_inverse=True)
    first, *others = np.split(local.astype(np.int32), DEPTH)
    names = words.take(pa.array(used[used >= 0]))
    offsets = np.frombuffer(names.buffers()[1], dtype=np.int32)[names.offset : names.offset + len(names) + 1]
    letters = names.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(names) else b""
    head = np.array([len(n), len(names), int((used < 0).any())], dtype="<i4").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(
        b"".join([_planes(np.diff(first, prepend=0)), *map(_planes, others), _planes(n), _planes(np.diff(offsets)), extended[used[used >= 0]].tobytes(), letters])
    )


def read_cell(cell: bytes) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """(words, marks, columns, counts) of a cell; -1 is the word that is not there."""
    n, names, blank = np.frombuffer(cell[:12], dtype="<i4").tolist()
    data = zstandard.ZstdDecompressor().decompress(cell[12:])
    column = lambda at, size: np.ascontiguousarray(np.frombuffer(data[at : at + 4 * size], dtype=np.uint8).reshape(4, size).T).view("<i4").ravel().astype(np.int64)
    first, *rest = (column(4 * n * i, n) for i in range(DEPTH + 1))
    columns, counts = [np.cumsum(first), *rest[:-1]], rest[-1]
    at = 4 * n * (DEPTH + 1)
    offsets = np.concatenate([[0], np.cumsum(column(at, names))]).astype(np.int32)
    words = pa.StringArray.from_buffers(names, pa.py_buffer(offsets), pa.py_buffer(data[at + 5 * names :]))
    return words, np.frombuffer(data[at + 4 * names : at + 5 * names], dtype=bool), [c - blank for c in columns], counts


def suffix_cells(docs: DataFrame, groups: int, heavy: bytes) -> DataFrame:
    """(group, lang, cell): the suffixes of two words or more of a part of a task, dealt to their groups."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(heavy, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for lang, text in _texts(batch):
                words, columns, n = suffix_counts(text)
                keep = columns[1] >= 0
                columns, n = [c[keep] for c in columns], n[keep]
                code = np.concatenate([word_hash(lang, words), np.zeros(1, dtype=np.uint64)])  # the last one is for no word
                extended = bits[code[:-1] % np.uint64(MAP_BITS)]
                by_word = code[columns[0]]
                by_pair = _mix(by_word + code[columns[1]])
                by_suffix = _mix(by_pair + code[columns[2]])
                first, second = extended[columns[0]], extended[columns[1]]
                prefix = np.where(first, np.where(second, by_suffix, by_pair), _mix(by_word))
                group = (prefix % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]]) if len(order) else []
                ids, cells, size = [], [], 0
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    at = order[a:b]
                    ids.append(int(group[at[0]]))
                    cells.append(make_cell(words, extended, [c[at] for c in columns], n[at]))
                    size += len(cells[-1])
                    if size > 1 << 22:
                        yield from _rows(["group", "lang", "cell"], [pa.array(ids), pa.repeat(lang, len(ids)), pa.array(cells, pa.binary())])
                        ids, cells, size = [], [], 0
                if ids:
                    yield from _rows(["group", "lang", "cell"], [pa.array(ids), pa.repeat(lang, len(ids)), pa.array(cells, pa.binary())])

    return docs.mapInArrow(run, "group bigint, lang string, cell binary")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def heavy_map(words: DataFrame, most: int) -> bytes:
    """A bit per slot of xxhash64(lang, word): set where the words of the slot have over ``most`` occurrences. Always MAP_BITS bits."""
    slot = F.col("h").bitwiseAND(F.lit(MAP_BITS - 1).cast("bigint"))
    slots = words.select(F.xxhash64("lang", "w1").alias("h"), "n").groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    bits = np.zeros(MAP_BITS, dtype=bool)
    for r in slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect():
        bits[r["at"] * 64 : r["at"] * 64 + 64] = np.unpackbits(np.array([r["bits"]], dtype="<i8").view(np.uint8), bitorder="little")
    return np.packbits(bits, bitorder="little").tobytes()


def subtree(lang: np.ndarray, words: list[np.ndarray], n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The inner nodes and leaves of one group, as (row of the suffix that names it, count, words).

    The sorted suffixes are the leaves from left to right; a node is the run
    of suffixes that share its words, and its count the sum of theirs.
    """
    order = np.lexsort([*reversed(words), lang])
    changed = np.zeros(len(order), dtype=bool)
    changed[:1] = True
    levels = []
    for depth, key in enumerate([lang, *words]):
        k = key[order]
        changed = changed | np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        levels.append((depth, np.flatnonzero(changed)))
    totals = n[order]
    out = []
    for depth, starts in reversed(levels[2:]):  # leaf totals first, then the nodes above them
        present = words[depth - 1][order[starts]] >= 0
        counts = np.add.reduceat(totals, starts) if len(starts) else totals
        out.append((order[starts][present], counts[present], depth))
    return out


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, w1, w2, w3, f): phrases of two and three words that occur at least ``least`` times; w3 is empty for two.

    ``words`` are the counts of all words of ``docs``, written.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // budget))
    heavy = heavy_map(words, budget // 8)

    def build(table: pa.Table) -> pa.Table:
        read = [(lang, *read_cell(cell)) for lang, cell in zip(table["lang"].to_pylist(), table["cell"].to_pylist(), strict=True)]
        langs = sorted({r[0] for r in read})
        names = pa.concat_arrays([r[1] for r in read]).dictionary_encode()
        place, at = names.indices.to_numpy().astype(np.int64), 0
        columns, lang = [[] for _ in range(DEPTH)], []
        extended = np.zeros((len(names.dictionary), len(langs)), dtype=bool)
        for name, words, marks, cell, counts in read:
            code = langs.index(name)
            here = np.concatenate([place[at : at + len(words)], [-1]])
            at += len(words)
            extended[here[:-1][marks], code] = True
            for k, c in enumerate(cell):
                columns[k].append(here[c].astype(np.int32))
            lang.append(np.full(len(counts), code, dtype=np.int32))
        lang, columns, n = np.concatenate(lang), [np.concatenate(c) for c in columns], np.concatenate([r[4] for r in read])
        del read, place
        out = []
        for row, f, depth in subtree(lang, columns, n):
            stay = f >= least
            if depth < DEPTH:
                # The pairs of two extended words have suffixes in other groups too; all other nodes are whole here.
                stay |= extended[columns[0][row], lang[row]] & extended[columns[1][row], lang[row]]
            row, f = row[stay], f[stay]
            parts = [names.dictionary.take(pa.array(columns[k][row])) if k < depth else pa.repeat("", len(row)) for k in range(DEPTH)]
            lang_names = pa.array(langs, pa.string()).take(pa.array(lang[row]))
            out.append(pa.table({"lang": lang_names, "w1": parts[0], "w2": parts[1], "w3": parts[2], "f": pa.array(f)}))
        return pa.concat_tables(out)

    nodes = suffix_cells(docs, groups, heavy).groupBy("group").applyInArrow(build, "lang string, w1 string, w2 string, w3 string, f bigint")
    return nodes.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of 38 digits; counts may have 15."""
    wide = lambda c: c.cast("decimal(18,0)")
    square = (wide(a) * wide(a)).cast("decimal(31,0)")
    return F.call_function("div", square * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of two and three words.

    A null lang counts as ``und``, a null text as empty. a is the phrase's
    count, l and r those of its parts at the cut with the lowest score, n the
    language's words. Ties of the score fall to the higher a, then the phrase
    in byte order; of equal cuts the first counts. Phrases inside a longer
    candidate with half of their occurrences are left out. Repeated documents
    count as often as they occur. An empty table gives no rows. Columns other
    than text and lang are ignored.
    """
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = cut(word_counts(given))
    phrases = cut(phrase_counts(given, words, least, budget))
    two, three = phrases.filter("w3 = ''").drop("w3"), phrases.filter("w3 <> ''")
    # Words and pairs as the parts of a cut. A part has at least the count of the phrase, so rarer ones are not needed.
    frequent = words.filter(F.col("n") >= least)
    left_word = frequent.withColumnRenamed("n", "l")
    right = lambda name: frequent.select("lang", F.col("w1").alias(name), F.col("n").alias("r"))
    pairs = (
        two.join(left_word, ["lang", "w1"])
        .join(right("w2"), ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "w1", "w2", F.lit("").alias("w3"), F.col("f").alias("a"), F.array(F.struct("l", "r")).alias("cuts"))
    )
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("tail"))
    triples = (
        three.join(left_word, ["lang", "w1"])
        .join(right("w3"), ["lang", "w3"])
        .join(two.withColumnRenamed("f", "head"), ["lang", "w1", "w2"])
        .join(tail, ["lang", "w2", "w3"])
        .select(
            "lang",
            F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
            "w1",
            "w2",
            "w3",
            F.col("f").alias("a"),
            F.array(F.struct("l", F.col("tail").alias("r")), F.struct(F.col("head").alias("l"), "r")).alias("cuts"),
        )
    )
    around = (
        three.select("lang", "f", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
        .groupBy("lang", "p.w1", "p.w2")
        .agg(F.max("f").alias("longer"))
    )
    free = pairs.join(around, ["lang", "w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a"))).drop("longer")
    scored = free.unionByName(triples)
    lowest = F.array_min(F.transform("cuts", lambda c, k: F.struct(_score(F.col("a"), c["l"], c["r"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    chosen = scored.withColumn("low", lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
