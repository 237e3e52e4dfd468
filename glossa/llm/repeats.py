"""Repeated passages by longest-previous-factor arrays.

LPF[i] is the length of the longest string that starts at i and also starts
earlier. In suffix order the candidates are the nearest suffixes on either side
that lie earlier in the text (previous and next smaller positions); the
nearest later ones give the longest next factor in the same way.

One suffix array over all documents is out of reach, so the suffixes are dealt
out such that equal strings of ``LENGTH`` bytes meet. Every window of that
length has an anchor, its first least-hashed ``GRAM``-byte string. Windows with
the same anchor follow each other, and equal windows have equal anchors at the
same place. So

1. anchors are counted by hash; one that occurs once has no repeated window,
2. an anchor whose whole run of windows occurs twice needs no further look,
3. the rest, mostly the ends of repeated passages, are the suffixes whose
   order and factors are computed, all of one anchor in one task.

An anchor with so many different surroundings that a task should not hold them
has its windows dealt out one by one instead; equal ones meet in an aggregate.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
GRAM = 100
#: Bytes hashed at a time in a task; a longer text is hashed in parts that overlap.
BUFFER = 1 << 21
_PLACE = 24
#: Bits of the length of a run of windows.
_RUN = 7
#: Surroundings of one anchor that a task orders; suffixes ordered at a time.
MOST = 4096
SUFFIXES = 150_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def lpf(records: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): lengths of the longest factor of each record that also starts earlier, and later, by ``position``.

    ``records`` are the first bytes of the suffixes, one row each, so lengths end at their width.
    """
    n, width = records.shape
    order = np.argsort(np.ascontiguousarray(records).view(f"S{width}").ravel(), kind="stable")
    ranked = records[order]
    place = position[order]
    longest = []
    for p in (place, -place):
        lengths = np.zeros(n, dtype=np.int64)
        for near in (nearest_smaller(p), n - 1 - nearest_smaller(p[::-1])[::-1]):
            at = np.flatnonzero((near >= 0) & (near < n))
            for first in range(0, len(at), 1 << 15):
                some = at[first : first + (1 << 15)]
                differ = ranked[some] != ranked[near[some]]
                common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
                lengths[some] = np.maximum(lengths[some], common)
        out = np.empty(n, dtype=np.int64)
        out[order] = lengths
        longest.append(out)
    return longest[0], longest[1]


def nearest_smaller(p: np.ndarray) -> np.ndarray:
    """For each place the nearest one to the left with a smaller value, -1 if there is none.

    All places follow their pointers at once; everything between a place and
    its pointer is larger, so a pointer may be followed as far as it has come.
    """
    value = np.concatenate([p, [np.iinfo(np.int64).min]])  # place -1 is smaller than all
    near = np.arange(-1, len(p) - 1)
    open_ = np.flatnonzero(value[near] > p)
    while len(open_):
        near[open_] = near[near[open_]]
        open_ = open_[value[near[open_]] > p[open_]]
    return near


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, from running minima of blocks of ``w`` to the right and to the left."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


class Anchors:
    """Runs of windows that share an anchor, in texts that lie one after another in a buffer."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.reach = length, gram, length - gram + 1
        rng = np.random.default_rng(11)
        self.tables = [rng.integers(0, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]
        self.bases = [int(b) | 1 for b in rng.integers(1 << 60, 1 << 62, 2)]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(BUFFER + length)

    def _grow(self, n: int) -> None:
        def series(base: int) -> np.ndarray:
            x = np.full(n + 1, base, dtype=np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        self.powers = [(series(b), series(pow(b, -1, 1 << 64))) for b in self.bases]

    def _sums(self, data: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.tables[k][data] * self.powers[k][0][: len(data)], dtype=np.uint64)])

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first window, last window, anchor hash, hash of all bytes of the run and the anchor's place in it)."""
        n = len(data)
        if n < self.length:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        if n >= len(self.powers[0][0]):
            self._grow(n)
        sums, inverse = self._sums(data, 0), self.powers[0][1]
        grams = _mix((sums[self.gram :] - sums[: -self.gram]) * inverse[: n - self.gram + 1])
        low = np.uint64((1 << _PLACE) - 1)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), self.reach)
        anchor = (least & low).astype(np.int64)
        edge = np.zeros(len(anchor) + 1, dtype=np.int8)
        inside = np.diff(offsets) >= self.length  # texts that hold a window
        np.add.at(edge, offsets[:-1][inside], 1)
        np.add.at(edge, offsets[1:][inside] - self.length + 1, -1)
        valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
        change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
        first = np.flatnonzero(valid & change)
        end = np.concatenate([(valid & np.concatenate([change[1:] | ~valid[1:], [True]])).nonzero()[0]])
        at, stop = anchor[first], end + self.length
        bytes_ = self._sums(data, 1)
        whole = (bytes_[stop] - bytes_[first]) * self.powers[1][1][first]
        place = (at - first).astype(np.uint64) * np.uint64(_ODD[2]) + (end - first).astype(np.uint64) * np.uint64(_ODD[1])
        text = np.searchsorted(offsets, first, side="right") - 1
        return text, first, end, grams[at].view(np.int64), _mix(whole + _mix(place)).view(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD[0])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[1])
    return h ^ (h >> np.uint64(32))


def doc_key(doc_id: int | None, text: bytes) -> bytes:
    """A document's name, which sorts by doc_id, nulls last; rows with the same id and text share it."""
    number = b"\1" + bytes(8) if doc_id is None else b"\0" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")
    return number + xxhash.xxh64_digest(text)


def _documents(batch: pa.RecordBatch):
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
        yield doc_id, text.as_buffer().to_pybytes()


def _buffers(batch: pa.RecordBatch, length: int):
    """(keys, start of each part in its text, bytes, offsets) of about BUFFER bytes; parts of a text overlap by a window less one."""
    keys, starts, parts, size = [], [], [], 0
    for doc_id, text in _documents(batch):
        if len(text) < length:
            continue
        key = doc_key(doc_id, text)
        for first in range(0, max(1, len(text) - length + 1), BUFFER):
            part = text[first : first + BUFFER + length - 1]
            if parts and size + len(part) > BUFFER:
                yield _buffer(keys, starts, parts)
                keys, starts, parts, size = [], [], [], 0
            keys.append(key)
            starts.append(first)
            parts.append(part)
            size += len(part)
    if parts:
        yield _buffer(keys, starts, parts)


def _buffer(keys, starts, parts):
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return keys, np.array(starts, dtype=np.int64), np.frombuffer(b"".join(parts), dtype=np.uint8), offsets


def anchor_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h): anchors that occur more than once."""

    def run(batches):
        anchors = Anchors(length, gram)
        for batch in batches:
            for _, _, data, offsets in _buffers(batch, length):
                h, n = np.unique(anchors.runs(data, offsets)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return docs.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def anchor_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, doc, at): every run of windows; ``at`` is its first window and, in the low bits, the windows that follow."""

    def run(batches):
        anchors = Anchors(length, gram)
        for batch in batches:
            for keys, starts, data, offsets in _buffers(batch, length):
                text, first, last, h, c = anchors.runs(data, offsets)
                at = ((starts[text] + first - offsets[text]) << _RUN) + (last - first)
                doc = pa.array(keys, pa.binary()).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), doc, pa.array(at)], names=["h", "c", "doc", "at"])

    return docs.mapInArrow(run, "h bigint, c bigint, doc binary, at bigint")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, n_bytes, z): texts compressed, so that they move at a fraction of their size."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [(i, doc_key(i, t), len(t), press.compress(t)) for i, t in _documents(batch)]
            for first in range(0, len(rows), 2000):
                ids, keys, sizes, z = zip(*rows[first : first + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(z, pa.binary())], names=["doc_id", "doc", "n_bytes", "z"])

    return docs.mapInArrow(run, "doc_id bigint, doc binary, n_bytes bigint, z binary")


def surroundings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, c, n, k, doc, start, around): the bytes of each run in ``wanted`` (h, c, n, k, doc, at)."""

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                text = press.decompress(r.z)
                for x in r.runs:
                    first = x["at"] >> _RUN
                    out.append((x["h"], x["c"], x["n"], x["k"], r.doc, first, text[first : first + (x["at"] & ((1 << _RUN) - 1)) + length]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = ["h", "c", "n", "k", "doc", "start", "around"]
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "n", "k", "at")).alias("runs"))
    return texts.join(lists, "doc").select("doc", "z", "runs").mapInPandas(run, "h bigint, c bigint, n bigint, k bigint, doc binary, start bigint, around binary")


def _spans(doc: np.ndarray, at: np.ndarray, length: int) -> pd.DataFrame:
    """(doc, s, e) of windows that begin at ``at``, given in order: neighbours are joined."""
    if not len(at):
        return pd.DataFrame({"doc": [], "s": [], "e": []})
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return pd.DataFrame({"doc": doc[new], "s": at[new], "e": at[last] + length})


def factors(group: pd.DataFrame, length: int, keep_first: bool) -> pd.DataFrame:
    """Spans of the windows in ``group`` (rows of ``surroundings``) that start elsewhere in it too, or earlier if ``keep_first``."""
    data = np.frombuffer(b"".join(group["around"]), dtype=np.uint8)
    sizes = group["around"].map(len).to_numpy()
    windows = sizes - length + 1
    row = np.repeat(np.arange(len(group)), windows)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (np.cumsum(sizes) - sizes)[row] + inner
    records = np.lib.stride_tricks.sliding_window_view(data, length)[start]
    doc = pd.factorize(group["doc"], sort=True)[0][row]
    at = group["start"].to_numpy()[row] + inner
    order = np.lexsort((at, doc))
    position = np.empty(len(order), dtype=np.int64)
    position[order] = np.arange(len(order))
    previous, following = lpf(records, position)
    repeated = previous >= length
    if not keep_first:
        # Runs that occur more than once are taken out without this.
        repeated = (repeated | (following >= length)) & (group["n"].to_numpy()[row] == 1)
    names = group["doc"].to_numpy()
    hit = order[repeated[order]]
    return _spans(names[row[hit]], at[hit], length)


def ordered(around: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(doc, s, e): repeated windows of anchors whose surroundings one task can order."""

    def run(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            h = batch["h"].to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])  # the last group may go on in the next batch
            rest = batch.iloc[bounds[-1] :]
            yield from solved(batch, bounds)
        if rest is not None and len(rest):
            yield from solved(rest, np.array([0, len(rest)]))

    def solved(batch, bounds):
        done = np.concatenate([[0], np.cumsum(batch["around"].map(len).to_numpy() - length + 1)])[bounds]
        i = 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(done, done[i] + SUFFIXES, side="right")) - 1)
            # The same document twice gives the same surroundings twice.
            group = batch.iloc[bounds[i] : bounds[j]].drop_duplicates(["h", "c"])
            yield factors(group, length, keep_first)
            i = j

    spark = around.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return around.repartition(parts, "h").sortWithinPartitions("h", "c").mapInPandas(run, "doc binary, s bigint, e bigint")


def dealt(around: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(doc, s, e): repeated windows of anchors with too many surroundings, each window dealt out by itself."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                n = len(r.around) - length + 1
                digests = [hashlib.md5(r.around[i : i + length]).digest() for i in range(n)]
                yield pd.DataFrame({"w": digests, "doc": r.doc, "at": r.start + np.arange(n), "n": r.n})

    windows = cut(around.dropDuplicates(["h", "c"]).mapInPandas(run, "w binary, doc binary, at bigint, n bigint"))
    met = windows.groupBy("w").agg(F.sum("n").alias("total"), F.min(F.struct("doc", "at")).alias("first")).filter("total > 1")
    hit = windows.join(met, "w")
    hit = hit.filter(F.struct("doc", "at") != F.col("first")) if keep_first else hit.filter("n = 1")
    return hit.select("doc", F.col("at").alias("s"), (F.col("at") + length).alias("e"))


def repeated_spans(docs: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, most: int = MOST) -> DataFrame:
    """(doc, s, e): byte ranges made of repeated windows; ranges may overlap."""
    twice = cut(anchor_counts(docs, length, gram))
    runs = cut(anchor_runs(docs, length, gram).join(twice, "h"))
    classes = cut(runs.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first")))
    whole = runs.join(classes.filter("n > 1"), ["h", "c"])
    if keep_first:
        whole = whole.filter(F.struct("doc", "at") != F.col("first"))
    end = F.shiftright("at", _RUN) + F.col("at").bitwiseAND(F.lit((1 << _RUN) - 1).cast("bigint")) + length
    spans = whole.select("doc", F.shiftright("at", _RUN).alias("s"), end.alias("e"))
    mixed = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("rarest")).filter("k > 1" if keep_first else "k > 1 and rarest = 1")
    wanted = classes.join(mixed, "h").select("h", "c", "n", "k", "first.doc", "first.at")
    around = cut(surroundings(texts, wanted, length))
    hot = around.filter(F.col("k") > most)
    return spans.unionByName(ordered(around.filter(F.col("k") <= most), length, keep_first)).unionByName(dealt(hot, length, keep_first)).distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): documents without their repeated passages.

    Removed is every byte covered by a string of ``length`` bytes that also
    starts somewhere else, in the same document or another one, overlaps
    included, as the input has it; with ``keep_first`` only strings that start
    earlier too, by doc_id and place, so that first copies stay. ``kept`` are
    the remaining bytes, ``n_spans`` the removed runs. A null text is empty.
    Null doc_ids keep their rows and come last. Rows with the same doc_id and
    text count as so many documents, which ``keep_first`` treats alike. An
    empty table gives no rows. Other columns are ignored.
    """
    if not 0 < gram < length <= gram + (1 << _RUN):
        raise ValueError("gram must be below length, by no more than 128")
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = packed_texts(given)
    spans = repeated_spans(given, texts, length, gram, keep_first, most)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                text = press.decompress(r.z) if r.n_bytes else b""
                kept, at, n = [], 0, 0
                for s, e in merged(r.spans):
                    kept.append(text[at:s])
                    at, n = e, n + 1
                kept = b"".join([*kept, text[at:]])
                out.append((r.n_bytes - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            done = pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "kept"])
            yield pd.concat([batch[["doc_id", "n_bytes"]], done], axis=1)

    return texts.join(lists, "doc", "left").select("doc_id", "n_bytes", "z", "spans").mapInPandas(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )


def merged(spans) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    out: list[list[int]] = []
    for x in sorted((x["s"], x["e"]) for x in spans) if spans is not None else []:
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append([*x])
    return [(s, e) for s, e in out]
