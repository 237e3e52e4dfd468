"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that share a key meet in a block. A block keeps its fingerprints
as bit planes: word j holds bit j of 64 fingerprints. A query is compared with
64 fingerprints at once: each plane, inverted where the query's bit is set,
is added to vertical counters by a carry-save step, and a block whose lanes
have all passed the radius is abandoned.

Keys come in two kinds. For a small radius they are exact: 64 bits are cut in
radius + m parts, of which any two fingerprints within the radius share m, so
every choice of m parts is a key. m grows with the number of fingerprints, so
that blocks stay small; the links found are the same for every m. For wide
fingerprints, where similar texts differ in many bits, keys are samples of
bit positions, and similar texts share one of them with high probability;
there the distances only propose pairs, and shared shingles are counted.
"""

from __future__ import annotations

import math
import sys
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import broadcast_if_small, components, cut, free_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 4
SEED = 42
#: Bytes that separate words.
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_TO_SPACE = bytes(0x20 if c in _SPACES else c for c in range(256))
#: Fingerprints per key that a plan of keys aims at.
BLOCK_GOAL = 128
#: (query, block) pairs compared at a time in a task.
LANES = 1 << 14
#: Pairs that a task holds before it folds them; shingles that it indexes at a time.
PAIRS = 1 << 18
SLAB = 1 << 21
#: Rows with their shingles that a task compares, beyond those of a single key.
ROWS_COMPARED = 20_000
#: Groups with more rows are searched component by component.
HOT = 2048

#: Near-duplicate stages: five-word shingles, a wide fingerprint, similarity 0.8.
WIDE_SHINGLE = 5
WIDE_WORDS = 4
SIMILARITY = 0.8
#: Standard deviations by which the radius of candidates exceeds the bits expected at the wanted similarity.
DEVIATIONS = 3.0
#: Candidates of a row under one key up to which they are paired; fuller keys compare their rows' shingles within a task.
NEAREST = 4
#: Share of pairs at exactly the wanted similarity that meet under some key.
RECALL = 0.98
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle of the text in lower case (A-Z only), repeats included.

    A text with fewer words is one shingle; one without words has none.
    """
    raw = text.encode("utf-8", "replace").translate(_LOWER).translate(_TO_SPACE)
    words = raw.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    starts = [0] + [e + 1 for e in ends[: n - size]]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash derived from ``h``."""
    if not k:
        return h
    x = (h ^ _ODD[k]) * _ODD[0]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    return x


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """``keep`` columns and w0..w{words-1}: the 64-bit words of the fingerprint as signed bigints.

    A repeated shingle counts as often as it occurs, or once if ``distinct``.
    """

    def run(batches):
        for batch in batches:
            out = np.zeros((words, len(batch)), dtype=np.uint64)
            for i, text in enumerate(batch.pop("_text")):
                h = shingle_hashes(text, shingle)
                if distinct:
                    h = np.unique(h)
                for k in range(words):
                    out[k, i] = majority(_mix(h, k))
            yield batch.assign(**{f"w{k}": out[k].view(np.int64) for k in range(words)})

    given = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text"] + [f"w{k} bigint" for k in range(words)])
    return given.mapInPandas(run, schema)


def exact_keys(fps: DataFrame, radius: int, count: int) -> DataFrame:
    """(table, key, w0): fingerprints of 64 bits under every key of an exact plan."""
    parts = radius + 1
    while True:
        share = parts - radius
        bits = 64 * share // parts
        if count / 2**bits <= BLOCK_GOAL or share >= 4:
            break
        parts += 1
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(parts), share)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(t).alias("table"), F.col("w0").bitwiseAND(F.lit(mask).cast("bigint")).alias("key")))
    return fps.select(F.explode(F.array(*keys)).alias("k"), "w0").select("k.table", "k.key", "w0")


def sampled_plan(count: int, similarity: float) -> tuple[int, int]:
    """(bits per key, keys): blocks stay near the goal, and similar pairs meet with the wanted probability."""
    bits = max(8, math.ceil(math.log2(max(2, count) / BLOCK_GOAL)))
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def sampled_keys(fps: DataFrame, words: int, bits: int, tables: int, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """(table, key, w0.., ``keep``): wide fingerprints under keys of sampled bit positions."""
    rng = np.random.default_rng(seed)
    keys = []
    for t in range(tables):
        chosen = rng.choice(64 * words, bits, replace=False)
        masks = [sum(1 << int(c % 64) for c in chosen if c // 64 == k) for k in range(words)]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        key = F.xxhash64(*[F.col(f"w{k}").bitwiseAND(F.lit(m).cast("bigint")) for k, m in enumerate(signed)])
        keys.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    rest = [f"w{k}" for k in range(words)] + (keep or [])
    return fps.select(F.explode(F.array(*keys)).alias("k"), *rest).select("k.table", "k.key", *rest)


def bit_planes(words: np.ndarray) -> np.ndarray:
    """(blocks, 64 * k) planes of ``words`` (blocks * 64, k): word [b, j] has bit j of the 64 fingerprints of block b."""
    n, k = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(bits.reshape(n // 64, 64, 64 * k).transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(n // 64, 64 * k)


def within(planes: np.ndarray, valid: np.ndarray, blocks: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, lanes): of the pairs (query row, block), those with a lane within ``radius``, and the lanes as a bit set.

    The counters of 64 lanes are vertical: bit i of counter word c is bit c of
    lane i's distance so far. Distances past the radius stick in ``over``.
    """
    depth = radius.bit_length()
    alive = np.arange(len(blocks))
    counters = [np.zeros(len(blocks), dtype=np.uint64) for _ in range(depth)]
    over = ~valid[blocks]
    bits = planes.shape[1]
    step = 8
    for first in range(0, bits, step):
        rows, at = queries[alive], blocks[alive]
        for j in range(first, first + step):
            ask = (rows[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
            carry = planes[at, j] ^ (np.uint64(0) - ask)
            for c in range(depth):
                both = counters[c] & carry
                counters[c] ^= carry
                carry = both
            over |= carry
        # Lanes whose counter exceeds the radius, compared from the highest bit.
        above, equal = np.zeros_like(over), ~np.zeros_like(over)
        for c in reversed(range(depth)):
            if radius >> c & 1:
                equal &= counters[c]
            else:
                above |= equal & counters[c]
                equal &= ~counters[c]
        over |= above
        stay = over != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not stay.all():
            alive, over = alive[stay], over[stay]
            counters = [c[stay] for c in counters]
        if not len(alive):
            break
    return alive, ~over


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) among n nodes: (node, root) with root the smallest node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def hits(group: np.ndarray, run: np.ndarray, pure: np.ndarray, words: np.ndarray, radius: int, lanes: int = LANES):
    """Pairs of rows of one group within ``radius``, in batches of (row, row); ``group`` and ``run`` are sorted.

    A group is a row of runs. Rows of a ``pure`` run need no pairs among themselves, and only its later runs are met.
    """
    n, k = words.shape
    if not n:
        return
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
    sizes = np.diff(np.concatenate([cuts, [n]]))
    of_group = group[cuts]
    # Each run begins a new block, so that a block has rows of one run only.
    per = -(-sizes // 64)
    first_block = np.cumsum(per) - per
    where = np.repeat(first_block * 64 - cuts, sizes) + np.arange(n)
    row_of = np.full(int(per.sum()) * 64, -1, dtype=np.int64)
    row_of[where] = np.arange(n)
    slots = np.zeros((len(row_of), k), dtype=np.uint64)
    slots[where] = words
    planes = bit_planes(slots)
    valid = np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
    # A slot meets its own block, unless that is of a pure run, and the later blocks of its group.
    end = (first_block + per)[np.searchsorted(of_group, of_group, side="right") - 1]
    begin = np.where(np.repeat(pure, sizes), np.repeat(first_block + per, sizes), where // 64)
    todo = np.repeat(end, sizes) - begin
    alone = np.repeat((end - first_block == 1) & (sizes == 1), sizes)
    todo[alone] = 0
    asks = np.flatnonzero(todo)
    bounds = np.cumsum(todo[asks])
    done = 0
    while done < len(asks):
        base = bounds[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(bounds, base + lanes, side="right")))
        rows, t = asks[done:upto], todo[asks[done:upto]]
        q = np.repeat(rows, t)
        blocks = np.repeat(begin[rows], t) + (np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t))
        alive, lanes_in = within(planes, valid, blocks, words[q], radius)
        if len(alive):
            bits = np.unpackbits(lanes_in.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lane = np.nonzero(bits)
            a, b = q[alive[pair]], row_of[blocks[alive[pair]] * 64 + lane]
            yield a[b > a], b[b > a]
        done = upto


def connect(words: np.ndarray, radius: int, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect all rows of one large group within ``radius`` of each other.

    Each component is searched from one row on. A row that is reached leaves
    the pool of the rows still asked for, so the work is rows times what is
    left of the pool: little in a group of near copies.
    """
    n, k = words.shape
    slots = np.zeros((-(-n // 64) * 64, k), dtype=np.uint64)
    slots[:n] = words
    planes = bit_planes(slots)
    left = np.arange(len(slots)) < n
    from_, to = [], []
    seed, reached = 0, []
    while True:
        if not reached:
            ahead = np.flatnonzero(left[seed:])
            if not len(ahead):
                break
            seed += int(ahead[0])
            left[seed] = False
            reached = [np.array([seed])]
        valid = np.packbits(left.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
        open_ = np.flatnonzero(valid)
        if not len(open_):
            break
        rows = reached.pop()
        few = max(1, lanes // len(open_))
        if len(rows) > few:
            reached.append(rows[few:])
            rows = rows[:few]
        q, blocks = np.repeat(rows, len(open_)), np.tile(open_, len(rows))
        alive, lanes_in = within(planes, valid, blocks, words[q], radius)
        if len(alive):
            bits = np.unpackbits(lanes_in.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lane = np.nonzero(bits)
            found, first = np.unique(blocks[alive[pair]] * 64 + lane, return_index=True)
            left[found] = False
            from_.append(found)
            to.append(q[alive[pair]][first])
            reached.append(found)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *from_]), np.concatenate([none, *to])


def link_groups(group: np.ndarray, words: np.ndarray, radius: int, lanes: int = LANES, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect all rows of a group within ``radius`` of each other; ``group`` is sorted.

    Groups of more than ``hot`` rows are searched component by component.
    """
    n = len(group)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.concatenate([starts, [n]])).astype(np.int64)
    from_, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at, size in zip(starts[sizes > hot], sizes[sizes > hot], strict=True):
        a, b = connect(words[at : at + size], radius, lanes)
        from_.append(a + at)
        to.append(b + at)
    small = np.flatnonzero(np.repeat(sizes <= hot, sizes))
    held = 0
    from_s, to_s = [], []
    for a, b in hits(group[small], group[small], np.zeros((sizes <= hot).sum(), dtype=bool), words[small], radius, lanes):
        from_s.append(a)
        to_s.append(b)
        held += len(a)
        if held > PAIRS:  # dense groups: keep a forest only
            node, root = _forest(np.concatenate(from_s), np.concatenate(to_s), len(small))
            from_s, to_s, held = [node], [root], len(node)
    if from_s:
        node, root = _forest(np.concatenate(from_s), np.concatenate(to_s), len(small))
        from_.append(small[node])
        to.append(small[root])
    return np.concatenate(from_), np.concatenate(to)


def _distance(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)


def _nearest(a: np.ndarray, b: np.ndarray, dist: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs are among the ``limit`` nearest of either of their rows, ties to the smaller other row."""
    row, other, both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([dist, dist])
    order = np.lexsort((other, both, row))
    sorted_ = row[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
    near = np.zeros(len(order), dtype=bool)
    near[order] = rank < limit
    return near[: len(a)] | near[len(a) :]


def candidates(group: np.ndarray, label: np.ndarray, words: np.ndarray, radius: int, limit: int, lanes: int = LANES):
    """Pairs (row, row) within ``radius`` of different labels, the ``limit`` nearest of each row, and the groups with more.

    Rows are sorted by group and label. What is held at a time is bounded by the rows times ``limit``.
    """
    n = len(group)
    empty = np.zeros(0, dtype=np.int64)
    if not n:
        return empty, empty, empty
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (label[1:] != label[:-1])])
    count = np.bincount(np.cumsum(new) - 1)
    # Labels of many rows are runs of their own, the others of a group come last in one run.
    large = np.repeat(count >= 64, count)
    order = np.lexsort((np.arange(n), ~large, group))
    g, big = group[order], large[order]
    run = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (big[1:] != big[:-1]) | (big[1:] & new[order][1:])])) - 1
    pure = big[np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])]
    w, lab = words[order], label[order]
    a, b, more = empty, empty, empty
    from_, to = [], []

    def trim():
        nonlocal a, b, more, from_, to
        a, b = np.concatenate([a, *from_]), np.concatenate([b, *to])
        from_, to = [], []
        near = _nearest(a, b, _distance(w, a, b), limit)
        more = np.union1d(more, g[a[~near]])
        a, b = a[near], b[near]

    for x, y in hits(g, run, pure, w, radius, lanes):
        differ = lab[x] != lab[y]
        from_.append(x[differ])
        to.append(y[differ])
        if sum(map(len, from_)) > PAIRS:
            trim()
    trim()
    return order[a], order[b], more


def pairs_or_rows(group: np.ndarray, label: np.ndarray, words: np.ndarray, radius: int, limit: int, lanes: int = LANES):
    """Pairs (row, row) within ``radius`` of different labels, and the rows of the groups too full for pairs.

    Groups in which a row has more than ``limit`` candidates give no pairs but
    the rows that have any. Rows are sorted by group and label. What is held at
    a time is bounded by the rows times ``limit``.
    """
    n = len(group)
    empty = np.zeros(0, dtype=np.int64)
    if not n:
        return empty, empty, empty
    group = np.unique(group, return_inverse=True)[1]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (label[1:] != label[:-1])])
    count = np.bincount(np.cumsum(new) - 1)
    # Labels of many rows are runs of their own, the others of a group come last in one run.
    large = np.repeat(count >= 64, count)
    order = np.lexsort((np.arange(n), ~large, group))
    g, big = group[order], large[order]
    run = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (big[1:] != big[:-1]) | (big[1:] & new[order][1:])])) - 1
    pure = big[np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])]
    w, lab = words[order], label[order]
    a, b = empty, empty
    met, full = np.zeros(n, dtype=np.int64), np.zeros(int(g[-1]) + 1, dtype=bool)
    from_, to, held = [], [], 0

    def thin():
        nonlocal a, b, from_, to, held
        a, b = np.concatenate([a, *from_]), np.concatenate([b, *to])
        open_ = ~full[g[a]]
        a, b = a[open_], b[open_]
        from_, to, held = [], [], 0

    for x, y in hits(g, run, pure, w, radius, lanes):
        differ = lab[x] != lab[y]
        x, y = x[differ], y[differ]
        met += np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
        full[g[x[met[x] > limit]]] = True
        full[g[y[met[y] > limit]]] = True
        open_ = ~full[g[x]]
        from_.append(x[open_])
        to.append(y[open_])
        held += int(open_.sum())
        if held > PAIRS:
            thin()
    thin()
    return order[a], order[b], order[np.flatnonzero(full[g] & (met > 0))]


def alike(label: np.ndarray, sets: list[np.ndarray], similarity: float, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that join all labels which rows of the Jaccard ``similarity`` connect, counted exactly.

    A row meets all others at once through an index of the rows by shingle, made for some ``slab`` shingles at
    a time. Rows of the most frequent label need not ask, as the others meet them; links are fewer than labels.
    """
    label = np.unique(label, return_inverse=True)[1]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    askers = np.flatnonzero(label != np.bincount(label).argmax())
    ends = np.cumsum(size)
    from_, to, first = [], [], 0
    while first < len(sets):
        upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + slab, side="right")))
        values = np.concatenate(sets[first:upto])
        owner = np.repeat(np.arange(upto - first), size[first:upto])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for r in askers:
            low, high = np.searchsorted(values, sets[r], side="left"), np.searchsorted(values, sets[r], side="right")
            width = high - low
            at = np.repeat(high - np.cumsum(width), width) + np.arange(width.sum())
            common = np.bincount(owner[at], minlength=upto - first)
            near = common >= similarity * (size[r] + size[first:upto] - common) - 1e-9
            near = first + np.flatnonzero(near & (label[first:upto] != label[r]))
            if len(near):
                others, one = np.unique(label[near], return_index=True)
                from_.extend([r] * len(one))
                to.extend(near[one])
                label[np.isin(label, others)] = label[r]
        first = upto
    return np.array(from_, dtype=np.int64), np.array(to, dtype=np.int64)


def whole_groups(batches, by: list[str]):
    """Batches of sorted rows, regrouped so that no group of equal ``by`` is cut; each row is copied a few times at most."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[by].to_numpy()
        new = np.flatnonzero(np.concatenate([[last is not None and tuple(keys[0]) != last], (keys[1:] != keys[:-1]).any(axis=1)]))
        last = tuple(keys[-1])
        if len(new):
            yield from [pd.concat([*held, batch.iloc[: new[-1]]], ignore_index=True)] if held or new[-1] else []
            held, batch = [], batch.iloc[new[-1] :]
        held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_numbers(batch: pd.DataFrame) -> np.ndarray:
    t, key = batch["table"].to_numpy(), batch["key"].to_numpy()
    return np.cumsum(np.concatenate([[False], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))


def links(keyed: DataFrame, ids: list[str], radius: int, parts: int) -> DataFrame:
    """Distinct links among rows that share (table, key); ``ids`` are the fingerprint's words."""
    k = len(ids)

    def run(batches):
        for batch in whole_groups(batches, ["table", "key"]):
            w = batch[ids].to_numpy(dtype=np.int64)
            a, b = link_groups(_group_numbers(batch), w.view(np.uint64), radius)
            yield pd.DataFrame({**{f"a{i}": w[a, i] for i in range(k)}, **{f"b{i}": w[b, i] for i in range(k)}})

    schema = ", ".join([f"a{i} bigint" for i in range(k)] + [f"b{i} bigint" for i in range(k)])
    dealt = keyed.repartition(parts, "table", "key").sortWithinPartitions("table", "key")
    return dealt.mapInPandas(run, schema).distinct()


def _parts(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 2_000_000)


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    Documents whose 64-bit fingerprints differ in ``radius`` bits or fewer are
    linked; component_id is the smallest doc_id that a document reaches. A
    null or empty text has the fingerprint zero and is linked like any other.
    Null doc_ids keep their row and count for no component_id, unless a
    component has no other. Columns other than doc_id and text are ignored.
    """
    rows = cut(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"], shingle))
    nodes = cut(rows.groupBy("w0").agg(F.min("doc_id").alias("doc_id")))
    count = nodes.count()
    keyed = exact_keys(nodes, radius, count)
    found = links(keyed, ["w0"], radius, _parts(docs.sparkSession, 5 * count)).select(F.col("a0").alias("a"), F.col("b0").alias("b"))
    roots = components(found)
    joined = nodes.join(roots, nodes["w0"] == roots["node"], "left").select("w0", "doc_id", F.coalesce("root", "w0").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = joined.join(smallest, "root").select("w0", "component_id")
    return rows.join(by_print, "w0").select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def wide_radius(similarity: float = SIMILARITY, words: int = WIDE_WORDS, deviations: float = DEVIATIONS) -> int:
    """Differing bits to expect at a Jaccard ``similarity`` of shingles, plus some standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * words * share + deviations * math.sqrt(64 * words * share * (1 - share)))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle ``sets`` (node, shingles) have the Jaccard ``similarity``, counted exactly."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    common = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - common
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(common >= F.lit(similarity) * either - F.lit(1e-9)).select("a", "b")


def near_duplicate_roots(nodes: DataFrame, shingles_of, words: int = WIDE_WORDS, similarity: float = SIMILARITY, limit: int = NEAREST) -> DataFrame:
    """(node, root) for each of the ``nodes`` (node, w0..) that has a near-duplicate.

    ``shingles_of(names)`` gives (node, shingles) of the ``names`` (node).
    Bit slices find candidates, exact counts decide. First the rows of each
    key are linked by a forest at a small radius, of which every node checks
    one link; what that joins needs no more comparisons. Then the candidates
    of other components are checked: as pairs where no row has more than
    ``limit`` of them under the key, else by a task that has the shingles of
    the key's rows, so that the rows that move never grow with their square.
    """
    ids = [f"w{k}" for k in range(words)]
    count = nodes.count()
    bits, tables = sampled_plan(count, similarity)
    parts = _parts(nodes.sparkSession, tables * count)
    name = lambda side: F.xxhash64(*[f"{side}{k}" for k in range(words)])
    radius = wide_radius(similarity, words)
    forest = links(sampled_keys(nodes, words, bits, tables), ids, wide_radius(similarity, words, -DEVIATIONS), parts)
    ends = forest.select(F.greatest(name("a"), name("b")).alias("a"), F.least(name("a"), name("b")).alias("b"))
    tried = cut(ends.groupBy("a").agg(F.min("b").alias("b")))
    both = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    good = cut(similar(tried, shingles_of(both(tried)), similarity))

    def run(batches):
        for batch in whole_groups(batches, ["table", "key"]):
            w, node = batch[ids].to_numpy(dtype=np.int64).view(np.uint64), batch["node"].to_numpy()
            group = _group_numbers(batch)
            a, b, full = pairs_or_rows(group, batch["label"].to_numpy(), w, radius, limit)
            x, y = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
            yield pd.DataFrame(
                {
                    "table": np.concatenate([np.zeros(len(a), dtype=np.int32), batch["table"].to_numpy()[full]]),
                    "key": np.concatenate([np.zeros(len(a), dtype=np.int64), batch["key"].to_numpy()[full]]),
                    "a": np.concatenate([x, node[full]]),
                    "b": np.concatenate([y, node[full]]),
                }
            )

    def compare(batches):
        for batch in whole_groups(batches, ["table", "key"]):
            node, label, sets = batch["node"].to_numpy(), batch["label"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in batch["shingles"]]
            cuts = np.flatnonzero(np.diff(_group_numbers(batch))) + 1
            for rows in np.split(np.arange(len(batch)), cuts):
                a, b = alike(label[rows], [sets[i] for i in rows], similarity)
                yield pd.DataFrame({"a": node[rows[a]], "b": node[rows[b]]})

    labels_of = lambda df, roots: df.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    keyed = sampled_keys(labels_of(nodes, components(good)), words, bits, tables, keep=["node", "label"])
    dealt = keyed.repartition(parts, "table", "key").sortWithinPartitions("table", "key", "label", "node")
    found = cut(dealt.mapInPandas(run, "table int, key bigint, a bigint, b bigint"))
    pairs = cut(found.filter("a <> b").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    good = cut(good.union(similar(pairs, shingles_of(both(pairs)), similarity)))
    # A row with a = b names a node of a key with too many candidates for pairs.
    full = found.filter("a = b").select("table", "key", F.col("a").alias("node"))
    rows = full.count()
    if rows:
        held = labels_of(full, components(good)).join(shingles_of(full.select("node").distinct()), "node")
        held = held.repartition(max(parts, rows // ROWS_COMPARED), "table", "key").sortWithinPartitions("table", "key", "node")
        good = cut(good.union(held.select("table", "key", "node", "label", "shingles").mapInPandas(compare, "a bigint, b bigint")))
    return components(good)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, limit: int = NEAREST) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the smallest doc_id, then the smallest text.

    Near-duplicates share 80 % of their distinct five-word shingles, counted
    exactly for the candidates that fingerprints of 256 bits give. Texts
    without words are alike. Of repeated rows one stays; a null doc_id comes
    last.
    """
    words = WIDE_WORDS
    ids = [f"w{k}" for k in range(words)]
    crc_of = F.crc32(F.coalesce("text", F.lit("")))
    id_, crc = free_name(docs, "_keep_id"), free_name(docs, "_keep_crc")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (crc_of == F.col(crc))
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", crc_of.alias("_crc"))
    rows = cut(fingerprints(keys, ["doc_id", "_crc"], WIDE_SHINGLE, words, distinct=True).withColumn("node", F.xxhash64(*ids)))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_crc")).alias("k")
    nodes = cut(rows.groupBy("node", *ids).agg(smallest))

    def shingles_of(names: DataFrame) -> DataFrame:
        wanted = cut(nodes.join(names, "node", "left_semi").select(F.col("k.doc_id").alias(id_), F.col("k._crc").alias(crc), "node"))
        texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted, 48), same).select("node", "text")

        def run(batches):
            for batch in batches:
                sets = [np.unique(shingle_hashes(t, WIDE_SHINGLE)).view(np.int64) for t in batch["text"].fillna("")]
                yield pd.DataFrame({"node": batch["node"], "shingles": sets})

        return cut(texts.mapInPandas(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"]))

    roots = near_duplicate_roots(nodes.drop("k"), shingles_of, words, similarity, limit)
    grouped = nodes.select("node", "k").join(roots, "node", "left")
    first = grouped.groupBy(F.coalesce("root", "node").alias("_root")).agg(F.min("k").alias("k"))
    kept = cut(first.select(F.col("k.doc_id").alias(id_), F.col("k._crc").alias(crc)))
    out = docs.join(broadcast_if_small(kept, 48), same, "left_semi")
    # Only rows repeated with both key and text are still there more than once; texts are dealt out for them alone.
    again = rows.groupBy("doc_id", "_crc").count().filter("count > 1")
    if again.limit(1).count():
        out = out.withColumn(crc, crc_of).dropDuplicates(["doc_id", crc]).select(*docs.columns)
    return out
