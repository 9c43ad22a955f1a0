"""Exact ranks of very many numbers by radix selection: only counts leave the tasks.

A double becomes a 64-bit code of the same order. Pass 0 counts the codes' first 16 bits; from the counts, every asked rank learns
its first digit and its rank among the numbers that share it. The next passes count 16 bits more, of those numbers only whose
first bits an asked rank has. After four passes the code is the number. Counts are summed and read off by Spark; the driver
receives one row for each asked rank and pass, whatever the data look like.

The numbers come from a source: the similarities of all pairs of queries and references, which are multiplied again in each pass and
never kept, or a column. They may be in groups; a set is a union of groups, and its ranks are over all of them.

Pairs are too many for four passes of sorting. Their first digit is a bin of equal width between the bounds of all similarities; a
task adds up its counts in one array. Later passes look at the pairs in wanted bins only, which a table tells: they split bins into
parts of equal width, until few numbers share a part with an asked rank, and the last pass counts those numbers as they are.

Defined results: -0.0 counts as 0.0; nulls and non-finite numbers take no part; a rank out of range is an error; an empty set has no ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..plans.cut import cut, stored
from .kernel import per_group
from .search import Pairs, Refs

PASSES, DIGIT = 4, 16
_TOP = np.uint64(1 << 63)
COUNTS, VALUES, DIGITS = "slot int, digit int, n long", "slot int, value double, n long", "i long, digit int, rest long, held long"
AROUND = "g int, i int, below long, equal long, under double, over double"


def codes(x: np.ndarray) -> np.ndarray:
    """64-bit codes in the order of doubles."""
    u = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(u & _TOP, ~u, u | _TOP)


def numbers(code: np.ndarray) -> np.ndarray:
    """The doubles of codes."""
    c = np.asarray(code, np.uint64)
    return np.where(c & _TOP, c & ~_TOP, ~c).view(np.float64)


class Wanted:
    """What a pass counts: (group, first bits) pairs, as sorted keys; the place of a pair is its slot."""

    def __init__(self, step: int, group: np.ndarray, prefix: np.ndarray):
        self.step = step
        self.keys = np.unique((group.astype(np.uint64) << np.uint64(DIGIT * (PASSES - 1))) | prefix.astype(np.uint64))

    def slots(self, group: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where it is not wanted."""
        key = (group.astype(np.uint64) << np.uint64(DIGIT * (PASSES - 1))) | prefix.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def count(self, group: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        """Columns of COUNTS for numbers x of groups (those below 0 take no part)."""
        own = group >= 0
        code, group = codes(x[own]), group[own]
        shift = DIGIT * (PASSES - self.step)
        slot = self.slots(group, code >> np.uint64(shift) if self.step else np.zeros(len(code), np.uint64))
        hit = slot >= 0
        digit = (code[hit] >> np.uint64(shift - DIGIT)).astype(np.int64) & ((1 << DIGIT) - 1)
        key, n = np.unique((slot[hit].astype(np.int64) << DIGIT) | digit, return_counts=True)
        return [pa.array((key >> DIGIT).astype(np.int32)), pa.array((key & ((1 << DIGIT) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))]


def _near(group: np.ndarray, x: np.ndarray, levels: np.ndarray) -> list[pa.Array]:
    """Columns of AROUND: for each group, the numbers below and equal to each level, the largest below it and the smallest from it on."""
    rows = []
    for g in np.unique(group[group >= 0]).tolist():
        v = np.sort(x[group == g] + 0.0)
        lo, hi = np.searchsorted(v, levels, "left"), np.searchsorted(v, levels, "right")
        under = np.where(lo > 0, v[np.maximum(lo - 1, 0)], -np.inf)
        over = np.where(lo < len(v), v[np.minimum(lo, len(v) - 1)], np.inf)
        rows.append((np.full(len(levels), g), np.arange(len(levels)), lo, hi - lo, under, over))
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 6
    return [pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int64, np.int64, np.float64, np.float64), strict=True)]


#: Of a column: (kernel over (groups, numbers), its columns as DDL) -> the rows of all batches
Source = Callable[[Callable[[np.ndarray, np.ndarray], list[pa.Array]], str], DataFrame]


#: First bins of a group; the counters of all groups; bits that split a wanted bin; bits below a bin.
BIN_BITS, COUNTERS, SPLIT_BITS, FINE = 20, 1 << 22, 8, 32
#: A pass that counts numbers as they are may meet so many that share a part with an asked rank, and so many in all.
NODE_ROWS, LAST_ROWS = 1 << 20, 1 << 25
BUFFER, ROWS_OUT, VECTORS_OUT = 1 << 21, 1 << 16, 1 << 12


class Bins:
    """Bins of the similarities of pairs: a key is the place of the pair's group, then the bin; a code has FINE bits more. Both rise with the similarity."""

    def __init__(self, p: Pairs, by: Callable[[pa.RecordBatch, Refs], np.ndarray] | None, groups: np.ndarray):
        self.by, self.groups, self.wild, self.floor = by, groups, p.wild, p.floor
        self.bits = min(BIN_BITS, max(8, (COUNTERS // max(len(groups), 1)).bit_length() - 1))
        self.half = float(1 << (self.bits - 1))
        self.scale = (self.half - 1) / p.bound
        self.none = len(groups) << self.bits  # the key of pairs that take no part

    def place(self, s: np.ndarray) -> np.ndarray:
        """Where similarities lie, in widths of a bin from the lowest."""
        t = s * self.scale
        t += self.half
        return np.clip(np.nan_to_num(t, nan=0.0, posinf=np.inf, neginf=-np.inf), 0, 2 * self.half - 1) if self.wild else t

    def keys(self, s: np.ndarray, own: pa.RecordBatch, r: Refs) -> tuple[np.ndarray, np.ndarray]:
        t = self.place(s)
        key = t.astype(np.int64)
        if self.by is not None:
            g = self.by(own, r)
            at = np.minimum(np.searchsorted(self.groups, g), len(self.groups) - 1)
            live = self.groups[at] == g
            key += at << self.bits
            if not live.all():
                key = np.where(live, key, self.none)
        elif self.groups[0] != 0:  # without ``by`` all pairs are of group 0
            key[:] = self.none
        if self.wild:
            key[~np.isfinite(s)] = self.none
        return t, key


    def at(self, own: pa.RecordBatch, r: Refs) -> np.ndarray:
        """The place of each pair's group, -1 where it takes no part: a matrix, or a row for all queries."""
        g = self.by(own, r) if self.by is not None else np.zeros((1, len(r.z)), np.int64)
        at = np.minimum(np.searchsorted(self.groups, g), len(self.groups) - 1)
        return np.where(self.groups[at] == g, at, -1)

    def some(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``keys`` of single pairs, by the places of their groups."""
        t = self.place(s)
        return t, np.where(at >= 0, t.astype(np.int64) + (at << self.bits), self.none)


def _of(at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What a matrix, or a row for all queries, says of pairs (i, j)."""
    return at[0, j] if len(at) == 1 else at[i, j]


class _Histogram:
    """Counts the keys of a cell: COUNTS, a slot being the place of a group. Bin 0, which no similarity has, takes all below the floor."""

    def __init__(self, bins: Bins):
        self.bins, self.n, self.level = bins, np.zeros(bins.none + 1, np.int64), bins.floor
        self.buffer, self.fill, self.all = np.empty(BUFFER, np.int64), 0, np.zeros(len(bins.groups), np.int64)

    def _flush(self) -> None:
        self.n += np.bincount(self.buffer[: self.fill], minlength=len(self.n))
        self.fill = 0

    def add(self, s: np.ndarray, own: pa.RecordBatch, r: Refs) -> Iterator[list[pa.Array]]:
        if self.fill + s.size > BUFFER:
            self._flush()
        self.buffer[self.fill : self.fill + s.size] = self.bins.keys(s, own, r)[1].ravel()
        self.fill += s.size
        return iter(())

    def some(self, s: np.ndarray, i: np.ndarray, j: np.ndarray, rows: int, own: pa.RecordBatch, r: Refs) -> Iterator[list[pa.Array]]:
        if self.fill + len(s) > BUFFER:
            self._flush()
        at = self.bins.at(own, r)
        self.buffer[self.fill : self.fill + len(s)] = self.bins.some(s, _of(at, i, j))[1]
        self.fill += len(s)
        if rows:
            self.all += np.bincount(at.ravel() + 1, minlength=len(self.all) + 1)[1:] * (rows if len(at) == 1 else 1)
        return iter(())

    def end(self) -> Iterator[list[pa.Array]]:
        self._flush()
        if self.level is not None:
            n = self.n[:-1].reshape(len(self.all), -1)
            n[:, 0] += self.all - n.sum(axis=1)
        yield from _counts(self.n[:-1], self.bins.bits)


def _counts(n: np.ndarray, bits: int) -> Iterator[list[pa.Array]]:
    """Counters other than 0 as columns of COUNTS; the last ``bits`` of a counter's place are its digit."""
    at = np.flatnonzero(n)
    for lo in range(0, len(at), ROWS_OUT):
        x = at[lo : lo + ROWS_OUT]
        yield [pa.array((x >> bits).astype(np.int32)), pa.array((x & ((1 << bits) - 1)).astype(np.int32)), pa.array(n[x])]


class _Gate:
    """Lets the pairs through whose code begins with a wanted key of ``depth`` bits below the bin."""

    def __init__(self, bins: Bins, depth: int, wanted: np.ndarray):
        self.bins, self.depth, self.wanted, self.level = bins, depth, wanted, bins.floor
        self.open = np.zeros(bins.none + 1, bool)
        self.open[wanted >> depth] = True

    def hits(self, s: np.ndarray, own: pa.RecordBatch, r: Refs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(similarity, code, place of the wanted key) of each."""
        return self._through(s, *self.bins.keys(s, own, r))

    def some(self, s: np.ndarray, i: np.ndarray, j: np.ndarray, rows: int, own: pa.RecordBatch, r: Refs) -> Iterator[list[pa.Array]]:
        if not len(s):
            return iter(())
        return self.take(*self._through(s, *self.bins.some(s, _of(self.bins.at(own, r), i, j))))

    def add(self, s: np.ndarray, own: pa.RecordBatch, r: Refs) -> Iterator[list[pa.Array]]:
        return self.take(*self.hits(s, own, r))

    def _through(self, s: np.ndarray, t: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.open[key])
        t, x = t.ravel()[at], s.ravel()[at]
        code = (key.ravel()[at] << FINE) | ((t - np.floor(t)) * (1 << FINE)).astype(np.int64)
        head = code >> (FINE - self.depth)
        slot = np.minimum(np.searchsorted(self.wanted, head), len(self.wanted) - 1)
        hit = self.wanted[slot] == head
        return (x, code, slot) if hit.all() else (x[hit], code[hit], slot[hit])


class _Split(_Gate):
    """Counts the next ``bits`` of what is let through: (slot, v), a slot's counters in 32 or 64 bits each."""

    def __init__(self, bins: Bins, depth: int, wanted: np.ndarray, bits: int):
        super().__init__(bins, depth, wanted)
        self.bits, self.n = bits, np.zeros(len(wanted) << bits, np.int64)

    def take(self, x: np.ndarray, code: np.ndarray, slot: np.ndarray) -> Iterator[list[pa.Array]]:
        np.add.at(self.n, (slot << self.bits) | ((code >> (FINE - self.depth - self.bits)) & ((1 << self.bits) - 1)), 1)
        return iter(())

    def end(self) -> Iterator[list[pa.Array]]:
        n = self.n.reshape(len(self.wanted), -1)
        if int(self.n.max(initial=0)) < 1 << 32:
            n = n.astype("<u4")
        at = np.flatnonzero(n.any(axis=1))
        for lo in range(0, len(at), VECTORS_OUT):
            x = at[lo : lo + VECTORS_OUT]
            yield [pa.array(x.astype(np.int32)), pa.array([v.tobytes() for v in n[x]], pa.binary())]


class _Held(_Gate):
    """Hands on what is let through, about BUFFER numbers at a time, to ``out``."""

    def __init__(self, bins: Bins, depth: int, wanted: np.ndarray):
        super().__init__(bins, depth, wanted)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fill = 0

    def take(self, *got: np.ndarray) -> Iterator[list[pa.Array]]:
        if len(got[0]):
            self.held.append(got)
            self.fill += len(got[0])
        if self.fill > BUFFER:
            yield from self.end()

    def end(self) -> Iterator[list[pa.Array]]:
        if self.held:
            x, code, slot = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.held, self.fill = [], 0
            yield from self.out(x + 0.0, code, slot)


class _Values(_Held):
    """(slot, value, n): numbers as they are, equal ones together."""

    def out(self, x: np.ndarray, code: np.ndarray, slot: np.ndarray) -> Iterator[list[pa.Array]]:
        o = np.lexsort((x, slot))
        x, slot = x[o], slot[o]
        head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (slot[1:] != slot[:-1])]))
        n = np.diff(np.append(head, len(x)))
        for lo in range(0, len(head), ROWS_OUT):
            h = head[lo : lo + ROWS_OUT]
            yield [pa.array(slot[h].astype(np.int32)), pa.array(x[h]), pa.array(n[lo : lo + ROWS_OUT])]


class _Around(_Held):
    """AROUND of the numbers in wanted bins; ``below`` counts those in a level's own bin only."""

    def __init__(self, bins: Bins, wanted: np.ndarray, levels: np.ndarray):
        super().__init__(bins, 0, wanted)
        self.levels, self.own = levels, bins.place(levels).clip(0, 2 * bins.half - 1).astype(np.int64)

    def out(self, x: np.ndarray, code: np.ndarray, slot: np.ndarray) -> Iterator[list[pa.Array]]:
        at = code >> (FINE + self.bins.bits)
        for g in np.unique(at).tolist():
            v = np.sort(x[at == g])
            begin = np.searchsorted(self.bins.place(v).astype(np.int64), self.own, "left")
            lo, hi = np.searchsorted(v, self.levels, "left"), np.searchsorted(v, self.levels, "right")
            under = np.where(lo > 0, v[np.maximum(lo - 1, 0)], -np.inf)
            over = np.where(lo < len(v), v[np.minimum(lo, len(v) - 1)], np.inf)
            yield [pa.array(c.astype(t)) for c, t in zip((np.full(len(lo), self.bins.groups[g]), np.arange(len(lo)), np.maximum(lo - begin, 0), hi - lo, under, over), (np.int32, np.int32, np.int64, np.int64, np.float64, np.float64), strict=True)]


class _Above:
    """(s): the numbers above a level."""

    def __init__(self, above: float):
        self.above = above

    def add(self, s: np.ndarray, own: pa.RecordBatch, r: Refs) -> Iterator[list[pa.Array]]:
        x = s[(s > self.above) & (s < np.inf)]
        if len(x):
            yield [pa.array(x)]

    def end(self) -> Iterator[list[pa.Array]]:
        return iter(())


class _Top:
    """(s): the k largest numbers of a cell. With k at hand, only larger ones than the least of them are looked at."""

    def __init__(self, k: int):
        self.k, self.level, self.held, self.fill = k, -np.inf, [], 0

    def some(self, s: np.ndarray, i: np.ndarray, j: np.ndarray, rows: int, own: pa.RecordBatch, r: Refs) -> Iterator[list[pa.Array]]:
        self.held.append(s[np.isfinite(s)] + 0.0)
        self.fill += len(self.held[-1])
        if self.fill >= self.k and (self.level == -np.inf or self.fill > self.k + max(self.k, BUFFER) // 4):
            self._keep()
        return iter(())

    def _keep(self) -> None:
        x = np.concatenate(self.held)
        if len(x) >= self.k:
            x = np.partition(x, len(x) - self.k)[len(x) - self.k :]
            self.level = float(np.nextafter(x.min(), np.inf))
        self.held, self.fill = [x], len(x)

    def end(self) -> Iterator[list[pa.Array]]:
        if self.held:
            self._keep()
            for lo in range(0, self.fill, ROWS_OUT):
                yield [pa.array(self.held[0][lo : lo + ROWS_OUT])]


class PairSource:
    """The similarities of all pairs; ``by`` names a group of every pair by a small whole number (below 0: none), as a matrix or a row for all queries."""

    def __init__(self, queries: DataFrame, refs: DataFrame, keep: list[str] | None, by: Callable[[pa.RecordBatch, Refs], np.ndarray] | None, floor: float | None = None):
        self.pairs, self.by = Pairs(queries, refs, keep, floor), by


def pairs(queries: DataFrame, refs: DataFrame, keep: list[str] | None = None, by: Callable[[pa.RecordBatch, Refs], np.ndarray] | None = None, floor: float | None = None) -> PairSource:
    """All pairs' similarities; ``by`` names a group of every pair by a small whole number (below 0: none), as a matrix or a row for all queries.

    ``floor``: what lies below is counted, but looked at only if something asked for turns out to lie there; then all passes begin anew, over all pairs.
    """
    return PairSource(queries, refs, keep, by, floor)


def column(df: DataFrame, value: str, group: str | None = None) -> Source:
    """A column of numbers; ``group`` is a column of small whole numbers."""

    def source(count: Callable, names: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column(1).fill_null(np.nan), np.float64)
                yield pa.RecordBatch.from_arrays(count(np.where(np.isfinite(x), np.asarray(b.column(0), np.int64), -1), x), [c.split()[0] for c in names.split(", ")])

        own = F.coalesce(F.col(group).cast("long"), F.lit(-1)) if group else F.lit(0).cast("long")
        return df.select(own.alias("g"), F.col(value).cast("double").alias("v")).mapInArrow(run, names)

    return source


class Ranks:
    """Order statistics of the numbers of a source. sets: the groups of each set; without it, every group below ``groups`` is a set."""

    def __init__(self, source: Source | PairSource, sets: dict[int, list[int]] | None = None, groups: int = 1):
        self.source, self.sets = source, sets if sets is not None else {g: [g] for g in range(groups)}
        used = np.unique([g for x in self.sets.values() for g in x]).astype(np.int64)
        self.used = used
        self._count()

    def _count(self) -> None:
        """The first pass."""
        source, used = self.source, self.used
        self.bins = bins = Bins(source.pairs, source.by, used) if isinstance(source, PairSource) and len(used) else None
        self.first = Wanted(0, used, np.zeros(len(used)))
        first = None if not len(used) else source(self.first.count, COUNTS) if bins is None else source.pairs.gather(lambda: _Histogram(bins), COUNTS)
        self.counts = cut(first.groupBy("slot", "digit").agg(F.sum("n").alias("n"))) if len(used) else None
        held = {int(used[r["slot"]]): r["n"] for r in self.counts.groupBy("slot").agg(F.sum("n").alias("n")).collect()} if len(used) else {}  # a row a group
        self.group_n = held
        self.n = {k: sum(held.get(g, 0) for g in x) for k, x in self.sets.items()}

    def _whole(self) -> None:
        """Does without a floor from here on."""
        self.source.pairs.floor = None
        self._count()

    def _nodes(self, which: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the different pairs of set and prefix, the place there of each asked rank; of every set's group: place, and group)."""
        nodes, node = np.unique(np.stack([which.astype(np.uint64), prefix]), axis=1, return_inverse=True)
        members = [(i, g) for i, k in enumerate(nodes[0].tolist()) for g in self.sets[k]]
        return nodes, node, np.array([m[0] for m in members], np.int64), np.array([m[1] for m in members], np.int64)

    def _pick(self, counts: DataFrame, by: str, slot: np.ndarray, at: np.ndarray, nodes: int, node: np.ndarray, rest: np.ndarray, schema: str, bits: int = 0) -> DataFrame:
        """(i, by, rest, held) of each asked rank i: among the counts of its node's slots the one by that has its rest-th number, which holds ``held``. Counts are rows, or vectors of 2^bits counters."""
        of = F.broadcast(counts.sparkSession.createDataFrame(pa.table({"slot": pa.array(slot, pa.int32()), "node": pa.array(at, pa.int32())})))  # sets' groups x asked ranks at most
        order = np.lexsort((rest, node))
        begin = np.searchsorted(node[order], np.arange(nodes + 1))
        asked = rest[order]

        def read(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            k = int(x["node"][0])
            lo, hi = int(begin[k]), int(begin[k + 1])
            if "v" in x:
                n = np.zeros(1 << bits, np.int64)
                for v in x["v"]:
                    n += np.frombuffer(v, f"<u{len(v) >> bits}").astype(np.int64)
                digit = np.arange(len(n))
            else:
                o = np.argsort(x[by], kind="stable")
                digit, n = x[by][o], x["n"][o]
            up = np.cumsum(n)
            j = np.searchsorted(up, asked[lo:hi], "right")
            return {"i": order[lo:hi], by: digit[j], "rest": asked[lo:hi] - (up[j] - n[j]), "held": n[j]}

        met = counts.join(of, "slot")
        merged = met.select("node", "v") if "v" in counts.columns else met.groupBy("node", by).agg(F.sum("n").alias("n"))  # a bounded number of rows a node
        return per_group(merged, "node", read, schema)

    def _step(self, step: int, which: np.ndarray, prefix: np.ndarray, rest: np.ndarray) -> DataFrame:
        """(i, digit, rest, held) of each asked rank i, which is the rest-th number of set which[i] that begins with prefix[i]."""
        nodes, node, at, group = self._nodes(which, prefix)
        if step == 0:
            wanted, counts = self.first, self.counts
        else:
            wanted = Wanted(step, group, nodes[1][at])
            counts = self.source(wanted.count, COUNTS).groupBy("slot", "digit").agg(F.sum("n").alias("n"))
        return self._pick(counts, "digit", wanted.slots(group, nodes[1][at]), at, nodes.shape[1], node, rest, DIGITS)

    def _within(self, which: np.ndarray, prefix: np.ndarray, rest: np.ndarray, depth: int, bits: int | None) -> DataFrame:
        """_step over pairs whose codes begin with prefix[i], of ``depth`` bits below the bin: the next ``bits``, or without it (i, value, rest, held)."""
        nodes, node, at, group = self._nodes(which, prefix)
        bins, gather = self.bins, self.source.pairs.gather
        key = (np.searchsorted(self.used, group) << (bins.bits + depth)) | nodes[1][at].astype(np.int64)
        wanted = np.unique(key)
        if bits is None:
            counts = gather(lambda: _Values(bins, depth, wanted), VALUES).groupBy("slot", "value").agg(F.sum("n").alias("n"))
            return self._pick(counts, "value", np.searchsorted(wanted, key), at, nodes.shape[1], node, rest, "i long, value double, rest long, held long")
        counts = gather(lambda: _Split(bins, depth, wanted, bits), "slot int, v binary")
        return self._pick(counts, "digit", np.searchsorted(wanted, key), at, nodes.shape[1], node, rest, DIGITS, bits)

    def _frame_of_pairs(self, which: np.ndarray, rank: np.ndarray) -> DataFrame:
        """``frame`` over pairs: bins are split until few numbers share a part with an asked rank, or until that no longer parts them (equal ones)."""
        prefix, rest, depth, last, bits = np.zeros(len(rank), np.uint64), rank, 0, math.inf, self.bins.bits
        got = self._step(0, which, prefix, rest).toArrow()  # a row for each asked rank
        if self.bins.floor is not None and not got.column("digit").to_numpy().all():
            self._whole()
            return self._frame_of_pairs(which, rank)
        while True:
            i = got.column("i").to_numpy()
            held = np.zeros(len(rank), np.int64)
            prefix, rest = prefix.copy(), rest.copy()
            prefix[i] = (prefix[i] << np.uint64(bits)) | got.column("digit").to_numpy().astype(np.uint64)
            rest[i], held[i] = got.column("rest").to_numpy(), got.column("held").to_numpy()
            nodes, first = np.unique(np.stack([which.astype(np.uint64), prefix]), axis=1, return_index=True)
            total = int(held[first].sum())
            bits = min(SPLIT_BITS, max(1, (COUNTERS * 2 // len(first)).bit_length() - 1))
            if total <= LAST_ROWS and held.max() <= NODE_ROWS or depth + bits > FINE or total > last / 2:
                return self._within(which, prefix, rest, depth, None).select("i", "value")
            last = total
            got = self._within(which, prefix, rest, depth, bits).toArrow()
            depth += bits

    def frame(self, which: np.ndarray, rank: np.ndarray) -> DataFrame:
        """(i, value) of the asked ranks (0 for the smallest) of sets; a rank out of range is an error."""
        which, rank = np.asarray(which, np.int64), np.asarray(rank, np.int64)
        n = np.array([self.n[k] for k in which.tolist()], np.int64)
        if ((rank < 0) | (rank >= n)).any():
            raise ValueError("a rank is out of range")
        if self.bins is not None:
            return self._frame_of_pairs(which, rank)
        prefix, rest = np.zeros(len(rank), np.uint64), rank
        for step in range(PASSES - 1):
            got = self._step(step, which, prefix, rest).toArrow()  # a row for each asked rank
            i = got.column("i").to_numpy()
            prefix, rest = prefix.copy(), rest.copy()
            prefix[i] = (prefix[i] << np.uint64(DIGIT)) | got.column("digit").to_numpy().astype(np.uint64)
            rest[i] = got.column("rest").to_numpy()

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers((prefix[i] << np.uint64(DIGIT)) | b.column(1).to_numpy().astype(np.uint64)))], ["i", "value"])

        return self._step(PASSES - 1, which, prefix, rest).select("i", "digit").mapInArrow(whole, "i long, value double")

    def values(self, which: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """``frame`` on the driver: for a few asked ranks."""
        out = np.full(len(rank), np.nan)
        if len(rank):
            got = self.frame(which, rank).toArrow()
            out[got.column("i").to_numpy()] = got.column("value").to_numpy()
        return out

    def _places(self, which: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank below, rank above, share of the way) of quantiles."""
        last = np.array([self.n[k] - 1 for k in which.tolist()], np.int64)
        at = np.asarray(q, float) * last
        lo = np.clip(np.floor(at).astype(np.int64), 0, last)
        return lo, np.minimum(lo + 1, last), at - lo

    def quantiles(self, which: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Linearly interpolated quantiles of sets; none (nan) of an empty set."""
        which, q = np.asarray(which, np.int64), np.asarray(q, float)
        out, live = np.full(len(q), np.nan), np.array([self.n[k] > 0 for k in which.tolist()], bool)
        if live.any():
            lo, hi, way = self._places(which[live], q[live])
            v = self.values(np.concatenate([which[live]] * 2), np.concatenate([lo, hi]))
            a, b = v[: len(lo)], v[len(lo) :]
            out[live] = a + (b - a) * way
        return out

    def quantile_frame(self, q: np.ndarray, of: int = 0) -> DataFrame | None:
        """(i, value) of many quantiles of one set, without the driver; None for an empty set."""
        if not self.n[of]:
            return None
        lo, hi, way = self._places(np.full(len(q), of), q)
        ranks, place = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        found = self.frame(np.full(len(ranks), of), ranks)
        i = np.arange(len(q))
        ends = found.sparkSession.createDataFrame(pa.table({"i": np.concatenate([place[: len(q)], place[len(q) :]]), "q": np.concatenate([i, i]), "w": np.concatenate([1 - way, way]), "high": np.repeat([False, True], len(q))}))
        met = ends.join(found, "i").groupBy("q").agg(F.max(F.when(~F.col("high"), F.col("value"))).alias("a"), F.max(F.when(F.col("high"), F.col("value"))).alias("b"), F.max(F.when(F.col("high"), F.col("w"))).alias("w"))
        return met.select(F.col("q").alias("i"), (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"))

    def _around_of_pairs(self, levels: np.ndarray) -> DataFrame | None:
        """AROUND: the first counts tell what lies in bins below a level's own; that bin and its neighbours that hold numbers are gone through."""
        bins = self.bins
        if bins.floor is not None and (levels < bins.floor).any():
            self._whole()
            return self._around_of_pairs(levels)
        own = bins.place(levels).clip(0, 2 * bins.half - 1).astype(np.int64)

        def read(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            o = np.argsort(x["digit"])
            digit, up = x["digit"][o].astype(np.int64), np.cumsum(x["n"][o])
            lo, hi = np.searchsorted(digit, own, "left"), np.searchsorted(digit, own, "right")
            side = lambda at, here: np.where(here, digit[np.clip(at, 0, len(digit) - 1)], -1)
            return {"slot": np.full(len(own), x["slot"][0]), "i": np.arange(len(own)), "below": np.where(lo > 0, up[np.maximum(lo - 1, 0)], 0), "before": side(lo - 1, lo > 0), "after": side(hi, hi < len(digit))}

        found = per_group(self.counts, "slot", read, "slot int, i int, below long, before long, after long").toArrow()  # a row a group and level
        if not found.num_rows:
            return None
        slot, i, below, before, after = (found.column(c).to_numpy() for c in ("slot", "i", "below", "before", "after"))
        if bins.floor is not None:
            before = np.where(before == 0, -1, before)  # what lies below the floor is not gone through
        near = np.concatenate([(slot.astype(np.int64) << bins.bits) | b for b in (own[i], before, after)])
        wanted = np.unique(near[np.concatenate([np.ones(len(i), bool), before >= 0, after >= 0])])
        rows = self.source.pairs.gather(lambda: _Around(bins, wanted, levels), AROUND)
        base = pa.table({"g": self.used[slot].astype(np.int32), "i": i, "below": below, "equal": np.zeros(len(i), np.int64), "under": np.full(len(i), -np.inf), "over": np.full(len(i), np.inf)})
        return rows.union(rows.sparkSession.createDataFrame(base, AROUND))

    def around(self, levels: np.ndarray) -> dict[tuple[int, int], tuple[int, int, float, float]]:
        """{(set, i): (numbers below levels[i], equal to it, the largest below, the smallest from it on)}: one pass, a row a group and level."""
        levels = np.asarray(levels, float) + 0.0
        if self.bins is not None:
            rows = self._around_of_pairs(levels)
        else:
            rows = self.source(lambda group, x: _near(group, x, levels), AROUND)
        got = {(r["g"], r["i"]): r for r in rows.groupBy("g", "i").agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"), F.max("under").alias("under"), F.min("over").alias("over")).collect()} if rows is not None else {}
        out = {}
        for k, members in self.sets.items():
            for i in range(len(levels)):
                own = [got[g, i] for g in members if (g, i) in got]
                out[k, i] = (sum(r["below"] for r in own), sum(r["equal"] for r in own), max((r["under"] for r in own), default=-np.inf), min((r["over"] for r in own), default=np.inf))
        if self.bins is not None and self.bins.floor is not None and any(below and under == -np.inf for below, _, under, _ in out.values()):
            self._whole()  # the largest below a level lies below the floor
            return self.around(levels)
        return out


def quantiles_by(df: DataFrame, value: str, by: list[str], q: dict[str, float]) -> DataFrame:
    """(by, a column for each quantile named in q): linearly interpolated and exact, for few groups of any size; null for a group without numbers."""
    spark = df.sparkSession
    fields = df.select(*by).schema
    keys = [tuple(r) for r in df.select(*by).distinct().collect()] if by else [()]  # a row for each group
    if by:
        number = F.broadcast(spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], StructType([*(StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)), StructField("_g", LongType())])))
        on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
        df = df.join(number, on)
    ranks = Ranks(column(df, value, "_g" if by else None), groups=len(keys))
    found = ranks.quantiles(np.repeat(np.arange(len(keys)), len(q)), np.tile(list(q.values()), len(keys))).reshape(len(keys), len(q))
    rows = [(*k, *(None if np.isnan(x) else float(x) for x in v)) for k, v in zip(keys, found, strict=True)]
    return spark.createDataFrame(rows, StructType([*fields, *(StructField(n, DoubleType()) for n in q)]))


TOP_HELD = 1 << 22  # so many numbers a cell may hold for ``top``


def top(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """s: the k largest similarities of all pairs, as rows; all, if there are fewer. Up to TOP_HELD, each cell keeps its own k largest, in one pass over the pairs."""
    if k <= TOP_HELD:
        kept = stored(Pairs(queries, refs).gather(lambda: _Top(k), "s double"))
        r = Ranks(column(kept, "s"))
        if r.n[0] <= k:
            return kept
        level = float(r.values(np.array([0]), np.array([r.n[0] - k]))[0])
        above = kept.filter(F.col("s") > level)
        return above.union(queries.sparkSession.range(k - above.count()).select(F.lit(level).alias("s")))

    from .search import similarities

    r = Ranks(pairs(queries, refs))
    n = r.n[0]
    every = similarities(queries, refs, []).select("s") if n <= k else None
    if every is not None:
        return every
    level = float(r.values(np.array([0]), np.array([n - k]))[0])
    above = cut(r.source.pairs.gather(lambda: _Above(level), "s double"))  # fewer than k rows
    return above.union(queries.sparkSession.range(k - above.count()).select(F.lit(level).alias("s")))
