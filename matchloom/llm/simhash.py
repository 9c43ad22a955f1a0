"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most 3 bits.  A pair that
close has at most one differing bit in its low or in its high 32 bits, so each
half is searched for radius 1.  The anchors of a half are the code words of
(Golay [23,12,7], covering radius 3) x (Hamming [7,4,3], radius 1) x (2 free
bits): a covering code.  Every fingerprint has one home anchor, the nearest,
and is replicated to the anchors that a neighbour within the threshold can have
as its home, i.e. those within covering radius plus threshold of it that one
flipped bit reaches: about ten of 262,144 per half.  Pairs are compared per
anchor between homes and visitors, in blocks.

Fingerprints, not documents, are compared: equal ones are one class, so copies
cost one row.  An anchor hotter than ``most`` rows is split by the four bytes
of the other half, one of which must agree (at most 3 bits differ there); a part that is
still hotter is cut into blocks by a hash, and every pair of blocks is a task of its own, so
no task holds more than two blocks of about ``most`` rows.  Each task answers with a spanning
forest of its links, never all pairs, and classes come from large-star/small-star
rounds over those forests.

Defined results: null text is empty, and texts without words have fingerprint
zero, linked like any other; repeated rows are one class (each row is
returned); rows with a null doc_id get a component too, its smallest id being
taken over the non-null ones; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stash as S
from . import vectext as V

SEED = 42
THRESHOLD = 3


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority of the XXH64 (seed 42) bits of all word shingles of the lower-cased text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        return int(xxhash.xxh64_intdigest(joined, SEED))
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(64, dtype=np.int64), len(found) - width + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        s, e = starts[at : min(n, at + (1 << 15))].tolist(), ends[at + width - 1 : min(n, at + (1 << 15)) + width - 1].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(s, e, strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py()) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])
        V.trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# ---- the covering code -------------------------------------------------------

_GOLAY = 0xAE3  # generator polynomial x^11+x^9+x^7+x^6+x^5+x+1
_tables: dict[str, np.ndarray] = {}


def _rest(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).copy()
    for i in range(22, 10, -1):
        x ^= np.where(x >> i & 1, _GOLAY << (i - 11), 0)
    return x


def tables() -> dict[str, np.ndarray]:
    """Coset leaders by syndrome: what to flip to reach the nearest code word."""
    if not _tables:
        leader = np.zeros(2048, dtype=np.uint32)
        masks = [0]
        bits = [1 << i for i in range(23)]
        masks += bits
        masks += [a | b for i, a in enumerate(bits) for b in bits[:i]]
        masks += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
        m = np.array(masks)
        leader[_rest(m)] = m  # the code is perfect: 2,048 masks, one per syndrome
        _tables["golay"] = leader
        parity = np.zeros((3, 7), dtype=np.int64)
        for i in range(7):
            for j in range(3):
                parity[j, i] = (i + 1) >> j & 1
        x = np.arange(128)
        syndrome = sum((((x[:, None] >> np.arange(7)) & 1) @ parity[j] & 1) << j for j in range(3))
        _tables["hamming"] = np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x).astype(np.uint32)
    return _tables


def golay_home(x: np.ndarray) -> np.ndarray:
    return x ^ tables()["golay"][_rest(x)]


def home(half: np.ndarray) -> np.ndarray:
    """Nearest anchor of 32-bit halves: bits 0-22 Golay, 23-29 Hamming, 30-31 free."""
    half = half.astype(np.uint32)
    g = golay_home(half & np.uint32((1 << 23) - 1)).astype(np.uint32)
    h = tables()["hamming"][half >> np.uint32(23) & np.uint32(127)]
    return g | h << np.uint32(23) | half & np.uint32(3 << 30)


def reached(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of all homes of neighbours within one bit, the own home included."""
    half = half.astype(np.uint32)
    n = len(half)
    grid = np.empty((33, n), dtype=np.uint32)
    grid[0] = home(half)
    for i in range(32):
        grid[i + 1] = home(half ^ np.uint32(1 << i))
    grid.sort(axis=0)
    new = np.ones_like(grid, dtype=bool)
    new[1:] = grid[1:] != grid[:-1]
    at = np.nonzero(new)
    return at[1], grid[at]


# ---- links -------------------------------------------------------------------


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp, visitor): cell is the half's bit above its anchor. A home row is also its own visitor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            allfp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(allfp), 1 << 14):
                fp = allfp[lo : lo + (1 << 14)]
                for side in (0, 1):
                    half = (fp >> np.uint64(32 * side)).astype(np.uint32)
                    at, anchor = reached(half)
                    cell = anchor.astype(np.int64) | side << 32
                    visitor = anchor != home(half)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[at].view(np.int64)), pa.array(visitor)], ["cell", "fp", "visitor"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long, visitor boolean")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(homes: np.ndarray, others: np.ndarray, block: int = 1024) -> np.ndarray:
    """Edges (a, b) that join exactly what the links between homes and others join."""
    nodes = np.unique(np.concatenate([homes, others]))
    parent = np.arange(len(nodes))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    hi, oi = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    edges = []
    for a in range(0, len(homes), block):
        for b in range(0, len(others), block):
            near = _popcount(homes[a : a + block, None] ^ others[None, b : b + block]) <= THRESHOLD
            i, j = np.nonzero(near)
            i, j = hi[a + i], oi[b + j]
            # a star around the first home a visitor meets joins most at once; only what still differs is walked
            root = parent.copy()
            while not (root[root] == root).all():
                root = root[root]
            parent[:] = root
            keep = root[i] != root[j]
            pairs = np.unique(np.stack([root[i[keep]], root[j[keep]]], axis=1), axis=0)
            for x, y in pairs.tolist():
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((min(x, y), max(x, y)))
    e = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return np.stack([nodes[e[:, 0]], nodes[e[:, 1]]], axis=1).view(np.int64) if len(e) else np.zeros((0, 2), np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, part, pair): answers with each group's forest; only one group is held at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    last = None

    def solve():
        fp = np.concatenate([x[0] for x in held])
        visitor = np.concatenate([x[1] for x in held])
        homes = fp[~visitor].view(np.uint64)
        if not len(homes) or len(fp) < 2:
            return None
        e = forest(homes, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"]) if len(e) else None

    for b in batches:
        if not b.num_rows:
            continue
        cell, part, duo, fp, visitor = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        cut = (np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(duo) != 0)) + 1).tolist()
        for i, j in zip([0, *cut], [*cut, len(cell)], strict=True):
            key = (cell[i], part[i], duo[i])
            if last is not None and key != last:
                if (out := solve()) is not None:
                    yield out
                held = []
            last = key
            held.append((fp[i:j], visitor[i:j]))
    if held and (out := solve()) is not None:
        yield out
    V.trim()


def links(fps: DataFrame, most: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to join all that link within 3 bits.

    Cells of more than ``most`` rows are split by the bytes of the other half: four parts per row,
    and a pair of the cell agrees in one byte at least. Parts of more than ``most`` rows are split
    into blocks; a row goes to every pair that its block is in.
    """
    cells = S.stash(_cells(fps), "cells")
    load = S.stash(cells.groupBy("cell").count().filter(F.col("count") > most).select(F.col("cell").alias("hot")), "hot")
    joined = cells.join(load, F.col("cell") == F.col("hot"), "left").select("cell", "fp", "visitor", F.col("hot").isNotNull().alias("hot"))
    other = F.when(F.shiftright("cell", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bytes_ = F.transform(F.array(*(F.lit(8 * i) for i in range(4))), lambda i: i * 32 + 1 + F.call_function("shiftright", other, i).bitwiseAND(F.lit(255)))
    single = joined.filter(~F.col("hot")).select("cell", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("duo"), "fp", "visitor")
    if load.isEmpty():
        rows = single
    else:
        parts = S.stash(joined.filter("hot").select("cell", F.explode(bytes_).alias("part"), "fp", "visitor"), "parts")
        crowd = parts.groupBy("cell", "part").count().filter(F.col("count") > most).select("cell", "part", F.ceil(F.col("count") / most).alias("blocks"))
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        duos = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda p: F.least(mine, p) * 65536 + F.greatest(mine, p))
        dealt = parts.join(crowd, ["cell", "part"], "left")
        small = dealt.filter("blocks IS NULL").select("cell", "part", F.lit(0).cast("long").alias("duo"), "fp", "visitor")
        rows = single.union(small).union(dealt.filter("blocks IS NOT NULL").select("cell", "part", F.explode(duos).alias("duo"), "fp", "visitor"))
    dealt = rows.repartition("cell", "part", "duo").sortWithinPartitions("cell", "part", "duo")
    found = S.stash(dealt.mapInArrow(_compare, "a long, b long").distinct(), "links")
    S.drop(load, cells)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, by alternating large-star and small-star rounds.

    The neighbours of a node are never gathered: its smallest neighbour is a
    partial aggregate, joined back to the edges. Rounds go on until nothing changes,
    of the order of the square of the logarithm of the longest chain.
    """
    now = S.stash(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        large = S.stash(large, "star")
        # small star: every node points at the least of its smaller neighbours
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        pairs = large.join(small, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        after = S.stash(pairs.union(small.select(F.col("m").alias("u"), "v")).filter("u <> v").distinct(), "star")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]
        S.drop(now, large)
        now = after
        if sign == before:
            break
        before = sign
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    seen = S.stash(fingerprints(docs), "fingerprints")
    fps = S.stash(seen.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fps")
    root = components(links(fps))
    named = fps.join(root, fps["fp"] == root["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    byfp = named.join(least, "root").select("fp", "component_id")
    return seen.join(byfp, "fp").select("doc_id", "fp", "component_id")
