"""Collocation mining by hashed counting (PCY / DHP) with Apriori pruning.

Phrases are contiguous words within a piece of a text, counted for each language by itself.  Pass n reads all texts and

* counts phrases of n words exactly, but only those whose n - 1 first and n - 1 last words are frequent and whose
  bucket holds ``support`` or more (a bitmap of the buckets that pass n - 1 counted, and a bitmap of hashes of the frequent phrases, are broadcast;
  both have a fixed largest size);
* counts phrases of n + 1 words by bucket of their hash, but only those whose two parts of n words are still in question.

A hash that two phrases share can only let a phrase be counted that need not be: what is kept is decided by exact
counts of whole phrases, which tasks pre-aggregate slice by slice and one shuffle sums.  Pass 1 counts words.  Bucket counts of
a task are sent in blocks of 65,536 buckets, saturated at 255, and merged by block.  With many more occurrences than
``support`` x buckets every bucket is full: nothing is pruned by them then, and results stay the same.

A phrase of 2 words or more that is frequent enough is a candidate.  ``a`` is its count; a cut after k words has ``l`` and ``r``, the counts of
the two sides (frequent too, since they occur wherever the phrase does), and the score ``floor(unit * a / (l + r))``; the lowest-scoring cut counts, at ties the
first.  A candidate inside a longer candidate that has at least ``inside`` percent of its count is dropped.  It suffices to compare with candidates that are longer
by one word: any longer candidate contains one of those, with at least its own count.

Defined results: null texts are empty, a null language is ``und`` (and counts together with it); A-Z are lower-cased; repeated rows count; rows that differ
in other columns only are rows of their own; texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..plans.numbering import numbered
from . import stash as S
from . import vectext as V

SUPPORT, LONGEST, UNIT, INSIDE, FIRST = 30, 4, 2_000_000, 80, 2000
MOST_BUCKETS, MOST_FREQUENT = 24, 26  # powers of two
SLICE = 1 << 20  # bytes of text that are counted at once
BLOCK = 1 << 16
BROADCAST_ROWS = 200_000

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PLAIN = V._LOWER.copy()  # lower case, and all that stands between words as a space
_PLAIN[_CUT] = 0x20
_PLAIN[0x09] = 0x20


class Slice:
    """Words of some texts: which follow each other in a piece, and hashes of phrases with their language."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lang: np.ndarray):
        self.words = w = V.words(_PLAIN[raw], off)
        piece = np.cumsum(_CUT[raw], dtype=np.int64)[w.start] if w.n else np.zeros(0, np.int64)
        self.follows = (w.row[1:] == w.row[:-1]) & (piece[1:] == piece[:-1])
        self.lang = V.mix64(lang.astype(np.uint64) * V._MULT + np.uint64(1))[w.row] if w.n else np.zeros(0, np.uint64)

    def whole(self, n: int) -> np.ndarray:
        """Which phrases of n words, by first word, lie within one piece."""
        if self.words.n < n:
            return np.zeros(0, bool)
        out = np.ones(self.words.n - n + 1, bool)
        for i in range(n - 1):
            out &= self.follows[i : i + len(out)]
        return out

    def keys(self, n: int) -> np.ndarray:
        """Hashes of all phrases of n words with their language, by first word."""
        h = V.ngrams(self.words.hash, n)
        return V.mix64(h + self.lang[: len(h)])

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """(all words, a space after each; where each begins)."""
        w = self.words
        edge = np.concatenate([[0], np.cumsum(w.end - w.start + 1)]).astype(np.int64)
        out = np.full(int(edge[-1]), 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[edge[1:] - 1] = False
        solid = ~V._SPACE[w.data]
        out[keep] = w.data[solid]
        return out, edge

    def counted(self, at: np.ndarray, n: int, keys: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(rows they were seen in, phrases, counts) of the phrases of n words that begin at ``at``; lang numbers the rows' languages.

        Sorted by hash, cut where the words differ: phrases that share a hash may come in several parts, but never as one.
        """
        if not len(at):
            return at, pa.array([], pa.large_string()), at
        text, edge = self.packed()
        column = pa.Array.from_buffers(pa.large_binary(), self.words.n, [None, pa.py_buffer(edge), pa.py_buffer(text)])
        word = np.asarray(column.dictionary_encode().indices, np.int64)
        o = at[np.argsort(keys[at], kind="stable")]
        new = np.ones(len(o), bool)
        new[1:] = lang[self.words.row[o[1:]]] != lang[self.words.row[o[:-1]]]
        for i in range(n):
            new[1:] |= word[o[1:] + i] != word[o[:-1] + i]
        head = np.flatnonzero(new)
        first = o[head]
        size = edge[first + n] - edge[first] - 1
        to = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = text[np.repeat(edge[first] - to[:-1], size) + np.arange(to[-1])]
        phrases = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(to), pa.py_buffer(data)])
        return self.words.row[first], phrases, np.diff(np.append(head, len(o)))


# ---- bitmaps -------------------------------------------------------------------------

BLOCKS = "block int, sparse boolean, data binary"


class Counter:
    """Counts of 2 ** bits buckets in one task, in 16 bits each: those above ``MOST`` stay there."""

    MOST = 32_767

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(1 << bits, np.uint16)

    def add(self, keys: np.ndarray) -> None:
        for lo in range(0, len(keys), self.MOST):  # so many at once cannot pass 16 bits
            at = bucket(keys[lo : lo + self.MOST], self.bits)
            np.add.at(self.counts, at, np.uint16(1))
            self.counts[at[self.counts[at] > self.MOST]] = self.MOST

    def blocks(self) -> Iterator[tuple[int, bool, bytes]]:
        for i in range(0, len(self.counts), BLOCK):
            c = np.minimum(self.counts[i : i + BLOCK], 255).astype(np.uint8)
            at = np.flatnonzero(c)
            if 3 * len(at) < len(c):
                if len(at):
                    yield i // BLOCK, True, at.astype(np.uint16).tobytes() + c[at].tobytes()
            else:
                yield i // BLOCK, False, c.tobytes()


def bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def held(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = bucket(keys, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def again(keys: np.ndarray) -> np.ndarray:
    """The hash for the bitmap of frequent phrases."""
    return V.mix64(keys + V._MULT)


def bitmap(blocks: DataFrame, bits: int, support: int) -> np.ndarray:
    """Bits of the buckets with ``support`` or more, as bytes: at most 2 ** bits / 8 of them reach the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, sparse, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = total.setdefault(block, np.zeros(min(BLOCK, 1 << bits), np.uint8))
                m = len(data) // 3
                at = np.frombuffer(data, np.uint16, m) if sparse else slice(None)
                c[at] = np.minimum(c[at].astype(np.uint16) + np.frombuffer(data, np.uint8, offset=2 * m if sparse else 0), 255)
        rows = [(k, np.packbits(c >= support, bitorder="little").tobytes()) for k, c in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "data"])

    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in blocks.repartition("block").mapInArrow(merge, "block int, data binary").collect():
        out[r["block"] * BLOCK // 8 : r["block"] * BLOCK // 8 + len(r["data"])] = np.frombuffer(r["data"], np.uint8)
    return out


def frequent_bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the hashes of phrases (lang, phrase, hash of lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, np.unique(np.concatenate(x))) for k, x in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([True] * len(rows)), pa.array([x.tobytes() + b"\1" * len(x) for _, x in rows], pa.binary())], ["block", "sparse", "data"])

        for b in batches:
            lang = b.column(1).to_numpy().view(np.uint64)
            for lo, hi, raw, off in V.slices(b.column(0), SLICE):
                s = Slice(raw, off, lang[lo:hi])
                n = int(s.words.first[1])
                at = np.unique(bucket(again(s.keys(n)[s.words.first[:-1]]), bits))
                cut = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
                for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
                    seen.setdefault(int(at[i] // BLOCK), []).append((at[i:j] % BLOCK).astype(np.uint16))
            yield out()

    return bitmap(frequent.select("phrase", "code").mapInArrow(run, BLOCKS), bits, 1)


# ---- the passes ------------------------------------------------------------------------

SEEN = "kind string, lang string, phrase string, n long, block int, sparse boolean, data binary"


def _pass(texts: DataFrame, n: int, longest: int, bits: int, keep: tuple | None) -> DataFrame:
    """Rows of kind ``count`` (lang, phrase, n), ``words`` (lang, n; first pass) and ``block``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEEN))
    spark = texts.sparkSession
    maps = spark.sparkContext.broadcast(keep) if keep is not None else None

    def rows(kind: str, size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["kind"] = pa.array([kind]).take(pa.array(np.zeros(size, np.int64)))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bits) if n < longest else None
        for b in batches:
            coded = b.column(1).dictionary_encode()
            number, names = np.asarray(coded.indices, np.int64), coded.dictionary
            code = b.column(2).to_numpy().view(np.uint64)
            for lo, hi, raw, off in V.slices(b.column(0), SLICE):
                s = Slice(raw, off, code[lo:hi])
                keys, open_ = s.keys(n), s.whole(n)
                if maps is not None and len(keys):
                    buckets, frequent, frequent_bits = maps.value
                    part = held(frequent, frequent_bits, again(s.keys(n - 1)))
                    open_ &= part[:-1] & part[1:]
                    open_[open_] = held(buckets, bits, keys[open_])
                row, phrases, counts = s.counted(np.flatnonzero(open_), n, keys, number[lo:hi])
                if len(counts):
                    yield rows("count", len(counts), lang=names.take(pa.array(number[lo:hi][row])), phrase=phrases, n=pa.array(counts))
                if n == 1 and s.words.n:
                    total = np.bincount(number[lo:hi], weights=np.diff(s.words.first), minlength=len(names)).astype(np.int64)
                    yield rows("words", len(names), lang=names, n=pa.array(total))
                if counter is not None and len(open_) > 1:
                    more = s.whole(n + 1) & open_[:-1] & open_[1:]
                    counter.add(s.keys(n + 1)[more])
        if counter is not None:
            for block, sparse, data in counter.blocks():
                yield rows("block", 1, block=pa.array([block]), sparse=pa.array([sparse]), data=pa.array([data], pa.binary()))
        V.trim()

    out = S.stash(texts.mapInArrow(run, SEEN), "counts")
    if maps is not None:
        maps.destroy()
    return out


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a of all phrases of 1 to ``longest`` words with a >= support; lang, n: all words) of docs (text, lang)."""
    if not 1 <= support <= 255:
        raise ValueError("support must fit the bucket counts: 1 to 255")
    lang = F.coalesce("lang", F.lit("und"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("code"))
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = buckets or min(MOST_BUCKETS, max(16, int(size).bit_length()))
    frequent_bits = min(MOST_FREQUENT, max(16, int(size).bit_length()))
    keep, out, totals = None, [], None
    for n in range(1, longest + 1):
        seen = _pass(texts, n, longest, bits, keep)
        counts = seen.filter("kind = 'count'").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= support)
        frequent = S.stash(counts.select("lang", "phrase", F.lit(n).alias("words"), "a"), "frequent")
        out.append(frequent)
        if n == 1:
            totals = S.stash(seen.filter("kind = 'words'").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        if n < longest:
            known = frequent_bitmap(frequent.select("phrase", F.xxhash64("lang").alias("code")), frequent_bits)
            keep = (bitmap(seen.filter("kind = 'block'").select("block", "sparse", "data"), bits, support), known, frequent_bits)
        S.drop(seen)
    union = out[0]
    for x in out[1:]:
        union = union.union(x)
    return union, totals


def score_cuts(frequent: DataFrame, unit: int = UNIT) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all phrases of two words or more, by their lowest-scoring cut."""
    part = lambda start, n: F.array_join(F.slice(F.split("phrase", " "), start, n), " ")
    cut = frequent.filter("words > 1").select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    sides = frequent.select("lang", "phrase", "a")
    small = sides.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for name, count in (("left", "l"), ("right", "r")):
        side = sides.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
        cut = cut.join(F.broadcast(side) if small else side, ["lang", name])
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * CAST({unit} AS DECIMAL(10, 0)) div (l + r)")  # exact: whole decimals
    best = cut.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def drop_contained(scored: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Without phrases that occur inside a longer one ``inside`` percent of the time or more."""
    part = lambda start: F.array_join(F.slice(F.split("phrase", " "), start, F.col("words") - 1), " ")
    longer = scored.filter("words > 2").select("lang", F.col("a").alias("more"), F.explode(F.array(part(1), part(2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = F.expr(f"more IS NULL OR CAST(more AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {int(inside)}")
    return scored.join(longer, ["lang", "phrase"], "left").filter(kept).drop("more")


def mine(docs: DataFrame, first: int = FIRST, support: int = SUPPORT, longest: int = LONGEST, unit: int = UNIT, inside: int = INSIDE, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count, phrase."""
    frequent, totals = frequent_phrases(docs, support, longest, buckets)
    scored = S.stash(score_cuts(frequent, unit), "scored")
    kept = S.stash(drop_contained(scored, inside), "kept")
    # numbered in one order over all languages, in range partitions, so that no task sorts a whole language
    falling = kept.select("*", (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"))
    placed = S.stash(numbered(falling, ["lang", "_s", "_a", "phrase"], "_no").drop("_s", "_a"), "placed")
    begin = placed.groupBy("lang").agg(F.min("_no").alias("_begin")).join(totals, "lang")  # a row for each language
    ranked = placed.join(begin, "lang").withColumn("rank", F.col("_no") - F.col("_begin") + 1).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
