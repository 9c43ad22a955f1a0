"""Packing of documents into sequences of bounded length by first-fit decreasing.

1. A document's ids are those of a tokenizer, then an end id.  Every distinct word of a batch
   is encoded once and the texts are put together from those by look-up.  So the tokenizer must drop ASCII white space,
   treat what stands between it by itself, and begin a new word at one of ``.,;:!?`` after an ASCII letter.
2. A document is cut into pieces of ``length`` ids and a rest.  A full piece is a sequence by itself;
   pieces go to groups at random: by a hash of what the piece is, of how many equal ones its task saw before
   and of the task, so that copies spread and a repeated task deals the same.
3. Each group, of about ``group`` pieces at most, is packed by itself: longest first, each into the first
   sequence with room for it, which a tournament tree of what is left in the sequences finds in logarithmic time.
4. Where more than ``slack`` of a group's places would be padding, its emptiest sequences are
   dissolved: their pieces are cut to fill the holes of the others, largest hole first.

Sequences are padded to ``length`` by whoever trains on them; one whose length is a power of two is not.

Defined results: null and empty texts are the end id alone; rows with a null doc_id and repeated rows
are documents each; a text of any length is cut as any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

LENGTH, GROUP, SLACK, END = 2048, 4096, 0.005, 1
MOST_WORDS = 1_000_000  # words that a worker keeps the ids of
JOINED = 100  # words of letters that go to the tokenizer as one text
SLICE = 4 << 20  # bytes of text that are encoded at once
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP[list(b".,;:!?")] = True
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole batches of texts; every distinct word meets the tokenizer once."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that end a word
        if suffix:
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.wide = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget([])

    @staticmethod
    def of(spec: str) -> Encoder:
        """One encoder a worker, kept from task to task."""
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in _encoders:
            _encoders[key] = Encoder(spec)
        return _encoders[key]

    def _forget(self, but: list[bytes]) -> None:
        """Keeps the ids of these words only."""
        at = np.fromiter((self.place[w] for w in but), np.int64, len(but)) if but else np.zeros(0, np.int64)
        flat, first = (self.flat, self.first) if but else (np.zeros(0, self.wide), np.zeros(1, np.int64))
        n = first[at + 1] - first[at]
        to = np.concatenate([[0], np.cumsum(n)])
        self.flat, self.first = flat[np.repeat(first[at] - to[:-1], n) + np.arange(to[-1])], to
        self.place: dict[bytes, int] = dict(zip(but, range(len(but)), strict=True))

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """The places of distinct words in ``first``."""
        at = list(map(self.place.get, words))
        new = [w for w, x in zip(words, at, strict=True) if x is None]
        if new:
            if len(self.place) + len(new) > MOST_WORDS:
                self._forget([w for w, x in zip(words, at, strict=True) if x is not None])
                at = list(map(self.place.get, words))
            made, first = self._ids([w.decode() for w in new]), len(self.place)
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), self.wide, int(size.sum()))])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
            fresh = iter(range(first, first + len(new)))
            at = [next(fresh) if x is None else x for x in at]
        return np.array(at, np.int64)

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words of letters go some at a time in one text, where their last ids tell them apart; where those do not add up, and all others, singly."""
        out: list = [None] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()] if self.ends.any() else []
        parts = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
        joined = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in p]) for p in parts], add_special_tokens=False)
        for p, e in zip(parts, joined, strict=True):
            ids = e.ids
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(p) and last[-1] == len(ids):
                a = 0
                for i, b in zip(p, last.tolist(), strict=True):
                    out[i] = ids[a:b]
                    a = b
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, raw: np.ndarray, off: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in one array, where each row begins and the last ends); each row ends with ``end``."""
        w = V.words(raw, off, hashed=False)
        stops = np.flatnonzero(_STOP[raw[1:]] & _LETTER[raw[:-1]]) + 1
        stops = stops[~np.isin(stops, off)]
        start, stop = np.sort(np.concatenate([w.start, stops])), np.sort(np.concatenate([w.end, stops]))
        edge = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(raw[~V._SPACE[raw]])])
        coded = column.dictionary_encode()
        place = self._learn(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)] if len(start) else np.zeros(0, np.int64)
        n = self.first[place + 1] - self.first[place]
        total = np.concatenate([[0], np.cumsum(n)])
        rows = len(off) - 1
        begin = total[np.searchsorted(start, off)] + np.arange(rows + 1)
        out = np.empty(int(begin[-1]), self.wide)
        body = np.ones(len(out), bool)
        body[begin[1:] - 1] = False
        out[begin[1:] - 1] = end
        out[body] = self.flat[np.repeat(self.first[place] - total[:-1], n) + np.arange(total[-1])]
        return out, begin


class Tournament:
    """What is left in each sequence, as a tree of maxima: finds the first with enough room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Number of the first sequence with room for ``size``, which it now holds."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        at = i - self.leaves
        while i > 1:
            i >>= 1
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return at


def first_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """The sequence of each piece; sizes fall and are ``length`` at most."""
    full = int(np.searchsorted(-sizes, -length, "right"))
    tree = Tournament(max(1, len(sizes) - full), length)
    return np.concatenate([np.arange(full), full + np.array([tree.take(s) for s in sizes[full:].tolist()], np.int64)]).astype(np.int64)


def padding(used: np.ndarray, length: int) -> np.ndarray:
    """Padded places of sequences of these lengths; none at a power of two."""
    return np.where(used & (used - 1) == 0, 0, length - used)


def pack(sizes: np.ndarray, length: int = LENGTH, slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, size, sequence, offset) of falling sizes; sequences count from 0 without gaps."""
    bins = first_fit_decreasing(sizes, length)
    n = int(bins.max(initial=-1)) + 1
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for piece, (b, size) in enumerate(zip(bins.tolist(), sizes.tolist(), strict=True)):
        held[b].append((piece, 0, size))
    used = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
    waste = padding(used, length)
    holes = sorted((int(waste[b]), b) for b in np.flatnonzero(waste).tolist())  # the emptiest sequence is the last
    lost, room = int(waste.sum()), int(waste.sum())
    while len(holes) > 1 and lost > slack * length * n and room - holes[-1][0] >= length - holes[-1][0]:
        hole, b = holes.pop()
        room -= hole
        todo, held[b] = held[b], []
        for piece, start, size in todo:
            while size:
                free, to = holes.pop()
                part = min(free, size)
                held[to].append((piece, start, part))
                start, size, room = start + part, size - part, room - part
                if free > part:
                    holes.append((free - part, to))
        holes.sort()
        n -= 1
        lost = room
    out = []
    for number, rows in enumerate(x for x in held if x):
        offset = 0
        for piece, start, size in rows:
            out.append((piece, start, size, number, offset))
            offset += size
    return out


PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary, grp int, dealt long"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def _binary(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pieces(docs: DataFrame, spec: str, groups: int, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents (doc_id, text) with ids in the tokenizer's width, and the group of each."""
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, seen = Encoder.of(held.value), Counter()
        task = V.mix64(np.array([TaskContext.get().partitionId() + 1], np.uint64))
        for b in batches:
            for lo, hi, raw, off in V.slices(b.column(1), SLICE):
                ids, begin = encoder.encode(raw, off, end)
                n = np.diff(begin)
                # a row by its id and sums over its tokens; equal rows of a task are told apart by how often they were there, so the order of rows does not matter
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(V.mix64(ids.astype(np.uint64) + np.uint64(1)) * V._pow("up", len(ids))[: len(ids)])])
                own = b.column(0).slice(lo, hi - lo).cast(pa.int64())
                named = V.mix64(own.fill_null(-1).to_numpy().view(np.uint64) + np.uint64(2) * np.asarray(own.is_null(), np.uint64) * V._MULT)
                content = V.mix64((total[begin[1:]] - total[begin[:-1]]) * V._pow("down", len(ids) + 1)[begin[:-1]] + named * V._BASE).tolist()
                again = np.empty(len(content), np.uint64)
                for i, c in enumerate(content):
                    again[i] = seen[c]
                    seen[c] += 1
                doc = V.mix64(np.array(content, np.uint64) + V.mix64(again + task) * V._MULT)
                count = -(-n // length)
                row = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, n[row] - start)
                dealt = V.mix64(doc[row] + np.where(size == length, start + 1, 0).astype(np.uint64) * V._BASE)
                edge = np.append(begin[row] + start, begin[-1]) * encoder.wide.itemsize
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(row)), pa.array(start), pa.array(size), pa.array(n[row]), _binary(ids, edge), pa.array((dealt % np.uint64(groups)).astype(np.int32)), pa.array(V.signed(dealt))],
                    [c.split()[0] for c in PIECE.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, spec: str, length: int = LENGTH, group: int = GROUP, slack: float = SLACK, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset of every piece of docs (doc_id, text).

    spec is the tokenizer as JSON; ids are little-endian 32-bit numbers. A partition of docs must hold the same rows each time, in any order.
    """
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).collect()[0]
    most = rows + int(size or 0) // length  # an id has one byte of text at least, but for rare compositions
    groups = max(1, -(-most // group))

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        size, dealt, start = (t.column(c).to_numpy() for c in ("length", "dealt", "start"))
        doc = t.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((start, doc, dealt, -size))
        piece, lo, n, number, offset = (np.array(x, np.int64) for x in zip(*pack(size[order], length, slack), strict=True))
        at = order[piece]
        ids = t.column("ids").combine_chunks()
        edge = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        wide = int((edge[-1] - edge[0]) // max(int(size.sum()), 1))
        raw = np.frombuffer(ids.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(f"<u{wide}")
        first = (edge[:-1][at] - edge[0]) // wide + lo
        to = np.concatenate([[0], np.cumsum(n)])
        out = raw[np.repeat(first - to[:-1], n) + np.arange(to[-1])].astype("<u4")
        own = t.select(["doc_id", "doc_tokens"]).take(pa.array(at))
        grp = t.column("grp")[0].as_py()
        columns = [own.column("doc_id"), pa.array(start[at] + lo), pa.array(n), own.column("doc_tokens"), _binary(out, to * 4), pa.array((grp << 32) + number), pa.array(offset)]
        return pa.table(columns, [c.split()[0] for c in PACKED.split(", ")])

    return pieces(docs, spec, groups, length, end).groupBy("grp").applyInArrow(solve, PACKED)
