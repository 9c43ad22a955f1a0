"""Language-model scoring: interpolated modified Kneser-Ney trigrams in sorted hash arrays.

Words have 64-bit hashes; pairs and triples are identified by 64-bit hashes of those.
A trigram u v w goes to the shard of its middle word v, so one shard task sees all
that its contexts u v and its continuations v w need.  Words that occur more than
``per_shard`` times are split over several shards by a hash of u; what those shards
know of v w in parts is merged by one more shuffle.  Counting runs in ``passes`` over
the corpus, each for its own range of shards, so only that part of the trigrams is in
a shuffle at a time; tasks send unique arrays, so copies shrink before the shuffle.

Shard tasks write sorted arrays to the shared folder (to a name of their own, then
renamed, so a repeated task is harmless): trigrams and counts; contexts with totals
and numbers of followers; continuation counts of pairs; sums of them by middle word;
continuation counts of words; word counts for the base score.  A key is stored as
its low 48 bits under an index of its high 16.  Counts are summed and stored in 64 bits where they need them.
Workers map those files into memory, ``MOST_MAPS`` at a time, the last used staying;
nothing of the model is broadcast but a few sums and the split words.

Probability of w after u v, with discounts D1, D2, D3+ of each order:
``p3 = max(n(uvw) - D, 0) / n(uv) + g(uv) p2``, ``p2 = max(m(vw) - D', 0) / m(v) + g'(v) p1``,
``p1 = max(m(w) - D'', 0) / M + g'' / (V + 1)``, where m(vw) counts the distinct u before
v w, m(v) their sum over w, m(w) the distinct v before w, M all distinct pairs and V the
words; an unseen context leaves the next lower order.  Documents start after two start
marks and end with an end token, which is scored.

Defined results: null and empty texts are one end token; repeated rows count
and are scored each; rows with a null doc_id train and are not held out; an
empty training set scores every token 1 / (V + 1) = 1; an empty table gives an empty
result; kept columns named like a result give way to it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stash as S
from . import vectext as V

END = np.uint64(0x5D1F0A3C9E7B2468)  # the end token's hash
BEGIN = np.uint64(0xA96E4D17F3B0C25B)  # the start mark's
PER_SHARD = 1_500_000  # tokens
PASSES = 4
SCORE_BYTES = 4 << 20  # of text that are looked up at once
MOST_MAPS = 4096  # files that a task keeps mapped; a process may have 65,530 maps
_SPLIT = np.uint64(0x9FB21C651E98DF25)
_LOW48 = np.uint64((1 << 48) - 1)
OUT = ("n_tokens", "n_known", "base_score", "score")


def sequence(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all tokens with ends, the hash before each, the one before that, row of each)."""
    w = V.words(raw, off, lower=True)
    rows = len(off) - 1
    n = np.diff(w.first) + 1
    stop = np.cumsum(n) - 1
    h = np.empty(w.n + rows, dtype=np.uint64)
    is_end = np.zeros(len(h), dtype=bool)
    is_end[stop] = True
    h[is_end], h[~is_end] = END, w.hash
    start = np.concatenate([[0], stop[:-1] + 1]) if rows else np.zeros(0, int)
    before, second = np.empty_like(h), np.empty_like(h)
    before[1:] = h[:-1]
    before[start] = BEGIN
    second[1:] = before[:-1]
    second[start] = BEGIN
    return h, before, second, np.repeat(np.arange(rows), n)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return V.mix64(a * V._BASE + b)


class Split:
    """Words that are too frequent for one shard, and over how many they are spread."""

    def __init__(self, keys: np.ndarray, parts: np.ndarray):
        o = np.argsort(keys)
        self.keys, self.parts = keys[o].astype(np.uint64), parts[o].astype(np.uint64)

    def holds(self, v: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(v), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, v), len(self.keys) - 1)] == v

    def place(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """A hash that chooses the shard of what starts with u v."""
        sub = np.zeros(len(v), dtype=np.uint64)
        at = np.flatnonzero(self.holds(v))
        if len(at):
            sub[at] = (u[at] >> np.uint64(17)) % self.parts[np.searchsorted(self.keys, v[at])]
        return V.mix64(v + sub * _SPLIT)


def shard_of(place: np.ndarray, shards: int) -> np.ndarray:
    return ((place >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of their counts, where each stood first)."""
    o = np.argsort(keys, kind="stable")
    head = _heads(keys[o])
    return keys[o][head], np.add.reduceat(counts[o].astype(np.int64), head) if len(o) else counts.astype(np.int64), o[head]


def _narrow(c: np.ndarray) -> np.ndarray:
    """Counts as bytes, or in 32 or 64 bits, whichever they fit."""
    top = int(c.max(initial=0))
    return c.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64)


def _counts(raw: bytes, n: int) -> np.ndarray:
    """The n counts of ``_narrow``; the length tells which it was."""
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else np.uint8).astype(np.int64)


# ---- counting ---------------------------------------------------------------------

WORDS = "shard int, key binary, count binary"
TRIPLES = "shard int, v binary, run binary, uv binary, w binary, count binary"


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted shard numbers."""
    head = _heads(shard).tolist()
    for a, b in zip(head, [*head[1:], len(shard)], strict=False):
        yield int(shard[a]), a, b


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(cols)], names)


def _count_words(shards: int, most: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            k, c, _ = _merge(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held.clear()
            return _batch([(s, k[a:b].tobytes(), _narrow(c[a:b]).tobytes()) for s, a, b in _by_shard(shard_of(k, shards))], ["shard", "key", "count"])

        for b in batches:
            for _, _, raw, off in V.slices(b.column(0)):
                held.append(np.unique(sequence(raw, off)[0], return_counts=True))
                if sum(len(x[0]) for x in held) > most:
                    yield out()
        if held:
            yield out()
        V.trim()

    return run


def _count_triples(shards: int, lo: int, hi: int, split: Split, most: int = 2_000_000):
    """Distinct trigrams of the shards lo to hi - 1, cut by shard and sorted by the middle word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            key, shard, v, uv, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            _, c, first = _merge(key, c)
            shard, v, uv, w = shard[first], v[first], uv[first], w[first]
            o = np.lexsort((v, shard))
            shard, v, uv, w, c = shard[o], v[o], uv[o], w[o], c[o]
            rows = []
            for s, a, b in _by_shard(shard):
                head = _heads(v[a:b])
                run_ = np.diff(np.append(head, b - a)).astype(np.uint32)
                rows.append((s, v[a:b][head].tobytes(), run_.tobytes(), uv[a:b].tobytes(), w[a:b].tobytes(), _narrow(c[a:b]).tobytes()))
            return _batch(rows, ["shard", "v", "run", "uv", "w", "count"])

        for b in batches:
            for _, _, raw, off in V.slices(b.column(0)):
                w, v, u, _ = sequence(raw, off)
                shard = shard_of(split.place(u, v), shards)
                at = np.flatnonzero((shard >= lo) & (shard < hi))
                u, v, w, shard = u[at], v[at], w[at], shard[at]
                uv = pair(u, v)
                key, first, c = np.unique(pair(uv, w), return_index=True, return_counts=True)
                held.append((key, shard[first], v[first], uv[first], w[first], c))
                if sum(len(x[0]) for x in held) > most:
                    yield out()
        if held:
            yield out()
        V.trim()

    return run


# ---- sorted arrays in files ---------------------------------------------------------


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of many arrays: a line of JSON with their places, then the arrays."""
    os.makedirs(folder, exist_ok=True)
    spec, at = {}, 0
    for k, a in arrays.items():
        spec[k] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 64))
    os.replace(tmp, f"{folder}/{name}")


def _keys(name: str, key: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as their low 48 bits, and where each value of the high 16 begins."""
    edge = np.arange(1, 1 << 16, dtype=np.uint64) << np.uint64(48)
    at = np.concatenate([[0], np.searchsorted(key, edge), [len(key)]]).astype(np.uint32)
    return {f"{name}.at": at, f"{name}.lo": (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), f"{name}.hi": (key >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16)}


def _values(name: str, c: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 or more apart."""
    big = np.flatnonzero(c >= 255)
    return {f"{name}.n": np.minimum(c, 255).astype(np.uint8), f"{name}.big": big.astype(np.uint32), f"{name}.more": c[big].astype(np.uint64)}


def _shares(name: str, total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> dict[str, np.ndarray]:
    """Totals and numbers of followers, as codes of their distinct combinations."""
    stats = np.stack([total, n1, n2, n3], axis=1).astype(np.uint64)
    small = (stats < 1 << 16).all(axis=1)
    packed = (stats[:, 0] << np.uint64(48)) | (stats[:, 1] << np.uint64(32)) | (stats[:, 2] << np.uint64(16)) | stats[:, 3]
    kinds, first, code = np.unique(packed[small], return_index=True, return_inverse=True)
    codes = np.empty(len(stats), dtype=np.int64)
    codes[small] = code
    codes[~small] = len(kinds) + np.arange((~small).sum())
    book = np.concatenate([stats[small][first], stats[~small]])
    return {f"{name}.code": codes.astype(np.uint16 if len(book) <= 1 << 16 else np.uint32), f"{name}.book": book.ravel()}


def _followers(group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sorted distinct groups, total, n1, n2, n3 and more) of counts n."""
    o = np.argsort(group, kind="stable")
    g, c = group[o], n[o]
    head = _heads(g)
    add = lambda x: np.add.reduceat(x.astype(np.int64), head) if len(g) else np.zeros(0, np.int64)
    return g[head], add(c), add(c == 1), add(c == 2), add(c >= 3)


STATS = "kind int, shard int, key binary, v binary, w binary, count binary, word long, total long, n1 long, n2 long, n3 long, n4 long, rows long"
_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("key", "v", "w", "count")), *((c, pa.int64()) for c in ("word", "total", "n1", "n2", "n3", "n4", "rows"))])
# kinds of rows: 0 words, 1 continuations of words, 2 of pairs, 3 trigrams; 4 parts of split pairs, 5 sums of a split word, 6 the split words


def _stat(kind: int, c: np.ndarray) -> dict:
    return {"kind": kind, "total": int(c.sum()), **{f"n{i}": int((c == i).sum()) for i in (1, 2, 3, 4)}, "rows": len(c)}


def _word_rows(w: np.ndarray, shards: int) -> list[dict]:
    """How many distinct pairs end in each word, cut by the word's shard."""
    k, c = np.unique(w, return_counts=True)
    return [{"kind": 1, "shard": s, "key": k[a:b].tobytes(), "count": _narrow(c[a:b]).tobytes(), "rows": 0} for s, a, b in _by_shard(shard_of(k, shards))]


def _column(t: pa.Table, name: str, kind: type = np.uint64) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), kind) for x in t.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _count_column(t: pa.Table) -> np.ndarray:
    parts = [_counts(x.as_py(), len(k.as_py()) // 8) for x, k in zip(t.column("count"), t.column("key"), strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _reduce_words(folder: str, per_shard: int):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        k, c, _ = _merge(_column(t, "key"), _count_column(t))
        _save(folder, f"word-{shard}", _keys("word", k) | _values("word", c))
        often = c > per_shard  # at most tokens / per_shard of all words
        rows = [_stat(0, c), {"kind": 6, "key": k[often].tobytes(), "count": c[often].astype(np.uint64).tobytes()}]
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return run


def _reduce_triples(folder: str, shards: int, split: Split):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        uv, w = _column(t, "uv"), _column(t, "w")
        v = np.repeat(_column(t, "v"), _column(t, "run", np.uint32))
        c = np.concatenate([_counts(x.as_py(), len(y.as_py()) // 8) for x, y in zip(t.column("count"), t.column("w"), strict=True)])
        key, c, first = _merge(pair(uv, w), c)
        uv, v, w = uv[first], v[first], w[first]
        rows = [_stat(3, c)]
        arrays = _keys("tri", key) | _values("tri", c)
        del key
        ctx, *shares = _followers(uv, c)
        arrays |= _keys("ctx", ctx) | _shares("ctx", *shares)
        del ctx, shares, uv, c
        vw, hot = pair(v, w), split.holds(v)
        one = np.ones(len(vw), np.int64)
        key, m, first = _merge(vw[~hot], one[~hot])
        v2, w2 = v[~hot][first], w[~hot][first]
        rows.append(_stat(2, m))
        arrays |= _keys("bi", key) | _values("bi", m)
        mid, *shares = _followers(v2, m)
        arrays |= _keys("mid", mid) | _shares("mid", *shares)
        rows += _word_rows(w2, shards)
        if hot.any():
            key, m, first = _merge(vw[hot], one[hot])
            v2, w2, to = v[hot][first], w[hot][first], shard_of(key, shards)
            rows += [{"kind": 4, "shard": s, "key": key[a:b].tobytes(), "v": v2[a:b].tobytes(), "w": w2[a:b].tobytes(), "count": _narrow(m[a:b]).tobytes()} for s, a, b in _by_shard(to)]
        _save(folder, f"tri-{shard}", arrays)
        del arrays, vw, v, w
        V.trim()
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return run


def _reduce_split(folder: str, shards: int):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        key, m, first = _merge(_column(t, "key"), _count_column(t))
        v, w = _column(t, "v")[first], _column(t, "w")[first]
        _save(folder, f"split-{shard}", _keys("bi", key) | _values("bi", m))
        sums = zip(*(x.tolist() for x in _followers(v, m)), strict=True)
        rows = [_stat(2, m), *({"kind": 5, "word": x - (1 << 64) if x >> 63 else x, "total": a, "n1": b, "n2": c, "n3": d} for x, a, b, c, d in sums), *_word_rows(w, shards)]
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return run


def _reduce_after(folder: str):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        k, c, _ = _merge(_column(t, "key"), _count_column(t))
        _save(folder, f"after-{shard}", _keys("after", k) | _values("after", c))
        return pa.Table.from_pylist([_stat(1, c)], schema=_SCHEMA)

    return run


def _discounts(n: dict[str, int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (n[f"n{i}"] for i in (1, 2, 3, 4))
    if not n1 or not n2 or not n3:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (3 - 4 * y * n4 / n3, 3.0)))


# ---- the model ------------------------------------------------------------------------


def _open(path: str) -> dict[str, np.ndarray] | None:
    if not os.path.exists(path):
        return None
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    size = 256
    while (end := bytes(raw[:size]).find(b"\n")) < 0:
        size *= 2
    return {k: raw[end + 1 + at : end + 1 + at + n * np.dtype(d).itemsize].view(d) for k, (d, at, n) in json.loads(bytes(raw[:end])).items()}


def find(t: dict[str, np.ndarray], name: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the keys are in table name of a file, where): all by bisection at once."""
    at, lo, hi = t[f"{name}.at"], t[f"{name}.lo"], t[f"{name}.hi"]
    top = (key >> np.uint64(48)).astype(np.int64)
    a, z = at[top].astype(np.int64), at[top + 1].astype(np.int64)
    rest, last = key & _LOW48, len(lo) - 1
    left, right = a, z
    for _ in range(int((z - a).max(initial=0)).bit_length()):
        mid = (left + right) >> 1
        i = np.minimum(mid, last)
        less = (left < right) & (((hi[i].astype(np.uint64) << np.uint64(32)) | lo[i]) < rest)
        right = np.where(less, right, mid)
        left = np.where(less, mid + 1, left)
    i = np.minimum(left, last)
    hit = np.flatnonzero((left < z) & (((hi[i].astype(np.uint64) << np.uint64(32)) | lo[i]) == rest)) if last >= 0 else np.zeros(0, int)
    return hit, left[hit]


class Model:
    """The memory-mapped arrays of a folder, and the sums that come with them."""

    def __init__(self, folder: str, sums: dict):
        self.folder, self.sums = folder, sums
        self.maps: OrderedDict[str, dict[str, np.ndarray] | None] = OrderedDict()  # the last used, last
        self.split = Split(np.array(sums["split"][0], np.uint64), np.array(sums["split"][1], np.uint64))
        self.sub = np.array(sums["split"][2], np.int64).reshape(-1, 4)[np.argsort(np.array(sums["split"][0], np.uint64))]

    def file(self, name: str) -> dict[str, np.ndarray] | None:
        if name in self.maps:
            self.maps.move_to_end(name)
        else:
            while len(self.maps) >= MOST_MAPS:  # a map closes when the last view of it goes
                self.maps.popitem(last=False)
            self.maps[name] = _open(f"{self.folder}/{name}")
        return self.maps[name]

    def look(self, file: str, name: str, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Counts of keys, or rows of four for ``ctx`` and ``mid``; 0 where there is none."""
        wide = name in ("ctx", "mid")
        out = np.zeros((len(key), 4) if wide else len(key), dtype=np.int64)
        order = np.argsort(shard.astype(np.uint16) if self.sums["shards"] < 1 << 16 else shard, kind="stable")
        for s, a, b in _by_shard(shard[order]):
            t = self.file(f"{file}-{s}")
            if t is None:
                continue
            mine = order[a:b]
            hit, at = find(t, name, key[mine])
            if wide:
                out[mine[hit]] = t[f"{name}.book"].reshape(-1, 4)[t[f"{name}.code"][at]]
            else:
                n = t[f"{name}.n"][at].astype(np.int64)
                big = np.flatnonzero(n == 255)
                if len(big):
                    n[big] = t[f"{name}.more"][np.searchsorted(t[f"{name}.big"], at[big])]
                out[mine[hit]] = n
        return out

    def score(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, base score, model score."""
        s, shards = self.sums, self.sums["shards"]
        w, v, u, row = sequence(raw, off)
        rows = len(off) - 1
        d1, d2, d3 = (np.array([0.0, *s[f"d{i}"]]) for i in (1, 2, 3))

        def step(n: np.ndarray, shares: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
            total = shares[:, 0]
            held = (d[1] * shares[:, 1] + d[2] * shares[:, 2] + d[3] * shares[:, 3]) / np.maximum(total, 1)
            return np.where(total > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1) + held * lower, lower)

        word, wi = np.unique(w, return_inverse=True)
        c = self.look("word", "word", word, shard_of(word, shards))
        m = self.look("after", "after", word, shard_of(word, shards))
        p1 = np.maximum(m - d1[np.minimum(m, 3)], 0) / max(s["pairs"], 1) + s["gamma"] / (s["words"] + 1)
        # pairs, with the middle words' sums
        mid, vi = np.unique(v, return_inverse=True)
        hot = self.split.holds(mid)
        sums = self.look("tri", "mid", mid, shard_of(self.split.place(mid, mid), shards))
        if hot.any():
            sums[hot] = self.sub[np.searchsorted(self.split.keys, mid[hot])]
        key, cold = pair(v, w), ~hot[vi]
        n2 = np.zeros(len(key), np.int64)
        n2[cold] = self.look("tri", "bi", key[cold], shard_of(V.mix64(mid), shards)[vi[cold]])
        if hot.any():
            n2[~cold] = self.look("split", "bi", key[~cold], shard_of(key[~cold], shards))
        p2 = step(n2, sums[vi], d2, p1[wi])
        # trigrams
        shard, uv = shard_of(self.split.place(u, v), shards), pair(u, v)
        p3 = step(self.look("tri", "tri", pair(uv, w), shard), self.look("tri", "ctx", uv, shard), d3, p2)
        base = np.log10((c + 0.5) / (s["tokens"] + 0.5 * (s["words"] + 1)))[wi]
        add = lambda x: np.bincount(row, weights=x, minlength=rows)
        return np.bincount(row, minlength=rows), add(c[wi] > 0), add(base), add(np.log10(p3))


def train(docs: DataFrame, per_shard: int = PER_SHARD, passes: int = PASSES) -> Model:
    """Counts all whole texts of docs and writes the model to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    size, docs_n = texts.agg(F.sum(F.octet_length("text") + 1), F.count("*")).collect()[0]
    shards = max(passes, -(-int(size or 0) // (6 * per_shard)))
    folder = S.local_path(S.fresh_folder(spark, "kneser"))
    add = [F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3", "n4", "rows")]

    words = texts.mapInArrow(_count_words(shards), WORDS).groupBy("shard").applyInArrow(_reduce_words(folder, per_shard), STATS)
    words = S.stash(words, "words")
    often = [(k, c) for r in words.filter("kind = 6").select("key", "count").collect() for k, c in zip(np.frombuffer(r[0], np.uint64), np.frombuffer(r[1], np.uint64), strict=True) if k != END]
    if docs_n > per_shard:  # every document begins with the start mark
        often.append((BEGIN, docs_n))
    split = Split(np.array([k for k, _ in often], np.uint64), np.array([-(-int(c) // per_shard) for _, c in often], np.uint64))
    stats = []
    for i in range(passes):
        lo, hi = i * shards // passes, (i + 1) * shards // passes
        rows = texts.mapInArrow(_count_triples(shards, lo, hi, split), TRIPLES)
        stats.append(S.stash(rows.groupBy("shard").applyInArrow(_reduce_triples(folder, shards, split), STATS), "ngrams"))
    some = stats[0]
    for x in stats[1:]:
        some = some.union(x)
    merged = S.stash(some.filter("kind = 4").groupBy("shard").applyInArrow(_reduce_split(folder, shards), STATS), "ngrams")
    some = some.union(merged)
    after = S.stash(some.filter("kind = 1").groupBy("shard").applyInArrow(_reduce_after(folder), STATS), "ngrams")
    got = {r["kind"]: r.asDict() for r in words.filter("kind = 0").union(some.filter("kind IN (2, 3)")).union(after).groupBy("kind").agg(*add).collect()}
    sub = {int(r["word"]) % (1 << 64): [r[c] for c in ("total", "n1", "n2", "n3")] for r in merged.filter("kind = 5").groupBy("word").agg(*add[:4]).collect()}  # a row for each split word
    S.drop(words, *stats, merged, after)
    none = dict.fromkeys(("total", "n1", "n2", "n3", "n4", "rows"), 0)
    word, one, two, three = (got.get(i, none) for i in range(4))
    e = _discounts(one)
    more = max(one["rows"] - one["n1"] - one["n2"], 0)
    gamma = (e[0] * one["n1"] + e[1] * one["n2"] + e[2] * more) / one["total"] if one["total"] else 1.0
    parts = ([int(k) for k in split.keys], [int(x) for x in split.parts], [sub.get(int(k), [0] * 4) for k in split.keys])
    return Model(folder, {"shards": shards, "tokens": word["total"], "words": word["rows"], "pairs": one["total"], "d1": e, "d2": _discounts(two), "d3": _discounts(three), "gamma": gamma, "split": parts})


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, n_tokens, n_known, base_score, score."""
    folder, sums = model.folder, model.sums
    keep = [c for c in keep if c not in OUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(folder, sums)
        for b in batches:
            parts = [m.score(raw, off) for _, _, raw, off in V.slices(b.column(0), SCORE_BYTES)]
            n, known, base, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(s)], [*keep, *OUT])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, f"{fields}n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds the perplexity, 10 ** (-score / n_tokens)."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
