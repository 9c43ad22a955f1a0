"""Secret scans: base patterns and a linear-chain conditional random field.

Tokens are runs of letters, digits, ``+/_.-`` and non-ASCII bytes; everything
else separates.  The field tags each token begin, inside or outside from its
shape (length, classes of characters, share of digits, changes of class, hex), its separators,
neighbouring words (a lexicon and hashes) and file features (share of digits
and of assignments, length).  It is trained by gradient ascent on the
log-likelihood (forward-backward) with the base patterns as silver labels, on
windows of a bounded sample: the ``most`` rows of smallest id hash, at most
``PER_DOC`` windows of each and ``NEGATIVES`` windows without a secret in all.

So that the field finds what the patterns miss, every silver secret is also shown
in other forms, drawn from hashes of its place: the value redrawn in other alphabets and lengths
(base64, upper-case hex, letters and digits), the word before it replaced by
another credential word, by a plain word or by nothing, and the sign between them
changed.  Long words, numbers, addresses and hosts of the same documents stay
outside.  A token is then a secret if its shape and its context say so together.

Decoding is Viterbi over whole texts; tokens whose outside score
leads by more than transitions can ever repay are outside in every best path, so
the chain is cut there, which changes no result.  Tagged spans shorter than ``SHORTEST``
characters are dropped: the patterns, too, take values of 12 characters or more.

Spans are in code points, end exclusive.  Tagged spans that overlap a base span
are dropped: base ones stay.

Defined results: null and empty texts have no spans; repeated rows are scanned
each; an empty table gives an empty result; without any silver label nothing is added;
a column ``spans`` of the input gives way to the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

KINDS = ("assign", "access", "hex", "crf")

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 or more in all; a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials", "pwd")

MOST = 20_000
PER_DOC = 12
NEGATIVES = 12_000
FORMS = 6  # other forms of a silver secret
WINDOW = 13
SHORTEST = 12

# Alphabets, signs and words that other forms are drawn from.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
SIGNS = (" = \"", ": ", "=", " = ", ": '", " ", " -> ")
CUES = ("password", "secret", "token", "api_key", "key", "auth", "bearer", "credential", "pwd", "passwd")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind."""
    if not text:
        return []
    out = []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# ---- features ------------------------------------------------------------------

_CLS = np.zeros(256, dtype=np.uint8)  # bit flags of token bytes
_CLS[0x61:0x7B] = 1
_CLS[0x41:0x5B] = 2
_CLS[0x30:0x3A] = 4
_CLS[[ord(c) for c in "+/"]] = 8
_CLS[[ord(c) for c in "_.-"]] = 16
_CLS[0x80:] = 32
_IN = _CLS > 0
_SEP = np.zeros(256, dtype=np.uint8)  # kinds of separators
for _i, _group in enumerate((" ", "\n\r\t\v\f", "\"'`", ":", "=", ",;", "()[]{}<>", "")):
    for _c in _group:
        _SEP[ord(_c)] = _i
_SEP[[i for i in range(256) if not _IN[i] and chr(i) not in " \n\r\t\v\f\"'`:=,;()[]{}<>"]] = 7

SHAPES, SEPS, HASHES, FILES = 8192, 4096, 4096, 64
_BASE_OF = np.cumsum([0, SHAPES, SEPS, 8, HASHES, HASHES, FILES])
SIZE = int(_BASE_OF[-1])
SLOTS = 6
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 32, 40])


def _word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(V.words(b, np.array([0, len(b)]), lower=True).hash[0])


_LEXICON = np.sort(np.array([_word_hash(k) for k in KEYWORDS], dtype=np.uint64))


def _span_any(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
    return total[end] - total[start]


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row, features[n, SLOTS]) of the tokens of some rows."""
    n = len(raw)
    solid = np.concatenate([_IN[raw], [False]])
    begin = solid[:n].copy()
    begin[1:] &= ~solid[: n - 1] if n else solid[:0]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begin[cuts] = solid[cuts]
    start = np.flatnonzero(begin)
    stop = np.concatenate([[False], solid[:n] & ~solid[1:]])
    if len(cuts):
        stop[cuts] |= solid[cuts - 1] & (cuts > 0)
    end = np.flatnonzero(stop)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    m = len(start)
    if not m:
        return start, end, row, np.zeros((0, SLOTS), np.int64)
    cls = _CLS[raw]
    count = {b: _span_any(cls & b > 0, start, end) for b in (1, 2, 4, 8, 16, 32)}
    size = end - start
    bits = sum((count[b] > 0).astype(np.int64) * b for b in count)
    isnt_hex = ~(((raw >= 0x30) & (raw < 0x3A)) | ((raw >= 0x61) & (raw < 0x67)))
    hexed = _span_any(isnt_hex, start, end) == 0
    change = np.concatenate([[0], (cls[1:] != cls[:-1])]).astype(np.int8) if n else np.zeros(0, np.int8)
    mixed = np.minimum(_span_any(change, np.minimum(start + 1, end), end) * 4 // np.maximum(size, 1), 3)
    length = np.searchsorted(_LENGTHS, size, "right")
    shape = ((length * 64 + bits) * 2 + hexed) * 4 + mixed
    # separators: the two bytes before, the byte after, in their row
    row_start, row_end = offsets[row], offsets[row + 1]
    one = np.where(start - 1 >= row_start, _SEP[raw[np.maximum(start - 1, 0)]], 7).astype(np.int64)
    two = np.where(start - 2 >= row_start, np.where(_IN[raw[np.maximum(start - 2, 0)]], 6, _SEP[raw[np.maximum(start - 2, 0)]]), 7).astype(np.int64)
    three = np.where(start - 3 >= row_start, np.where(_IN[raw[np.maximum(start - 3, 0)]], 6, _SEP[raw[np.maximum(start - 3, 0)]]), 7).astype(np.int64)
    after = np.where(end < row_end, _SEP[raw[np.minimum(end, n - 1)]], 7).astype(np.int64)
    seps = ((one * 8 + two) * 8 + three) * 8 + after
    low = V._LOWER[raw]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(V._BYTE[low] * V._pow("up", n)[:n], out=total[1:])
    h = V.mix64((total[end] - total[start]) * V._pow("down", n)[start])
    known = _LEXICON[np.minimum(np.searchsorted(_LEXICON, h), len(_LEXICON) - 1)] == h
    prev_in = np.concatenate([[False], row[1:] == row[:-1]])
    next_in = np.concatenate([row[1:] == row[:-1], [False]])
    kw1 = prev_in & np.concatenate([[False], known[:-1]])
    kw2 = np.concatenate([[False], kw1[:-1]]) & prev_in
    bucket = (h >> np.uint64(52)).astype(np.int64)
    prev = np.where(prev_in, np.concatenate([[0], bucket[:-1]]), 0)
    nxt = np.where(next_in, np.concatenate([bucket[1:], [0]]), 0)
    rows = len(offsets) - 1
    width = np.maximum(np.diff(offsets), 1)
    at = np.repeat(np.arange(rows), np.diff(offsets))
    digits = np.minimum(np.bincount(at, weights=cls == 4, minlength=rows) / width * 40, 3).astype(np.int64)
    equal = np.minimum(np.bincount(at, weights=raw == 0x3D, minlength=rows) / width * 400, 3).astype(np.int64)
    long_ = np.minimum(np.log2(width) / 4, 3).astype(np.int64)
    file = ((digits * 4 + equal) * 4 + long_)[row]
    f = np.stack([shape, seps, known * 4 + kw1 * 2 + kw2, prev, nxt, file], axis=1) + _BASE_OF[:-1]
    return start, end, row, f


def _code_points(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


# ---- the field -----------------------------------------------------------------
# tags: 0 outside, 1 begin, 2 inside


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def gradient(f: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of windows f[n, L, SLOTS] with tags y[n, L], and its gradients."""
    n, length, _ = f.shape
    e = w[f[:, :, 0]]
    for s in range(1, SLOTS):
        e = e + w[f[:, :, s]]
    alpha, beta = np.empty((n, length, 3)), np.zeros((n, length, 3))
    alpha[:, 0] = e[:, 0]
    for i in range(1, length):
        alpha[:, i] = _lse(alpha[:, i - 1, :, None] + t, 1) + e[:, i]
    for i in range(length - 2, -1, -1):
        beta[:, i] = _lse(t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    own = np.eye(3)[y]
    g = own - np.exp(alpha + beta - z[:, None, None])
    gt = np.zeros((3, 3))
    like = (own * e).sum() - z.sum()
    for i in range(1, length):
        p = np.exp(alpha[:, i - 1, :, None] + t + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None])
        np.add.at(gt, (y[:, i - 1], y[:, i]), 1.0)
        gt -= p.sum(axis=0)
        like += t[y[:, i - 1], y[:, i]].sum()
    gw = np.zeros_like(w)
    flat, gf = f.reshape(-1, SLOTS), g.reshape(-1, 3)
    for s in range(SLOTS):
        for tag in range(3):
            gw[:, tag] += np.bincount(flat[:, s], weights=gf[:, tag], minlength=SIZE)
    return float(like), gw, gt


def fit(f: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights w[SIZE, 3] and transitions t[3, 3], by AdaGrad on all windows."""
    w, t = np.zeros((SIZE, 3)), np.zeros((3, 3))
    hw, ht = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    for _ in range(rounds if len(f) else 0):
        _, gw, gt = gradient(f, y, w, t)
        gw, gt = gw - l2 * w, gt - l2 * t
        hw += gw * gw
        ht += gt * gt
        w += rate * gw / np.sqrt(hw)
        t += rate * gt / np.sqrt(ht)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags of chains e[n, L, 3], all between outside tokens."""
    n, length, _ = e.shape
    back = np.zeros((n, length, 3), dtype=np.int8)
    d = e[:, 0] + t[0]
    for i in range(1, length):
        s = d[:, :, None] + t
        back[:, i] = s.argmax(axis=1)
        d = s.max(axis=1) + e[:, i]
    tag = (d + t[:, 0]).argmax(axis=1)
    out = np.empty((n, length), dtype=np.int8)
    for i in range(length - 1, -1, -1):
        out[:, i] = tag
        tag = back[np.arange(n), i, tag]
    return out


def decode(f: np.ndarray, row: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Viterbi tags of all tokens; each row is a chain with outside before and after."""
    tags = np.zeros(len(f), dtype=np.int8)
    if not len(f):
        return tags
    e = w[f[:, 0]].copy()
    for s in range(1, SLOTS):
        e += w[f[:, s]]
    slack = 2 * float(t.max() - t.min())
    open_ = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= slack
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    cut = np.flatnonzero((np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])) + 1
    first = at[np.concatenate([[0], cut])]
    length = np.diff(np.concatenate([[0], cut, [len(at)]]))
    for n in np.unique(length):
        s = first[length == n]
        for lo in range(0, len(s), max(1, 65536 // int(n))):
            idx = s[lo : lo + max(1, 65536 // int(n)), None] + np.arange(n)
            tags[idx] = viterbi(e[idx], t)
    return tags


def _silver(texts: pa.Array, i: int, j: int, raw: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Tags that the base patterns give to tokens; of an assignment only the value counts."""
    y = np.zeros(len(start), dtype=np.int8)
    cp = _code_points(raw)
    first = np.searchsorted(row, np.arange(j - i + 1))
    for r in range(j - i):
        text = texts[i + r].as_py()
        for s, kind, e in base_spans(text):
            if kind == 0:
                s = e - len(ASSIGN.match(text, s)[2])
            a, b = first[r], first[r + 1]
            here = cp[start[a:b]] - cp[off[r]]
            hit = a + np.flatnonzero((here >= s) & (here < e))
            if len(hit):
                y[hit] = 2
                y[hit[0]] = 1
    return y


def _forms(text: str, at: int, end: int, seed: int) -> list[tuple[str, int, int]]:
    """(snippet, value from, to) of other forms of the secret text[at:end]; drawn from the seed alone."""
    rng = np.random.default_rng(seed)
    left = re.sub(r"[\"'=:\s]*$", "", text[max(0, at - 160) : at])
    before, _, _ = left.rpartition(" ")
    after = text[end : end + 120].lstrip("\"'")
    plain = (re.findall(r"[^\W\d_]{3,}", before[-80:]) or ["text"])[0]
    out = []
    for i in range(FORMS):
        letters = ALPHABETS[int(rng.integers(len(ALPHABETS)))]
        size = int(rng.integers(16, 49))
        value = "".join(letters[j] for j in rng.integers(0, len(letters), size).tolist())
        cue = plain if i % 3 == 2 else CUES[int(rng.integers(len(CUES)))]
        sign = SIGNS[int(rng.integers(len(SIGNS)))]
        if cue == plain:
            sign = SIGNS[int(rng.integers(5))]
        head = f"{before} {cue}{sign}"
        close = sign[-1] if sign[-1] in "\"'" else ""
        out.append((f"{head}{value}{close}{after}", len(head), len(head) + size))
    return out


def _form_windows(forms: list[tuple[str, int, int]], file: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and tags of the windows around the values; file features are those of the document."""
    half, fs, ys = WINDOW // 2, [], []
    for text, a, z in forms:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        start, end, _, f = tokens(raw, np.array([0, len(raw)]))
        cp = _code_points(raw)
        inside = np.flatnonzero((cp[start] >= a) & (cp[start] < z))
        if not len(inside) or len(start) < WINDOW:
            continue
        y = np.zeros(len(start), dtype=np.int8)
        y[inside], y[inside[0]] = 2, 1
        f[:, SLOTS - 1] = file
        c = int(np.clip(inside[0], half, len(start) - half - 1))
        fs.append(f[c - half : c + half + 1])
        ys.append(y[c - half : c + half + 1])
    return fs, ys


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    half = WINDOW // 2
    for b in batches:
        for i, j, raw, off in V.slices(b.column(0)):
            start, end, row, f = tokens(raw, off)
            y = _silver(b.column(0), i, j, raw, off, start, end, row)
            cp = _code_points(raw)
            first = np.searchsorted(row, np.arange(j - i + 1))
            fs, ys, os_ = [], [], []
            for r in range(j - i):
                a, z = first[r], first[r + 1]
                if z - a < WINDOW:
                    continue
                o, text = b.column(1)[i + r].as_py(), None
                found = a + np.flatnonzero(y[a:z] == 1)
                size = end[a:z] - start[a:z]
                hard = a + np.argsort(-size * (y[a:z] == 0), kind="stable")[:4]  # the longest tokens that are no secrets
                spread = a + (np.arange(1, 3) * (z - a)) // 3
                # of many secrets an even choice, so that a document has PER_DOC windows at most besides the other forms
                some = found[np.unique(np.linspace(0, len(found) - 1, min(len(found), PER_DOC - 6)).astype(int))] if len(found) else found
                for c in dict.fromkeys(np.clip(np.concatenate([some, hard, spread]), a + half, z - half - 1).tolist()):
                    fs.append(f[c - half : c + half + 1])
                    ys.append(y[c - half : c + half + 1])
                    os_.append(o)
                for c in some[:1].tolist():
                    text = b.column(0)[i + r].as_py()
                    last = c
                    while last + 1 < z and y[last + 1] == 2:
                        last += 1
                    s, e = int(cp[start[c]] - cp[off[r]]), int(cp[end[last]] - cp[off[r]])
                    more, tags = _form_windows(_forms(text, s, e, o & 0x7FFFFFFF), f[c, SLOTS - 1])
                    fs, ys, os_ = fs + more, ys + tags, os_ + [o] * len(more)
            if fs:
                flat = np.concatenate(fs).astype(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fs) + 1, dtype=np.int32) * WINDOW * SLOTS), pa.array(flat))
                tags = pa.ListArray.from_arrays(pa.array(np.arange(len(fs) + 1, dtype=np.int32) * WINDOW), pa.array(np.concatenate(ys).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(os_, pa.int64()), lists, tags], ["o", "f", "y"])


def _fit(negatives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, y = [np.zeros((0, WINDOW, SLOTS), np.int32)], [np.zeros((0, WINDOW), np.int32)]
        for b in batches:
            f.append(b.column(1).flatten().to_numpy().reshape(-1, WINDOW, SLOTS))
            y.append(b.column(2).flatten().to_numpy().reshape(-1, WINDOW))
        f, y = np.concatenate(f), np.concatenate(y)
        order = np.lexsort(np.concatenate([f.reshape(len(f), -1)[:, :24], y], axis=1).T) if len(f) else np.zeros(0, int)
        pos, neg = order[(y[order] > 0).any(axis=1)], order[(y[order] == 0).all(axis=1)]
        neg = neg[np.unique(np.linspace(0, len(neg) - 1, min(len(neg), negatives)).astype(int))] if len(neg) else neg
        pick = np.concatenate([pos, neg]).astype(int)
        w, t = fit(f[pick], y[pick]) if len(pos) else (np.zeros((SIZE, 3)), np.zeros((3, 3)))
        hold = np.flatnonzero(np.abs(w).ravel() > 0)
        at = np.concatenate([hold, SIZE * 3 + np.arange(9)])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.concatenate([w.ravel()[hold], t.ravel()]))], ["at", "w"])

    return run


def train(docs: DataFrame, most: int = MOST, negatives: int = NEGATIVES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from a bounded sample of whole texts of docs.

    ``most`` bounds the rows, ``negatives`` the windows without a secret, an even choice of all.
    """
    chosen = docs.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()  # ids only, `most` at most
    told = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("o"))
    windows = told.mapInArrow(_windows, "o long, f array<int>, y array<int>")
    got = windows.repartition(1).mapInArrow(_fit(negatives), "at int, w double").toPandas()  # the size of the model
    flat = np.zeros(SIZE * 3 + 9)
    flat[got["at"].to_numpy()] = got["w"].to_numpy()
    return flat[: SIZE * 3].reshape(SIZE, 3), flat[SIZE * 3 :].reshape(3, 3)


def find(column: pa.Array, w: np.ndarray, t: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind number, end) of each text: base ones and what the field adds."""
    out: list[list[tuple[int, int, int]]] = [base_spans(x) for x in column.to_pylist()]
    if not np.any(w):
        return out
    for i, j, raw, off in V.slices(column):
        start, end, row, f = tokens(raw, off)
        tags = decode(f, row, w, t)
        at = np.flatnonzero(tags)
        if not len(at):
            continue
        cp = _code_points(raw)
        fresh = (tags[at] == 1) | np.concatenate([[True], (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])])
        heads = np.flatnonzero(fresh)
        tails = np.concatenate([heads[1:], [len(at)]]) - 1
        for a, b in zip(at[heads].tolist(), at[tails].tolist(), strict=True):
            r = row[a]
            s, e = int(cp[start[a]] - cp[off[r]]), int(cp[end[b]] - cp[off[r]])
            mine = out[i + r]
            if e - s < SHORTEST:
                continue
            if not any(s < y and x < e for x, _, y in mine):
                mine.append((s, 3, e))
    for spans in out:
        spans.sort()
    return out


def scan(docs: DataFrame, w: np.ndarray, t: np.ndarray, redacted: bool = False) -> DataFrame:
    """All columns of docs, then spans: array of (start, kind, stop); in texts that come back redacted, where they were."""
    sent = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32).astype(np.float64), t))  # of fixed size
    docs = docs.drop("spans")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))
        for b in batches:
            found = find(b.column(names.index("text")), *sent.value)
            spans = pa.array([[{"start": s, "kind": KINDS[k], "stop": e} for s, k, e in x] for x in found], kind)
            columns = list(b.columns)
            if redacted and any(found):
                texts = columns[names.index("text")].to_pylist()
                columns[names.index("text")] = pa.array([redact(t, [(s, e) for s, _, e in x]) if x else t for t, x in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, spans], [*names, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, spans array<struct<start:bigint,kind:string,stop:bigint>>")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced by a mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]
