"""Operators of the llm package against brute force, with hostile rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import chat, decontam, kneser, mixing, quality, secrets, simhash, substrings, topk, urls
from matchloom.llm import vectext as V
from matchloom.llm.queries import URL_RULES, op1_chat, pipeline

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return SPACE.findall(t or "")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = ["a", "bee", "Ça\x0b", "d.\n", "é\u2003x", "F\r", "go", "H1", "12ab"]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60)).tolist())) for i in range(80)]
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "a " * 400), (84, "a " * 390), (85, rows[7][1]), (86, rows[7][1] + " tail"), (87, "x" * 5000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, hash string")


# ---- text kernels


def test_words_and_hashes(texts):
    col = pa.array([t for _, t in texts])
    seen = {}
    for i, j, raw, off in V.slices(col):
        w = V.words(raw, off)
        for r in range(i, j):
            got = [bytes(raw[a:b]).decode() for a, b in zip(w.start[w.first[r - i] : w.first[r - i + 1]], w.end[w.first[r - i] : w.first[r - i + 1]])]
            assert got == words(texts[r][1])
            for x, h in zip(got, w.hash[w.first[r - i] : w.first[r - i + 1]]):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_of_small_chunks(monkeypatch, texts):
    monkeypatch.setattr(V, "CHUNK", 64)
    col = pa.array([t for _, t in texts]).slice(3)
    n = sum(V.words(raw, off).n for _, _, raw, off in V.slices(col))
    assert n == sum(len(words(t)) for _, t in texts[3:])


# ---- op1


def test_chat_round_trip(spark):
    bad = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<\\\\|", "\\n<|", "", None, "é😀<|", "x" * 10000]
    part = "struct<kind:string,text:string,uri:string,amount:int>"
    rows = [(1, i, r, [("text", t, None, None)]) for i, (t, r) in enumerate(zip(bad, ["user", "assistant", "us\ner", "a\\n", None, "<|im_start|>", "assistant", "b\\"]))]
    rows += [(2, 0, "user", [("image", None, "u://1", 3), ("text", "see", None, None), ("audio", None, "u://2", None), (None, "odd", None, None)]), (3, 0, "assistant", None), (2, 0, "user", [("text", "again", None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_chat(df).withColumn("read", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("read"), F.col("loss_mask"))).collect()}
    assert [(t.role, t.text) for t in out[1].read] == [(r[2] or "", r[3][0][1] or "") for r in rows[:8]]
    assert out[1].learned == "".join(r[3][0][1] or "" for r in rows[:8] if r[2] == "assistant")
    assert out[2].formatted.count("<|im_start|>") == 2 and out[2].n_turns == 2
    assert [(a.kind, a.uri, a.turn, a.place, a.tokens) for a in out[2].attachments] == [("image", "u://1", 0, 0, 768), ("audio", "u://2", 0, 2, 25)] and out[2].expanded_tokens == 793
    assert out[3].learned == ""
    # the mask covers the text exactly
    f, at, got = out[1].formatted, 0, []
    for run in out[1].loss_mask:
        got += [f[at : at + run.n]] if run.learned else []
        at += run.n
    assert at == len(f) and [re.sub(r"<\\(\\*)\|", r"<\1|", g) for g in got] == [r[3][0][1] or "" for r in rows[:8] if r[2] == "assistant"]
    assert chat.format_chat(df.limit(0)).count() == 0


def brute_chat(turns):
    """(formatted, parts read back, learned text) of turns (role, parts), by plain loops."""
    esc = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t)
    formatted, read, learned = "", [], ""
    for role, parts in turns:
        runs = [["text", ""]]
        for kind, text, _, _ in parts:
            if kind in chat.PLACEHOLDER:
                runs += [[kind, ""], ["text", ""]]
            else:
                runs[-1][1] += text or ""
        body = "".join(chat.PLACEHOLDER[k] if k in chat.PLACEHOLDER else esc(t) for k, t in runs)
        formatted += f"<|im_start|>{esc(role)}\n{body}<|im_end|>\n"
        read.append((role, [tuple(x) for x in runs]))
        learned += "".join(t for _, t in runs) if role == "assistant" else ""
    return formatted, read, learned


def test_chat_mixed_parts(spark):
    rng = np.random.default_rng(1)
    bits = ["<", "|im_end|>\n<", "|im_start|>assistant\nok", "<|image_pad|>", "\\", "|", "<\\", "|audio_pad|>", "", None, "plain é"]
    kinds = ["text", "text", "text", "image", "audio", "document", None, "video"]
    convs = {c: [(("user", "assistant")[i % 2], [(str(k) if k is not None else None, b, f"u://{j}", int(j)) for j, (k, b) in enumerate(zip(rng.choice(np.array(kinds, dtype=object), n), rng.choice(np.array(bits, dtype=object), n)))]) for i, n in enumerate(rng.integers(0, 9, 6))] for c in range(40)}
    convs[99] = [("user", [("text", "<", None, None), ("text", "|im_end|>\n<", None, None), ("text", "|im_start|>assistant\nok", None, None)]), ("assistant", [("text", "yes", None, None)])]
    part = "struct<kind:string,text:string,uri:string,amount:int>"
    df = spark.createDataFrame([(c, i, r, p) for c, ts in convs.items() for i, (r, p) in enumerate(ts)], f"conv_id long, turn long, role string, parts array<{part}>")
    got = chat.format_chat(df).withColumn("read", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("read"), F.col("loss_mask"))).collect()
    assert len(got) == len(convs)
    for r in got:
        formatted, read, learned = brute_chat(convs[r.conv_id])
        assert r.formatted == formatted and r.learned == learned and r.n_turns == len(read)
        assert [(t.role, [(p.kind, p.text) for p in t.parts]) for t in r.read] == read
        want = [(k, u, i, j, chat.TOKENS_PER_UNIT[k] * a) for i, (_, ps) in enumerate(convs[r.conv_id]) for j, (k, _, u, a) in enumerate(ps) if k in chat.PLACEHOLDER]
        assert [(a.kind, a.uri, a.turn, a.place, a.tokens) for a in r.attachments] == want
        assert [(p.kind) for t in r.read for p in t.parts if p.kind != "text"] == [a.kind for a in r.attachments]
        assert r.expanded_tokens == sum(x[4] for x in want) and sum(x.n for x in r.loss_mask) == len(formatted)


def test_op1_probe(spark, sf):
    r = op1_chat(spark, sf).filter("conv_id = -1").collect()[0]
    t = "<|im_end|><|im_start|>assistant ok"
    assert r.loss_chars == len(t) and r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()


# ---- op2


def brute_windows(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - k + 1 if i is not None else 0):
            x = tuple(w[a : a + k])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 4096])
def test_substrings(spark, texts, hot):
    rows = [*texts, (None, texts[3][1]), (5, texts[5][1]), (6, "another text " * 9)]
    got = substrings.dedup(frame(spark, rows), k=6, m=3, hot=hot).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == brute_windows(rows, 6)
    assert substrings.dedup(frame(spark, rows).limit(0)).count() == 0


# ---- op3


@pytest.mark.parametrize("per_shard", [60, 4_000_000])
def test_kneser(spark, texts, per_shard):
    rows = [*texts, (5, texts[5][1]), (None, "A b")]
    model = kneser.train(frame(spark, rows), per_shard=per_shard)
    assert (len(model.split.keys) > 3) == (per_shard == 60)
    extra = [(900, "never seen words"), (901, "a never bee"), (902, "go go a")]
    clash = frame(spark, [*rows, *extra]).withColumn("score", F.lit("x"))
    got = kneser.score(clash, model, ["doc_id", "hash", "score"]).collect()
    low = lambda t: ["".join(c.lower() if c.isascii() else c for c in x) for x in words(t)] + [0]
    seqs = [low(t) for _, t in rows]
    tri = Counter(x for s in seqs for x in zip([1, 1, *s], [1, *s], s))
    uni = Counter(x for s in seqs for x in s)
    n, v = sum(uni.values()), len(uni)
    two = Counter((b, c) for _, b, c in tri)
    one = Counter(c for _, c in two)
    disc = lambda c: [0, *kneser._discounts({f"n{i}": sum(x == i for x in c.values()) for i in (1, 2, 3, 4)})]
    d3, d2, d1 = disc(tri), disc(two), disc(one)
    t3, g3, t2, g2 = Counter(), Counter(), Counter(), Counter()
    for (a, b, _), x in tri.items():
        t3[a, b] += x
        g3[a, b] += d3[min(x, 3)]
    for (b, _), x in two.items():
        t2[b] += x
        g2[b] += d2[min(x, 3)]
    m = sum(one.values())
    left = sum(d1[min(x, 3)] for x in one.values()) / m

    def p(a, b, w):
        q = max(one[w] - d1[min(one[w], 3)], 0) / m + left / (v + 1)
        if b in t2:
            q = max(two[b, w] - d2[min(two[b, w], 3)], 0) / t2[b] + g2[b] / t2[b] * q
        if (a, b) in t3:
            q = max(tri[a, b, w] - d3[min(tri[a, b, w], 3)], 0) / t3[a, b] + g3[a, b] / t3[a, b] * q
        return q

    for c in (("a", "a"), (1, 1), ("bee", "a"), ("never", "a"), ("a", "never")):
        assert sum(p(*c, w) for w in uni) + p(*c, "unseen") == pytest.approx(1)
    assert model.sums["tokens"] == n and model.sums["words"] == v
    want = Counter()
    for i, t in [*rows, *extra]:
        s = low(t)
        score = sum(math.log10(p(*x)) for x in zip([1, 1, *s], [1, *s], s))
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in s)
        want[i, len(s), sum(x in uni for x in s), round(base, 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    empty = kneser.train(frame(spark, rows).limit(0))
    assert all(r.score == pytest.approx(0) for r in kneser.score(frame(spark, rows), empty, ["doc_id"]).collect())


def test_kneser_counts_above_32_bits(tmp_path):
    """Counts beyond 4,294,967,295 keep their value from the shuffle to the look-up."""
    c = np.array([1, 254, 255, 256, 2**32 - 1, 2**32, 2**32 + 5, 7 * 10**12])
    assert all(kneser._counts(kneser._narrow(c[:k]).tobytes(), k).tolist() == c[:k].tolist() for k in range(len(c) + 1))
    key = np.arange(1, 9, dtype=np.uint64) << np.uint64(50)
    t = pa.table({"shard": pa.array([0, 0], pa.int32()), "key": [key.tobytes(), key[6:].tobytes()], "count": [kneser._narrow(c).tobytes(), kneser._narrow(np.array([1, 2**33])).tobytes()]})
    rows = kneser._reduce_words(str(tmp_path), 10**12)(t).to_pylist()
    total = c + np.array([0, 0, 0, 0, 0, 0, 1, 2**33])
    assert rows[0]["total"] == int(total.sum()) and np.frombuffer(rows[1]["count"], np.uint64).tolist() == [int(total[-1])]
    kneser._save(str(tmp_path), "tri-0", kneser._keys("ctx", key) | kneser._shares("ctx", total, total - 1, np.ones(8, np.int64), np.full(8, 2**40)))
    m = kneser.Model(str(tmp_path), {"shards": 1, "split": ([], [], [])})
    assert m.look("word", "word", key, np.zeros(8, np.int32)).tolist() == total.tolist()
    assert m.look("tri", "ctx", key, np.zeros(8, np.int32)).tolist() == [[int(x), int(x) - 1, 1, 2**40] for x in total]


def test_kneser_keeps_few_maps(spark, texts, monkeypatch):
    rows = [*texts, (101, "held out words a bee")]
    model = kneser.train(frame(spark, rows), per_shard=40)
    col = pa.array([t for _, t in rows])
    want = [kneser.Model(model.folder, model.sums).score(raw, off) for _, _, raw, off in V.slices(col)]
    assert model.sums["shards"] > 8
    monkeypatch.setattr(kneser, "MOST_MAPS", 3)
    m = kneser.Model(model.folder, model.sums)
    got = [m.score(raw, off) for _, _, raw, off in V.slices(col)]
    assert all((a == b).all() for x, y in zip(want, got) for a, b in zip(x, y)) and len(m.maps) <= 3


# ---- op4

SECRETS = [
    (0, 'x password = "abcdefghijkl" y'), (1, "token: secret:abcdefghijkl"), (2, "AKIAABCDEFGHIJKLMN AKIA123"), (3, "é 0123456789abcdef0 deadbeef"),
    (4, None), (5, ""), (6, "API_KEY='Zm9vYmFyYmF6cXV4' paſſword=abcdefghijklm"), (7, "token=short token=0123456789ab"), (8, "PASSWD : 'aaaaaaaaaaaaa"),
]


def plain_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])


def test_base_spans(texts):
    for _, t in [*SECRETS, *texts]:
        assert secrets.base_spans(t) == plain_spans(t)
    assert len(secrets.base_spans(SECRETS[0][1])) == 1 and len(secrets.base_spans(SECRETS[1][1])) == 0


def test_field_decoding_is_exact_and_gradient_right():
    rng = np.random.default_rng(0)
    w, t = rng.normal(size=(secrets.SIZE, 3)) * 0.3, rng.normal(size=(3, 3)) * 0.3
    raw = np.frombuffer(("some words key = 0a1b2c3d4e5f token: 'Zm9vYmFy' end. " * 5).encode(), np.uint8)
    start, end, row, f = secrets.tokens(raw, np.array([0, 120, len(raw)]))
    tags = secrets.decode(f, row, w, t)
    for r in (0, 1):
        e = w[f[row == r]].sum(axis=1)
        assert (secrets.viterbi(e[None], t)[0] == tags[row == r]).all()
    fw, y = f[:24].reshape(2, 12, -1), rng.integers(0, 3, (2, 12))
    like, gw, gt = secrets.gradient(fw, y, w, t)
    at, eps = fw[0, 3, 0], 1e-5
    up = w.copy()
    up[at, 1] += eps
    assert (secrets.gradient(fw, y, up, t)[0] - like) / eps == pytest.approx(gw[at, 1], abs=1e-3)
    ut = t.copy()
    ut[1, 2] += eps
    assert (secrets.gradient(fw, y, w, ut)[0] - like) / eps == pytest.approx(gt[1, 2], abs=1e-3)


def test_secret_scan(spark, texts):
    rng = np.random.default_rng(5)
    hexed = lambda: "".join(rng.choice(list("0123456789abcdef"), 40).tolist())
    train = [(100 + i, "plain words here and there go on and on " * 3 + f'token = "{hexed()}" more plain words follow it now') for i in range(60)]
    docs = frame(spark, [*SECRETS, *texts, *train, (None, "token=abcdefghijkl0"), (0, SECRETS[0][1])])
    w, t = secrets.train(docs)
    got = secrets.scan(docs, w, t).collect()
    for r in got:
        assert [(s.start, s.stop) for s in r.spans if s.kind != "crf"] == [(a, b) for a, _, b in plain_spans(r.text)]
    x = secrets.tokens(np.frombuffer(train[0][1].encode(), np.uint8), np.array([0, len(train[0][1])]))
    assert (secrets.decode(x[3], x[2], w, t) > 0).any()  # the field alone finds the secret
    red = {r.doc_id: r.text for r in secrets.scan(frame(spark, SECRETS), w, t, redacted=True).collect()}
    assert red[3].startswith("é [SECRET] ")
    assert secrets.redact("abcdef", [(1, 3), (2, 4)]) == "a[SECRET]ef"
    assert secrets.scan(docs.limit(0), w, t).count() == 0


def test_field_finds_what_patterns_miss(spark, sf):
    """Secrets in forms that no base pattern knows, planted in documents of the tables; documents without any stay clean."""
    from matchloom.session import table

    docs = table(spark, sf.replace("0.001", "0.1"), "documents").select("doc_id", "text")
    w, t = secrets.train(docs)
    clean = [r.text for r in docs.orderBy("doc_id").limit(600).collect() if r.text and len(r.text.split()) > 40 and not secrets.base_spans(r.text)][:200]
    found = secrets.find(pa.array(clean), w, t)
    assert sum(map(len, found)) <= 1
    rng = np.random.default_rng(7)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    planted, places = [], []
    for i, x in enumerate(clean):
        head = x[: len(x) // 2].rpartition(" ")[0] + " " + ('credential = "', "auth: ", "bearer ", 'passphrase = "')[i % 4]
        planted.append(head + "".join(rng.choice(letters, 32).tolist()) + '" ' + x[len(x) // 2 :])
        places.append((len(head), len(head) + 32))
    assert not any(secrets.base_spans(x) for x in planted)
    hit = [any(s <= a + 1 and e >= z - 1 for s, k, e in spans if k == 3) for spans, (a, z) in zip(secrets.find(pa.array(planted), w, t), places)]
    assert np.mean(hit) > 0.95


# ---- op5


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["the", "house", "and", "tree", "walks", "of"], 40).tolist())
    bad = lambda: " ".join(x + "!!" for x in rng.choice(["BUY", "NOW", "CHEAP"], 40).tolist())
    rows = [(i, good() if i % 3 else bad()) for i in range(150)] + [(150, None), (151, ""), (None, "x")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, float(i % 3 > 0)) for i in range(100)] + [(7, None), (7, 1.0), (None, 1.0)], "doc_id long, y double")
    w = quality.train(docs, labels)
    s = {r.doc_id: r.score for r in quality.score(docs, w, ["doc_id"]).collect()}
    assert all((s[i] >= 0.5) == bool(i % 3) for i in range(100, 150)) and s[150] == s[151] and 0 <= s[150] <= 1
    assert set(r.score for r in quality.score(docs, quality.train(docs, labels.limit(0)), ["doc_id"]).collect()) == {0.5}
    assert quality.score(docs.limit(0), w, ["doc_id"]).count() == 0


def test_quality_features(texts):
    """Words are runs of one class; every feature's index depends on its words, or shapes, alone."""
    rows = [t or "" for _, t in texts] + ["ABC Abc aBC 12ab!!??", "x" * 300, "***"]
    col = pa.array(rows)
    index = {}
    for i, j, raw, off in V.slices(col):
        row, at = quality.features(raw, off)
        names, where = [], []
        tokens = [[m[0] for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|([^A-Za-z0-9\x80-\xff\x20\x09-\x0D])\1*", t.encode())] for t in rows[i:j]]
        lower = [[(b"w", x.lower()) for x in t] for t in tokens]

        def shape(x):
            up = len(re.findall(rb"[A-Z]", x))
            kind = 1 if re.match(rb"[A-Za-z\x80-\xff]", x) else 2 if x[:1].isdigit() else x[:1]
            return (b"s", kind, min(up, 2) + 3 * (up == len(x)), min(len(x), 7))

        shapes = [[shape(x) for x in t] for t in tokens]
        for source, n in ((lower, 1), (shapes, 1), (lower, 2), (shapes, 2), (shapes, 3)):
            for r, t in enumerate(source):
                for k in range(len(t) - n + 1):
                    names.append(tuple(t[k : k + n]))
                    where.append(r)
        assert row.tolist() == where
        for name, x in zip(names, at.tolist()):
            assert index.setdefault(name, x) == x
    assert len(set(index.values())) > 0.98 * len(index)


def test_ftrl_steps():
    """The learner against the published update, one coordinate at a time."""
    rng = np.random.default_rng(4)
    model = quality.Ftrl(20, alpha=0.3, beta=1.0, l1=0.02, l2=0.5)
    z, n = [0.0] * 21, [0.0] * 21
    weight = lambda i: 0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.5)
    for _ in range(200):
        at = np.unique(rng.integers(0, 21, 5))
        x, y = rng.random(len(at)), float(rng.integers(0, 2))
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, x))))
        model.update(at, x, y)
        for i, v in zip(at.tolist(), x.tolist()):
            g, w = (p - y) * v, weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * w
            n[i] += g * g
        assert model.weights(slice(None)) == pytest.approx([weight(i) for i in range(21)])


def test_quality_held_out(spark, sf):
    from matchloom.llm.queries import op5_quality
    from matchloom.session import table

    big = sf.replace("0.001", "0.1")
    got = op5_quality(spark, big).join(table(spark, big, "labels"), "doc_id").filter("held_out").select("predicted", "quality").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97


# ---- op6


def water(sizes, w):
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 200)), ["a", "b", "c", None, "é", "big"][min(i % 9, 5)]) for i in range(1500)] + [(1500, None, "a"), (1501, "", "only empty"), (3, "w w", "a"), (3, "w w", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, block=100, groups=4).toPandas()
    again = mixing.mix(docs.repartition(7), block=100, groups=4).toPandas()
    key = lambda d: sorted(zip(d.doc_id, d["size"], d.taken))
    assert key(got) == key(again) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    for s, g in got.groupby(got.source.fillna("NULL")):
        s = None if s == "NULL" else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= 0.01 * want[s] + 2
    assert (got.taken <= 3 * got["size"]).all() and got.target.groupby(got.source.fillna("NULL")).first().sum() == pytest.approx(sum(sizes.values()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_equal_rows(spark):
    rows = spark.range(9000).selectExpr("CAST(NULL AS LONG) doc_id", "'w w w' text", "CAST(NULL AS STRING) source").union(spark.range(300).selectExpr("id", "repeat('w ', 1 + CAST(id AS INT) % 7)", "'a'")).union(spark.range(5).selectExpr("7L", "'w w'", "'a'"))
    got = mixing.mix(rows, block=64, groups=4).toPandas()
    assert len(got) == 9305 and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"] == 0).all()
    for _, g in got.groupby(got.source.fillna("NULL")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 7
    again = mixing.mix(rows.repartition(5), block=64, groups=4).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d["size"], d.taken))
    assert key(got) == key(again)


def test_landing_is_the_nearest_choice():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 9):
        p, size = rng.random(n) * 0.98 + 0.01, rng.integers(1, 50, n).astype(float)
        got = mixing.land(np.concatenate([p, [0.0, 1.0]]), np.concatenate([size, [5.0, 6.0]]))
        want, docs = (p * size).sum(), p.sum()
        cost = lambda x: abs(x @ size - want) + 0.05 * size.mean() * abs(x.sum() - docs) if n else 0.0
        best = min(cost(np.array([i >> j & 1 for j in range(n)], float)) for i in range(1 << n))
        assert got[n:].tolist() == [0.0, 1.0] and cost(got[:n]) == pytest.approx(best)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    pi, size = rng.random(200), rng.integers(1, 99, 200).astype(float)
    p = mixing.flight(pi, np.stack([size * pi, pi]), np.random.default_rng(1))
    assert (p * size).sum() == pytest.approx((pi * size).sum()) and p.sum() == pytest.approx(pi.sum())
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2


# ---- op7


def plain_fingerprint(t):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(t)]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(texts):
    for _, t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_anchor_covering():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 32, 500).astype(np.uint32)
    assert len(set(simhash.tables()["golay"].tolist())) == 2048
    g = x & np.uint32((1 << 23) - 1)
    assert np.bitwise_count(g ^ simhash.golay_home(g)).max() <= 3
    for b in range(32):
        at, anchor = simhash.reached(x ^ np.uint32(1 << b))
        assert {(i, a) for i, a in enumerate(simhash.home(x).tolist())} <= set(zip(at.tolist(), anchor.tolist()))


@pytest.mark.parametrize("most", [4, 4096])
def test_links_and_components(spark, most):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 30)
    fp = np.unique(np.concatenate([base] + [base ^ sum((np.int64(1) << rng.integers(0, 63, 30)) for _ in range(n)) for n in (1, 2, 3, 3, 4, 5)] + [base[:1] ^ (np.int64(1) << np.arange(63))]))
    df = spark.createDataFrame([(int(f),) for f in fp], "fp long")
    edges = simhash.links(df, most)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    lab = np.arange(len(fp))
    while True:
        new = np.array([lab[n].min() for n in near])
        if (new == lab).all():
            break
        lab = new
    groups = lambda names: {frozenset(np.flatnonzero(names == n).tolist()) for n in set(names.tolist())}
    assert groups(np.array([got.get(int(f), int(f)) for f in fp])) == groups(lab)


def test_near_duplicates_rows(spark, texts):
    rows = [*texts, (None, texts[7][1]), (85, texts[7][1])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    c = {r.doc_id: r.component_id for r in got}
    assert c[85] == c[7] == c[None] <= 7 and c[80] == c[81] == c[82]
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


# ---- op8


def plain_url(u):
    u = u or ""
    if "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(h, p):
    best = None
    for rule, verdict in URL_RULES:
        rh, rp = rule.split("/", 1)
        if (h == rh or h.endswith("." + rh)) and p.startswith("/" + rp) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def test_urls(spark):
    u = ["http://A.Example.ORG/en/12?x", "https://x.org", "https://org/", "no scheme", None, "", "x://É.com/de/1#f", "http://a.com/fr/\n2", "http://b.example.org/es/", "http://xorg/", "a://b://c.org/p", "http://h.net?q=/x", "http://example.org/en/2"]
    u += [f"http://m.com/{s}/{i}" for i in range(40) for s in ("fr", "de", "xx")] + [f"http://wide.net/{i}abc{'x' * i}/p" for i in range(40)]
    df = spark.createDataFrame([(i, x, "z", "z") for i, x in enumerate([*u, u[0]])], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in urls.judge(df, URL_RULES).collect()}
    assert len(got) == len(u) + 1
    for i, x in enumerate(u):
        h, p = plain_url(x)
        rule, verdict = plain_rule(h, p)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, rule) and got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def brute_judge(urls_, rules, most_children=24, z=1.96, overlap=0.5, weight=8.0, reject_at=0.5):
    """(verdict, template, purity) of every url by plain loops."""

    def kind(x):
        x = re.sub(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{date}", x)
        x = re.sub(r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "{uuid}", x)
        x = re.sub(r"(?a:\b)(?=[0-9a-f]*[0-9])[0-9a-f]{12,}", "{hex}", x)
        return re.sub("[0-9]+", "{n}", x)

    rows, seen = {}, []
    for u in urls_:
        h, p = plain_url(u)
        _, ruled = plain_rule(h, p) if rules is URL_RULES else (None, None)
        kinds = tuple(kind(x) for x in re.sub("^/", "", p).split("/"))
        seen.append((h, kinds, ruled))
        row = rows.setdefault((h, kinds), [list(kinds), 0, 0])
        row[1] += ruled is not None
        row[2] += ruled == "block"
    level = 0
    while True:
        rests, kids = {}, {}
        for (h, _), (segs, _, _) in rows.items():
            if len(segs) > level:
                rests.setdefault((h, *segs[:level]), set()).add(tuple(segs[level:]))
                kids.setdefault((h, *segs[:level]), set()).add(segs[level])
        if not any(len(x) > most_children for x in rests.values()):
            break
        for (h, _), row in rows.items():
            node = (h, *row[0][:level])
            if len(row[0]) > level and len(kids[node]) > most_children:
                row[0] = [*row[0][:level], "*", *row[0][level + 1 :]]
        level += 1

    def share(found, prior):
        return (sum(r[2] for r in found) + weight * prior) / (sum(r[1] for r in found) + weight)

    whole = share(rows.values(), 0.5)
    out = {}
    for host in {h for h, _ in rows}:
        own = [r for (h, _), r in rows.items() if h == host]
        p_host = share(own, whole)
        nodes = {}
        for r in own:
            for i in range(len(r[0])):
                nodes.setdefault(tuple(r[0][:i]), {}).setdefault(r[0][i], []).append(r)
        group = {}  # (node above, branch): rows of the merged branch
        for above, branches in nodes.items():
            order = sorted((share(b, p_host), n) for n, b in branches.items())
            groups = []
            for i, (p, n) in enumerate(order):
                size = sum(r[1] for r in branches[n]) + weight
                leads = {r[0][len(above) + 1] if len(r[0]) > len(above) + 1 else "" for r in branches[n]}
                if i:
                    q, m, was = last
                    mean = (p * size + q * m) / (size + m)
                    same = abs(p - q) <= z * math.sqrt(mean * (1 - mean) * (1 / size + 1 / m)) and len(leads & was) / len(leads | was) >= overlap
                if not i or not same:
                    groups.append([])
                groups[-1].append(n)
                last = (p, size, leads)
            if len(branches) > 1:
                for names in groups:
                    for n in names:
                        group[(*above, n)] = [r for m in names for r in branches[m]]
        templates = {}
        for r in own:
            templates.setdefault("/".join(r[0]), []).append(r)
        for t, found in templates.items():
            p = p_host
            for i in range(len(found[0][0])):
                if tuple(found[0][0][: i + 1]) in group:
                    p = share(group[tuple(found[0][0][: i + 1])], p)
            out[host, t] = share(found, p)
    answers = []
    for h, kinds, ruled in seen:
        t = "/".join(rows[h, kinds][0])
        answers.append((ruled or ("block" if out[h, t] >= reject_at else "allow"), t, out[h, t]))
    return answers


def test_urls_against_brute_force(spark, sf):
    from matchloom.session import table

    rng = np.random.default_rng(12)
    u = [r.url for r in table(spark, sf.replace("0.001", "0.1"), "pages").select("url").collect()]
    u += [f"http://shop.com/{a}/{b}/{c}" for a in ("de", "fr", "it", "us", "uk") for b in ("new", "old", "x1") for c in rng.integers(0, 30, 6)]
    u += [f"http://a.com/{x}/p{i}/{'abcdefghijklmnopqrstuvwxyzABCDEFGH'[i]}" for x in ("de", "fr", "dex", "frx", "en") for i in range(30)] + [f"http://q.org/{i:013x}/2020-01-02/z" for i in range(5)] + [None, "", "x", "http://a.com", "http://a.com/"]
    got = urls.judge(spark.createDataFrame(list(enumerate(u)), "page_id long, url string"), URL_RULES).orderBy("page_id").collect()
    want = brute_judge(u, URL_RULES)
    assert len(got) == len(u)
    for r, (verdict, template, purity) in zip(got, want):
        assert (r.verdict, r.template) == (verdict, template) and r.purity == pytest.approx(purity, abs=1e-8)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_urls_deep_branches(spark):
    long = "/".join("abcdefgh"[i % 8] for i in range(60))
    u = [f"http://w{i // 10}.net/{x}/b/c/d/{e}/{i % 10}x" for i in range(30) for x in "pq" for e in ("good", "bad")]
    u += [f"http://v.net/a/b/c/d/e/{'abcdefghijklmnopqrstuvwxyz'[i // 10]}{'abcdefghij'[i % 10]}/f" for i in range(40)] + [f"http://v.net/{long}", "http://v.net/a/b/c"]
    got = {r.path: r for r in urls.judge(spark.createDataFrame(list(enumerate(u)), "page_id long, url string"), [(f"w{i}.net/p/b/c/d/bad", "block") for i in range(3)] + [(f"w{i}.net/p/b/c/d/good", "allow") for i in range(3)]).collect()}
    assert got["/p/b/c/d/bad/1x"].template == "p/b/c/d/bad/{n}x" and got["/p/b/c/d/good/1x"].template == "p/b/c/d/good/{n}x"
    assert got["/p/b/c/d/bad/1x"].purity > 0.5 > got["/p/b/c/d/good/1x"].purity
    assert {r.template for p, r in got.items() if p.endswith("/f")} == {"a/b/c/d/e/*/f"}
    assert got["/a/b/c"].template == "a/b/c" and got[f"/{long}"].template == long.replace("a/b/c/d/e/f/", "a/b/c/d/e/*/", 1)


def test_urls_long_paths_take_few_rounds(spark, monkeypatch):
    """1,000 shared segments, 1,000 levels that all differ, and both in turn: as one by one, in a few tables."""
    shared = "/".join(f"s{'abcdefghij'[i % 10]}" for i in range(1000))
    names = ["".join(x) for x in zip("abcdefghijklmnopqrstuvwxyzabcd", "zyxwvutsrqponmlkjihgfedcbazyxw")]
    u = [f"http://long.net/{shared}/{x}" for x in names] + [f"http://wild.net/{'/'.join(names[(i + j * (1 + i % 7)) % 30] + 'qrstuvw'[j % 7] for j in range(1000))}" for i in range(30)]
    u += [f"http://both.net/{'/'.join(x if j % 2 else 'k' for j in range(200))}" for x in names]
    made = []
    plain = urls.S.stash
    monkeypatch.setattr(urls.S, "stash", lambda df, name: made.append(name) or plain(df, name))
    got = urls.judge(spark.createDataFrame(list(enumerate(u)), "page_id long, url string"), []).orderBy("page_id").collect()
    assert len(made) <= 12
    assert [r.template for r in got] == [t for _, t, _ in brute_judge(u, [])]
    assert {r.template for r in got if r.host == "long.net"} == {f"{shared}/*"} and {r.template.count("*") for r in got if r.host == "both.net"} == {100}


def test_urls_branches_merge_below_the_first_level(spark):
    """Siblings on the third level: two of one share learn from each other, a third of another share does not."""
    ends = "abcdefgh"
    u = [f"http://n.net/x/y/{b}/{e}" for b in ("bad1x", "bad2x", "goodx") for e in ends]
    rules = [(f"n.net/x/y/{b}/{e}", "block" if b.startswith("bad") else "allow") for b in ("bad1x", "goodx") for e in ends] + [("n.net/x/y/bad2x/a", "block")]
    got = {r.path: r for r in urls.judge(spark.createDataFrame(list(enumerate(u)), "page_id long, url string"), rules).collect()}
    alone = {r.path: r for r in urls.judge(spark.createDataFrame(list(enumerate(u)), "page_id long, url string"), rules, z=-1.0).collect()}
    assert got["/x/y/bad2x/h"].rule is None and got["/x/y/bad2x/h"].purity > alone["/x/y/bad2x/h"].purity + 0.05


# ---- op9


def test_tiling():
    v = lambda s: np.array([zlib.crc32(x.encode()) for x in s.split()], dtype=np.uint64)
    a = "a b c d e f g h i j"
    assert decontam.tile(v(a), v("x " + a + " y")) == [(0, 1, 10)]
    assert sorted(decontam.tile(v(a), v("f g h i j z a b c d e"))) == [(0, 6, 5), (5, 0, 5)]
    assert decontam.tile(v(a), v("a b c d x e f g h")) == []
    assert sum(t[2] for t in decontam.tile(v("a a a a a a a a a a"), v("a a a a a"))) == 5


def brute_tiles(item, doc, shortest=5):
    """Marked words of an item by greedy string tiling, in plain loops over word lists."""
    shortest = min(shortest, len(item))
    fi, fd, n = [True] * len(item), [True] * len(doc), min(len(item), len(doc))
    while n >= shortest:
        for p in range(len(item) - n + 1):
            for q in range(len(doc) - n + 1):
                if all(fi[p : p + n]) and all(fd[q : q + n]) and item[p : p + n] == doc[q : q + n]:
                    fi[p : p + n], fd[q : q + n] = [False] * n, [False] * n
        n -= 1
    return fi.count(False)


def test_decontam_against_brute_force(spark):
    rng = np.random.default_rng(13)
    vocab = np.array("a b c d e f g h".split())
    items = [rng.choice(vocab, n).tolist() for n in (3, 5, 8, 12, 20, 30)]
    docs = []
    for i in range(120):
        item = items[i % 6]
        cuts = sorted(rng.integers(0, len(item) + 1, 2).tolist())
        pieces = [item[: cuts[0]], item[cuts[0] : cuts[1]], item[cuts[1] :]]
        rng.shuffle(pieces := [x for x in pieces])
        docs.append(" ".join(sum(([*rng.choice(vocab, int(rng.integers(0, 4))).tolist(), *x] for x in pieces), [])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("coverage", F.lit("x"))
    hits = 0
    for r in decontam.scan(df, bench).collect():
        share = [brute_tiles(x, docs[r.doc_id].split()) / len(x) for x in items]
        assert r["items"] == [i for i, s in enumerate(share) if s >= 0.8 - 1e-9]
        assert r.coverage == pytest.approx(max((s for s in share if s >= 0.8 - 1e-9), default=0.0))
        hits += len(r["items"])
    assert 20 < hits < 600


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_decontam(spark, texts, size):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (2, "Un petit item"), (3, None), (4, ""), (5, item), (1, item), (6, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"), *((i, f"filler {i} " * 9) for i in range(10, 30))], "item_id long, text string")
    rows = [*texts, (200, f"pre {item.upper()} post"), (201, "six seven eight nine ten x one two three four five"), (202, "one two three four five six seven"), (203, "say un PETIT item"), (204, "q1 q2 q3 q4 q5 q6 q7 q8 x q9 q10"), (205, None)]
    got = {r.doc_id: r for r in decontam.scan(frame(spark, rows), bench, block_bytes=size).collect()}
    assert len(got) == len(rows) and all(not got[i]["items"] for i, _ in texts if i is not None)
    assert got[200]["items"] == [1, 5] and got[201]["items"] == [1, 5] and got[201].coverage == 1.0
    assert not got[202]["items"] and got[203]["items"] == [2] and got[204]["items"] == [6] and got[204].coverage == pytest.approx(0.8)
    assert decontam.scan(frame(spark, rows), bench.limit(0)).filter("coverage > 0").count() == 0


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_decontam_findings_are_per_row(spark, size):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (2, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"), *((i, f"filler {i} " * 9) for i in range(10, 30))], "item_id long, text string")
    rows = [(None, f"a {item} b"), (None, "clean"), (None, None), (None, f"a {item} b"), (7, f"c {item}"), (7, "clean too"), (7, None), (8, f"{item} q1 q2 q3 q4 q5 q6 q7 q8 x q9 q10")]
    got = decontam.scan(frame(spark, rows), bench, block_bytes=size)
    assert sorted((str(r.doc_id), str(r.text), r["items"], r.coverage) for r in got.collect()) == sorted((str(i), str(t), [x for x, p in ((1, item), (2, "q1")) if p in (t or "")], float(item in (t or ""))) for i, t in rows)
    assert "hash" in got.columns


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_decontam_scans_items_without_id(spark, size):
    a, b, c = (" ".join(f"{x}{i}" for i in range(10)) for x in "abc")
    bench = spark.createDataFrame([(None, a), (None, b), (3, c), (None, None), (None, ""), *((None, f"filler {i} " * 9) for i in range(20))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.scan(frame(spark, [(1, a), (2, f"{c} {b} {a}"), (3, c), (4, "clean"), (None, b)]), bench, block_bytes=size).collect()}
    assert [got[i]["items"] for i in (1, 2, 3, 4, None)] == [[None], [3, None], [3], [], [None]]
    assert [got[i].coverage for i in (1, 2, 3, 4, None)] == [1.0, 1.0, 1.0, 0.0, 1.0]


# ---- op10


@pytest.mark.parametrize("block", [16, 8192])
def test_topk(spark, block):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [(400, None), (450, [1.0, None] * 4), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [0.5, 0.25]), (650, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, x int")
    v = topk.scaled(df)
    got = {}
    for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), 5, pivots=12, block=block, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    ok = {i: np.pad(np.floor(256 * np.array(x, dtype=float)).astype(int), (0, 8 - len(x))) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)}
    for q in (i for i in ok if i % 50 == 0):
        want = sorted(((-int(ok[q] @ ok[i]), i) for i in ok if i != q))[:5]
        assert got[q] == [(-s, i) for s, i in want]
    assert set(got) == {i for i in ok if i % 50 == 0}
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    few = v.filter("vec_id < 2 OR vec_id = 50")
    assert topk.top_k(few, few.filter("vec_id % 50 = 0"), 5).count() == 4


def test_topk_ranges(spark):
    """Scores up to 64 bits are exact; components whose products could pass them are an error."""
    ddl = "vec_id long, embedding array<double>"
    big = [3e6, -2999999.5, 2.5e6, 1.0]
    df = spark.createDataFrame([(i, [big[i % 4] * (1 if j % 3 else -1) for j in range(3)]) for i in range(8)], ddl)
    v = topk.scaled(df)
    x = {r.vec_id: [int(c) for c in r.x] for r in v.collect()}
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id = 0"), 3).orderBy("rank").collect()]
    want = sorted(((-sum(a * b for a, b in zip(x[0], x[i])), i) for i in x if i))[:3]
    assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(want)]
    for bad in (3e15, 1e13):
        v = topk.scaled(spark.createDataFrame([(0, [bad, 1.0]), (1, [1.0, 1.0])], ddl))
        with pytest.raises(ValueError, match="too large"):
            topk.top_k(v, v.filter("vec_id = 0"), 3)
    with pytest.raises(Exception, match="too large"):
        topk.scaled(spark.createDataFrame([(0, [1e20])], ddl)).collect()


def test_topk_leaves_groups_out(spark):
    """On clustered data most groups are never visited, and the answer is still that of all pairs."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = np.floor(256 * (centres[np.arange(4000) % 40] + 0.05 * rng.normal(size=(4000, 16)))).astype(int)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<long>")
    cells, placed, dim = topk.voronoi(v, 5, None, 4096, 200)
    queries = x[::50].astype(float)
    groups = len(set(cells.group[cells.size > 0].tolist()))
    assert groups > 15 and len(cells.visits(queries)[0]) < 0.35 * groups * len(queries)
    got = {}
    for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), 5, block=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    s = x[::50] @ x.T
    for q in range(80):
        want = sorted((-int(c), i) for i, c in enumerate(s[q]) if i != 50 * q)[:5]
        assert got[50 * q] == want


# ---- the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as C
    from matchloom.session import table

    docs = table(spark, sf, "documents")
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == C.COLUMNS, name
        now = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(now) <= set(kept) and len(now) == len(set(now))
        docs, kept = out, now
    for r in docs.collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
    final = pipeline(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(kept)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, items int, component_id string, fp string, taken int, y double, hash string"


def hostile_documents():
    """Nulls in every column, repeated rows and ids, empty and very long texts."""
    rows = [(1, "plain words here", "en", "a", 16), (1, "plain words here", "en", "a", 16), (2, None, None, None, None), (None, "no id at all in this row", "en", "b", 24), (None, None, None, None, None), (3, "", "", "", 0)]
    rows += [(4, " \n\t", "de", "b", 3), (5, "long " * 60_000, "en", "a", 300_000), (6, "x" * 200_000, "en", None, 200_000), (2, "another text of the same id", "fr", "a", 27), (7, 'token = "abcdefghijklmnop" é', "en", "a", 28), (9, "Plain WORDS here", "en", "c", 16)]
    return [(*r, 0.1, "s", 1, "c", "f", 2, 0.5, "h") for r in rows]


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stage_on_hostile_rows(spark, sf, at):
    import corpus_pipeline as C

    rows = hostile_documents()
    docs, stage = spark.createDataFrame(rows, CLASH), C.STAGES[at][1]
    got = [tuple(r) for r in stage(spark, docs, sf).collect()]
    empty = stage(spark, docs.limit(0), sf)
    assert empty.count() == 0 and (at == 4 or empty.columns == C.COLUMNS)
    short = [r[:5] for r in rows]
    if at == 4:
        assert sorted((str(r[0]) for r in got)) == sorted(str(r[0]) for r in short)
    elif at == 3:
        assert Counter(r for r in got if r[0] != 7) == Counter(r for r in short if r[0] != 7)
        assert [r[1] for r in got if r[0] == 7][0].endswith("é") and "abcdefghijklmnop" not in [r[1] for r in got if r[0] == 7][0]
    elif at == 2:
        assert Counter(got) == Counter(short)  # none of these leaks a benchmark item
    elif at == 1:
        # rows of one id and text count once; both texts of id 2 stay, and both rows without an id
        assert sorted((r[0] for r in got if r[0] is not None)) == [1, 2, 2, 5, 6, 7] and sum(r[0] is None for r in got) == 2
        assert {r[1] for r in got if r[0] == 2} == {None, "another text of the same id"}
    else:
        assert not Counter(got) - Counter(short)


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as C
    from matchloom.session import table

    docs = table(spark, sf, "documents")
    pick = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        out[name] = {r.doc_id: r.text for r in docs.collect()}
    marked = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.quality is not None and r.doc_id in pick}
    assert sum((i in out["quality"]) == bool(q) for i, q in marked.items()) >= 0.97 * len(marked)
    # near-duplicates: all pairs of fingerprints
    ids = sorted(out["quality"])
    fp = np.array([plain_fingerprint(out["quality"][i]) for i in ids], dtype=np.uint64)
    lab, near = np.arange(len(ids)), np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    while True:
        new = np.array([lab[n].min() for n in near])
        if (new == lab).all():
            break
        lab = new
    assert set(out["simhash"]) == {ids[i] for i in set(lab.tolist())}
    # benchmark items: tiles of every pair of item and document
    v = lambda t: np.array([zlib.crc32("".join(c.lower() if "A" <= c <= "Z" else c for c in x).encode()) for x in words(t)], dtype=np.uint64)
    items = [x for x in (v(r.text) for r in table(spark, sf, "benchmark").collect()) if len(x) >= 5]
    leaks = set()
    for i, t in out["simhash"].items():
        d = v(t)
        if any(np.isin(x, d).mean() >= 0.8 and sum(n for *_, n in decontam.tile(x, d)) >= 0.8 * len(x) for x in items):
            leaks.add(i)
    assert set(out["decontaminate"]) == set(out["simhash"]) - leaks
    # secrets: only spans change, and every base span does
    assert set(out["secrets"]) == set(out["decontaminate"])
    for i, t in out["secrets"].items():
        old, at = out["decontaminate"][i] or "", 0
        pieces = (t or "").split("[SECRET]")
        for x in pieces:
            at = old.index(x, at) + len(x)
        assert (len(pieces) > 1) >= bool(plain_spans(old)) and not plain_spans(t)
        if len(pieces) == 1:
            assert t == out["decontaminate"][i]
