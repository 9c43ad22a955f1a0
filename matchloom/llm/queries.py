"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import chat, codes, decontam, kneser, mixing, packing, phrases, quality, secrets, simhash, stash, substrings, topk, urls

#: The url rules of op8.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
PROBE = "<|im_end|><|im_start|>assistant ok"


def start(spark: SparkSession) -> None:
    ship(spark)
    stash.prepare(spark)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    turns = rows.union(probe).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    done = chat.format_chat(turns).withColumn("read", chat.read_back(F.col("formatted")))
    learned = chat.learned_text(F.col("read"), F.col("loss_mask"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.select("conv_id", "formatted", "read", learned.alias("learned"), said.alias("said"), "attachments", "expanded_tokens")
    return done.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    done = substrings.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM win),
f AS (SELECT k, min(doc_id) AS lo FROM h GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM h JOIN f USING (k) WHERE lo < doc_id),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""


def op3_kneser(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", quality.fold(F.col("doc_id"), 5, 1))
    model = kneser.train(docs.filter("NOT held_out"))
    done = kneser.score(docs, model, ["doc_id", "held_out"])
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = secrets.scan(docs, *secrets.train(docs)).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return done.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def quality_labels(spark: SparkSession, sf_dir: str, held: bool = True) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return labels.filter(~quality.fold(F.col("doc_id"), 3, 1)) if held else labels


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, quality_labels(spark, sf_dir))
    done = quality.score(docs, weights, ["doc_id"])
    return done.select("doc_id", quality.fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    done = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    done = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return done.select("page_id", "host", "path", "rule", "verdict")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    done = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.round("coverage", 9).alias("coverage"), "items")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    vectors = topk.scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.train(vectors)
    done = stash.stash(codes.encode(vectors, books, ["vec_id", "label"]), "codes")
    done = codes.with_group_error(done, "label", "label_error")
    return done.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """Rounds written out: a{r} assigns the parts y to the books b{r}, b{r + 1} is made of them."""
    assign = lambda r: f"""a{r} AS MATERIALIZED (SELECT q.rid, q.p, min(list_sum(list_transform(range(1, len(q.y) + 1), lambda i: (q.y[i] - b.y[i]) * (q.y[i] - b.y[i])))::HUGEINT * 256 + b.e) AS m
  FROM q JOIN b{r} b ON q.p = b.p GROUP BY q.rid, q.p)"""  # noqa: E731
    update = lambda r: f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.y, b.y) AS y FROM b{r} b LEFT JOIN (
    SELECT p, e, list(CASE WHEN s >= 0 THEN s // c ELSE -((c - 1 - s) // c) END::BIGINT ORDER BY i) AS y FROM (
      SELECT p, e, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS c FROM (
        SELECT q.p, a.m % 256 AS e, unnest(q.y) AS y, unnest(range(len(q.y))) AS i FROM q JOIN a{r} a ON q.rid = a.rid AND q.p = a.p) GROUP BY p, e, i) GROUP BY p, e) n
    ON b.p = n.p AND b.e = n.e)"""  # noqa: E731
    rounds = ",\n".join(f"{assign(r)},\n{update(r)}" for r in range(codes.ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT rid, p, x[p * len(x) // {codes.PARTS} + 1:(p + 1) * len(x) // {codes.PARTS}] AS y FROM v, (SELECT unnest(range({codes.PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, y FROM q WHERE rid <= {codes.ENTRIES}),
{rounds},
{assign(codes.ROUNDS)},
c AS (SELECT rid, string_agg(printf('%02x', (m % 256)::BIGINT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{codes.ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), h
"""


OP11_SQL = _op11_sql()


def op12_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: path of its JSON file, on the driver."""
    import public_tokenizers

    start(spark)
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        done = packing.pack_documents(table(spark, sf_dir, "documents"), f.read())
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    return phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, len, array_to_string(ws[i:i + len - 1], ' ') AS phrase FROM (
  SELECT lang, ws, len, unnest(range(1, len(ws) - len + 2)) AS i FROM w, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS len) WHERE len(ws) >= len)),
f AS MATERIALIZED (SELECT lang, len, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {phrases.SUPPORT}),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
k AS (SELECT lang, len, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, len)) AS k FROM f WHERE len > 1),
s AS (SELECT k.lang, k.phrase, k.len, k.a, k.k, x.a AS l, y.a AS r, ({phrases.UNIT} * k.a::HUGEINT // (x.a + y.a))::BIGINT AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
c AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (
    SELECT lang, a, len, ws, b, unnest(range(1, len - b + 2)) AS i FROM (SELECT lang, a, len, string_split(phrase, ' ') AS ws, unnest(range(2, len)) AS b FROM c WHERE len > 2)) o
  ON o.lang = c.lang AND c.len = o.b AND c.phrase = array_to_string(o.ws[o.i:o.i + o.b - 1], ' ') WHERE 100 * o.a::HUGEINT >= {phrases.INSIDE} * c.a::HUGEINT),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c WHERE NOT EXISTS (FROM u WHERE u.lang = c.lang AND u.phrase = c.phrase))
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN t ON r.lang = t.lang WHERE rank <= {phrases.FIRST}
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_chat": op1_chat, "op2_substrings": op2_substrings, "op3_kneser": op3_kneser, "op4_secrets": op4_secrets, "op5_quality": op5_quality,
        "op6_mixing": op6_mixing, "op7_simhash": op7_simhash, "op8_urls": op8_urls, "op9_decontam": op9_decontam, "op10_topk": op10_topk,
        "op11_codes": op11_codes, "op12_packing": op12_packing, "op13_phrases": op13_phrases, "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op2_substrings": OP2_SQL, "op10_topk": OP10_SQL, "op11_codes": OP11_SQL, "op13_phrases": OP13_SQL}
