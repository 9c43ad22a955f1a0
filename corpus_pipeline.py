"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, source mix.

Each stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontam, mixing, quality, secrets, simhash, stash
from matchloom.llm.queries import quality_labels, start
from matchloom.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; empty texts are scored like all others."""
    start(spark)
    docs = docs.select(COLUMNS)
    weights = quality.train(docs, quality_labels(spark, sf_dir, held=False))
    scored = quality.score(docs, weights, COLUMNS)
    return scored.filter("score >= 0.5").select(COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate component.

    Rows that repeat an id and its text count once. Different texts under one id
    all stay if one of them is kept, and so does each row without an id.
    """
    start(spark)
    docs = docs.select(COLUMNS)
    found = simhash.near_duplicates(docs)
    keep = stash.stash(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows")), "kept")
    kept = docs.filter("doc_id IS NOT NULL").join(keep, "doc_id")
    if keep.filter("_rows > 1").isEmpty():
        kept = kept.select(COLUMNS)
    else:
        again = kept.filter("_rows > 1").select(COLUMNS).dropDuplicates(["doc_id", "text"])
        kept = kept.filter("_rows = 1").select(COLUMNS).union(again)
    return kept.union(docs.filter("doc_id IS NULL"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by 0.8 or more."""
    start(spark)
    scanned = decontam.scan(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return scanned.filter("size(items) = 0").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by [SECRET]; n_chars follows the text."""
    start(spark)
    docs = docs.select(COLUMNS)
    scanned = secrets.scan(docs, *secrets.train(docs), redacted=True)
    size = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return scanned.select("doc_id", "text", "lang", "source", size)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    start(spark)
    return mixing.mix(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality", keep_quality),
    ("simhash", keep_one_of_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: The stages train models and draw samples, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    What a stage made for itself goes when its result is written, and its input with it; the input and the tables of the last stage stay for the result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, last = stash.made(spark), docs
        docs = stash.stash(stage(spark, docs, sf_dir), "pipeline")
        stash.drop_since(spark, before, docs)
        stash.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
