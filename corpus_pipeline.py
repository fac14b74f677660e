"""From raw documents to token ids: five stages of corpus operators.

Each stage takes (spark, docs, sf_dir), where docs are the documents that its predecessor kept, and
returns a frame that is written as Parquet and reread for the next. All but the last return the
columns of ``documents``. A null, empty or very long text passes like any other; an empty table
gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.llm import bpe, decontaminate, neardup, pii, toxicity
from dayrank.llm.catalog import PII_KEY, VOCABULARY
from dayrank.llm.common import lookup, read, sha256_text
from dayrank.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    changed = F.coalesce(F.length("text").cast("long"), F.when(F.col("n_chars").isNotNull(), F.lit(0).cast("long")))
    return docs.withColumn("n_chars", changed).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, by a model learned from the labelled ones."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), held_out=None)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    scored = model.score(docs.select(*COLUMNS), "doc_id", "text", "text", *rest)
    return scored.filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of documents whose sets of
    five-word shingles are similar by 0.8 or more. Of rows with that id one stays, by text."""
    docs = docs.select(*COLUMNS)
    found = materialize(neardup.near_duplicates(docs), "components")
    known = found.filter("doc_id IS NOT NULL")
    gone = lookup(known.filter("NOT kept").select("doc_id").distinct(), neardup.BROADCAST_IDS)
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = lookup(materialize(repeated.select("doc_id"), "repeated"), neardup.BROADCAST_IDS)
    kept = docs.join(gone, "doc_id", "left_anti")
    first = (
        kept.join(repeated, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        .select("doc_id", "row.*")
    )
    return kept.join(repeated, "doc_id", "left_anti").unionByName(first).select(*COLUMNS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that mostly consist of them go."""
    return _documents(decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return _documents(pii.pseudonymise(docs.select(*COLUMNS), PII_KEY))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the text they decode to."""
    vocabulary = bpe.shared_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode_and_decode(docs, vocabulary, public_tokenizers.PATTERN).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmarks),
    ("pii", pseudonymise),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it kept."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
