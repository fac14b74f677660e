"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrank.llm import (
    bpe,
    centroids,
    decontaminate,
    forest,
    licenses,
    neardup,
    pii,
    quality,
    secret_scan,
    spelling,
    tool_calls,
    toxicity,
    warc,
)
from dayrank.llm.common import read, sha256_text
from dayrank.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]

#: A run of its own would take a secret here.
PII_KEY = "dayrank"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


#: The tool that the turns of ``conversations`` are taken to call.
REPLY = {
    "reply": {
        "type": "object",
        "required": ["prompt", "max_words", "style"],
        "additionalProperties": False,
        "properties": {
            "prompt": {"type": "string", "minLength": 20},
            "max_words": {"type": "integer", "minimum": 1, "maximum": 390},
            "style": {"enum": ["short", "long"]},
        },
    }
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The table has no tool calls, so each user turn stands for one: a call for a reply to its
    text, needing the call two turns before. Each assistant turn is the result of the call one turn
    before. Other turns stay as they are."""
    turn, text = F.col("turn"), F.col("text")
    words = F.size(F.split(text, " ")).cast("long")
    call = F.struct(
        F.concat(F.lit("c"), turn.cast("string")).alias("id"),
        F.lit("reply").alias("name"),
        F.struct(
            text.alias("prompt"),
            (words * 7 % 400).alias("max_words"),
            F.when(words % 3 == 0, "short").otherwise("long").alias("style"),
        ).alias("arguments"),
        F.when(turn >= 2, F.concat(F.lit("c"), (turn - 2).cast("string"))).alias("after"),
    )
    result = F.struct(F.concat(F.lit("c"), (turn - 1).cast("string")).alias("tool_call_id"), text.alias("content"))
    made = (
        F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls"))))
        .when(F.col("role") == "assistant", F.to_json(result))
        .otherwise(text)
    )
    return conversations.select("conv_id", "turn", made.alias("text"))


def op1_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """All calls of all conversations, linked, ordered, validated, as canonical JSON."""
    return tool_calls.link(tool_messages(read(spark, folder, "conversations")), REPLY)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document, learned from labels outside the held-out fold."""
    docs = read(spark, folder, "documents")
    model = toxicity.fit(docs, read(spark, folder, "labels"))
    held_out = F.coalesce(toxicity.fold() == toxicity.HELD_OUT, F.lit(False))
    return model.score(docs).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with personal data replaced, and the kinds replaced."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, kinds_col="kinds").select(
        "doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds")
    )


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence templates found in every document."""
    best = F.array_max(F.transform("licenses", lambda s: s["dice"]))
    return licenses.scan(read(spark, folder, "documents")).select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda s: s["template"]), ",").alias("licenses"),
        F.coalesce(best, F.lit(0.0)).alias("best_dice"),
    )


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as counts and digests."""
    vocabulary = bpe.shared_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    pattern = public_tokenizers.PATTERN
    encoded = bpe.encode(read(spark, folder, "documents"), vocabulary, pattern)
    return bpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document under windows of benchmark items."""
    found = decontaminate.scan(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"]).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256_text(F.array_join("items", ",")).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document. A source stands in for an owner, its part in one language for a
    repository. Spans judged live are listed a second time under that name."""
    docs = read(spark, folder, "documents").select(
        "doc_id",
        "text",
        "source",
        F.when(F.col("source").isNotNull(), F.concat_ws("/", "source", "lang")).alias("repository"),
    )
    found = secret_scan.scan(docs, repository_col="repository")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    live = F.transform(
        F.filter("spans", lambda s: s["verdict"] == "live"),
        lambda s: F.struct(s["start"], F.lit(9).alias("kind_order"), s["end"], F.lit("live").alias("kind")),
    )
    plain = F.transform(
        "spans", lambda s: F.struct(s["start"], s["kind_order"], s["end"], s["kind"])
    )
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS),
        sha256_text(secret_scan.listed(F.col("spans"), lambda s: s["kind"])).alias("base_sha256"),
        secret_scan.listed(F.array_sort(F.concat(plain, live)), lambda s: s["kind"]).alias("spans"),
    )


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are similar by 0.85 or more."""
    docs = read(spark, folder, "documents")
    return neardup.near_duplicates(docs, width=3, similarity=(85, 100))


def op9_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of embeddings of one label with a cosine of 0.98 or more."""
    return forest.near_duplicates(read(spark, folder, "embeddings"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records, from the merged index of the archives read back. The table has
    no times, so a page's id stands in, in seconds."""
    start = F.lit("2024-01-01 00:00:00+00:00").cast("timestamp")
    pages = read(spark, folder, "pages").select(
        "page_id",
        "url",
        "html",
        F.timestamp_seconds(F.unix_seconds(start) + F.col("page_id")).alias("time"),
    )
    return warc.archive_and_index(pages, time_col="time").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words of all documents with their near words, forms and roots."""
    return spelling.variants(read(spark, folder, "documents"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of all embeddings, in integers."""
    return centroids.cluster(read(spark, folder, "embeddings"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document, and the verdict of its distances to its language."""
    judged = quality.rules(read(spark, folder, "documents"))
    distances = {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    return judged.withColumns(distances)


QUERIES: dict[str, Query] = {
    "op1_tool_calls": op1_tool_calls,
    "op2_toxicity": op2_toxicity,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_licenses": op4_licenses,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_embedding_near_duplicates": op9_embedding_near_duplicates,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_centroids": op12_centroids,
    "op13_quality": op13_quality,
}
