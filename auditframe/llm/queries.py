"""The operators as queries over the given tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import (
    attribution, chat, interactions, language, lexical, minhash, mixing, packing, radix, set_join, sharding, sql, weak_labels, winnowing,
)
from auditframe.llm.common import WORD, documents, shipped
from auditframe.session import stage

FOLDS = 5


def op1_token_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document, by where a token's first character lies."""
    return attribution.attribute(attribution.line_sections(documents(spark, folder))).drop("name")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(documents(spark, folder))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Learnt from four folds of the labelled documents, predicted for all."""
    docs = documents(spark, folder)
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    net = language.learn(docs.filter(~held_out))
    texts = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return language.identify(texts, net).select("doc_id", "held_out", "lang_pred", "score")


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder), words=2)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    # Words are counted once; the mix reads sizes several times.
    sized = stage(documents(spark, folder).select("doc_id", "source", size.alias("words")), "sizes")
    mixed = mixing.mix(sized, F.col("words"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


def op6_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    shipped(spark)
    said = "</s>[INST] ok [/INST]"
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.windows(turns.unionByName(tricky)))


def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against an edited text of its own and against the next document."""
    followed = winnowing.with_next(documents(spark, folder))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    rows = followed.withColumns({"n_chars": n.cast("long"), "edited": edited})
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    found = winnowing.fingerprints(
        rows, ("text", "edited", "next"), (("text", "edited"), ("text", "next")), ("doc_id", "n_chars", "edited_sha256"), spans=False
    )
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fingerprint_text").alias("fingerprint"),
        F.col("fingerprint_edited").alias("edited_fingerprint"), F.col("likeness_text_edited").alias("near_edited"),
        F.col("likeness_text_next").alias("near_next"),
    )


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.quality(documents(spark, folder).select("doc_id", "text")).select("doc_id", "posterior", "score", "kept")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, folder).select("doc_id", "text", F.sha2(text, 256).alias("text_sha256"))
    return radix.groups_of_equals(docs, carry=("doc_id", "text_sha256"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    docs = documents(spark, folder).select("doc_id", "source", size.alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.interleave(docs, tie=F.struct("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op11_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose three-word shingle sets are similar by 0.9 or more."""
    return set_join.linked_sets(documents(spark, folder))


def op12_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """All orders of five filters in every language: what each step keeps, removes, repeats and costs."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    filters = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    masks, names = interactions.failure_masks(documents(spark, folder), labels, filters, repeats="E")
    return interactions.interactions(masks, names)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_attribution, op2_best_fit_packing, op3_language_id, op4_minhash, op5_mixing, op6_chat_windows, op7_winnowing,
        op8_quality, op9_exact_dedup, op10_sharding, op11_ngram_jaccard, op12_filter_interactions, op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op4_minhash": sql.NEAR_DUPLICATES,
    "op9_exact_dedup": sql.EXACT_DEDUP,
    "op11_ngram_jaccard": sql.LINKED_SETS,
    "op12_filter_interactions": sql.FILTER_INTERACTIONS,
    "op13_lexical_search": sql.LEXICAL_SEARCH,
}
