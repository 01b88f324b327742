"""Verification methods, verdicts and claim statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import classify
from auditframe.functions import fixed_values as fixed
from auditframe.operators.discovery import benchmark_files
from auditframe.operators.grouping import By, join_groups, share, top_k

REPO = ("repo_id",)


def with_strategy(claims: DataFrame) -> DataFrame:
    """Add how, and whether, a claim can be verified; needs its number of related files."""
    kind = F.col("claim_type")
    return claims.withColumns(
        {
            "verification_method": classify.verification_method(kind),
            "verifiable": classify.is_verifiable(kind, F.col("related")),
        }
    )


def _evidence(claims: DataFrame) -> tuple[Column, Column, Column]:
    method, related = F.col("verification_method"), F.col("related")
    has_code = F.coalesce(related, F.lit(0)) > 0
    is_api, is_benchmark = method == "unit_test", method == "benchmark"
    benchmark = F.col("benchmark_file")
    count = related.cast("string")
    status = F.when(is_api, F.when(has_code, "verified").otherwise("failed")).otherwise("inconclusive")
    confidence = (
        F.when(is_api, F.when(has_code, 0.8).otherwise(0.9))
        .when(is_benchmark, F.when(benchmark.isNotNull(), 0.5).otherwise(0.3))
        .when(method == "security_test", 0.4)
        .otherwise(F.when(has_code, 0.5).otherwise(0.2))
    )
    evidence = (
        F.when(
            is_api,
            F.when(has_code, F.concat(F.lit("Found implementation in "), count, F.lit(" files"))).otherwise(
                "No implementation found for claimed API"
            ),
        )
        .when(
            is_benchmark,
            F.when(benchmark.isNotNull(), F.concat(F.lit("Found potential benchmark: "), benchmark)).otherwise(
                "No benchmarks found to verify performance claim"
            ),
        )
        .when(method == "security_test", "Security verification requires dedicated security analysis")
        .otherwise(
            F.when(has_code, F.concat(F.lit("Found related code in "), count, F.lit(" files"))).otherwise(
                "Unable to automatically verify this claim"
            )
        )
    )
    return status, confidence, evidence


def verdicts(claims: DataFrame, files: DataFrame, by: By = REPO) -> DataFrame:
    """Status, confidence and evidence per claim. Claims carry their strategy and related files."""
    judged = join_groups(claims, benchmark_files(files, by), by)
    status, confidence, evidence = _evidence(judged)
    return judged.withColumns(
        {"status": status, "verdict_confidence": confidence, "evidence": evidence}
    ).drop("benchmark_file")


def verdict_summary(judged: DataFrame, by: By = REPO) -> DataFrame:
    total = F.count("*")
    counts = {s: F.count_if(F.col("status") == s) for s in ("verified", "failed", "inconclusive")}
    return judged.groupBy(*by).agg(
        total.alias("total_claims"),
        *[n.alias(s) for s, n in counts.items()],
        share(counts["verified"], total).alias("verification_rate"),
    )


def claim_summary(claims: DataFrame, by: By = REPO) -> DataFrame:
    total, verifiable = F.count("*"), F.count_if(F.col("verifiable"))
    return claims.groupBy(*by).agg(
        total.alias("total_claims"),
        verifiable.alias("verifiable_claims"),
        share(verifiable, total).alias("verification_rate"),
        F.count_if(F.col("confidence") >= fixed.HIGH_CONFIDENCE).alias("high_confidence_claims"),
    )


def documentation_summary(
    claims: DataFrame, docs: DataFrame, references: DataFrame, by: By = REPO
) -> DataFrame:
    """Claim statistics with the number of documentation files and of code references."""
    summary = join_groups(
        claim_summary(claims, by), docs.groupBy(*by).agg(F.count("*").alias("documentation_files")), by
    )
    found = references.groupBy(*by).agg(F.count("*").alias("code_references_found"))
    return join_groups(summary, found, by).fillna(0, ["documentation_files", "code_references_found"])


def claims_by(claims: DataFrame, group: str, by: By = REPO) -> DataFrame:
    """Claims and mean confidence per type or source.

    The claims of a group stay rows; write them with ``partitionBy`` to have a folder per group.
    """
    return claims.groupBy(*by, group).agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("verifiable")).alias("verifiable_claims"),
        F.avg("confidence").alias("average_confidence"),
    )


def verification_recommendations(
    claims: DataFrame, order: list[str], examples: int = 3, by: By = REPO
) -> DataFrame:
    """What to write or review, per method, with the first examples; unverifiable claims make one more.

    Counting and picking examples both cut down before they shuffle; only ``examples`` rows per group
    are ever collected.
    """
    advised = F.when(
        F.col("verifiable"),
        F.when(F.col("verification_method").isin(list(fixed.VERIFICATION_ADVICE)), F.col("verification_method")),
    ).otherwise("review")
    grouped = claims.withColumn("advice", advised).filter(F.col("advice").isNotNull())
    counts = grouped.groupBy(*by, "advice").agg(F.count("*").alias("claims"))
    first = top_k(grouped, examples, [F.asc(c) for c in order], [*by, "advice"])
    texts = first.groupBy(*by, "advice").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("examples")
    )
    advice = {**fixed.VERIFICATION_ADVICE, "review": fixed.REVIEW_ADVICE}

    def column(position: int) -> Column:
        chosen = F.lit(None).cast("string")
        for method, texts_of in advice.items():
            chosen = F.when(F.col("advice") == method, texts_of[position]).otherwise(chosen)
        return chosen

    joined = join_groups(counts, texts, [*by, "advice"])
    return joined.select(
        *by,
        column(0).alias("type"),
        column(1).alias("priority"),
        F.concat(column(2), F.col("claims").cast("string"), column(3)).alias("description"),
        "examples",
        column(4).alias("suggested_approach"),
    )


def gate(repositories: DataFrame, test_totals: DataFrame, judged: DataFrame, by: By = REPO) -> DataFrame:
    """Failed tests, failed claims and the gate status of every repository.

    A repository without a failed claim has 0 of them; one whose tests never ran has no number of failed tests.
    """
    tests = test_totals.select(*by, F.col("failed").alias("failed_tests"))
    failed = judged.filter(F.col("status") == "failed").groupBy(*by).agg(F.count("*").alias("failed_claims"))
    rows = join_groups(join_groups(repositories, tests, by), failed, by).fillna(0, ["failed_claims"])
    return rows.withColumn("gate_status", classify.gate_status(F.col("failed_tests"), F.col("failed_claims")))
