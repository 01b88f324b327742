"""Commit history: activity, churn, ownership, documentation, features, versions.

"Now" is always the argument ``as_of``; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import classify
from auditframe.functions import fixed_values as fixed
from auditframe.functions.text import has_suffix, rewrite_matches
from auditframe.operators.grouping import By, join_groups, top_k, with_total

REPO = ("repo_id",)
ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
BUS_FACTOR_SHARE = 0.1


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def since(df: DataFrame, as_of: str, years: int = 0, months: int = 0, days: int = 0) -> DataFrame:
    """Rows from a span before ``as_of`` on. The bound is a constant, so it reaches the scan."""
    start = moment(as_of) - F.make_interval(years=F.lit(years), months=F.lit(months), days=F.lit(days))
    return df.filter(F.col("ts") >= start)


def without_merges(commits: DataFrame) -> DataFrame:
    return commits.filter(~F.col("is_merge")) if "is_merge" in commits.columns else commits


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / 86400)


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


# --- activity -------------------------------------------------------------------------------------


def repository_info(commits: DataFrame, by: By = REPO) -> DataFrame:
    first, last = F.min("ts"), F.max("ts")
    return commits.groupBy(*by).agg(
        F.coalesce(whole_days(last, first), F.lit(0)).alias("repo_age_days"),
        iso(first).alias("first_commit_date"),
        iso(last).alias("last_commit_date"),
        F.count("*").alias("total_commits"),
    )


def recent_commits(commits: DataFrame, as_of: str) -> DataFrame:
    return since(without_merges(commits), as_of, days=365)


def commits_per_month(commits: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return recent_commits(commits, as_of).groupBy(*by, month).agg(F.count("*").alias("commits"))


def commits_per_author(commits: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    return recent_commits(commits, as_of).groupBy(*by, "author").agg(F.count("*").alias("commits"))


def mean_commits_per_month(commits: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    """Mean over the months that have commits."""
    months = commits_per_month(commits, as_of, by)
    return months.groupBy(*by).agg(
        F.count("*").alias("months"), F.coalesce(F.avg("commits"), F.lit(0.0)).alias("average_commits_per_month")
    )


def commit_category_counts(commits: DataFrame, by: By = REPO) -> DataFrame:
    flags = classify.commit_categories(F.col("subject"))
    return commits.groupBy(*by).agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()])


# --- files ----------------------------------------------------------------------------------------


def file_changes(commit_files: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    """Changes per file in the last year."""
    named = since(commit_files, as_of, years=1).filter(F.col("path") != "")
    return named.groupBy(*by, "path").agg(F.count("*").alias("changes"))


def most_changed_files(commit_files: DataFrame, as_of: str, k: int = 20, by: By = REPO) -> DataFrame:
    return top_k(file_changes(commit_files, as_of, by), k, [F.desc("changes"), F.asc("path")], by)


def files_changed(commit_files: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    changes = file_changes(commit_files, as_of, by)
    return changes.groupBy(*by).agg(F.count("*").alias("total_files_changed"))


def recently_added_files(commit_files: DataFrame, as_of: str, k: int = 10, by: By = REPO) -> DataFrame:
    added = since(commit_files, as_of, months=3).filter((F.col("change") == "A") & (F.col("path") != ""))
    firsts = added.groupBy(*by, "path").agg(F.min("ts").alias("added_at"))
    return top_k(firsts, k, [F.desc("added_at"), F.asc("path")], by)


def file_churn(commit_files: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    """Changes per file in the last six months, names starting with a dot left out."""
    named = since(commit_files, as_of, months=6).filter(
        (F.col("path") != "") & ~F.col("path").startswith(".")
    )
    return named.groupBy(*by, "path").agg(F.count("*").alias("changes"))


def high_churn_files(
    commit_files: DataFrame, as_of: str, more_than: int = 5, k: int = 10, by: By = REPO
) -> DataFrame:
    churning = file_churn(commit_files, as_of, by).filter(F.col("changes") > more_than)
    return top_k(churning, k, [F.desc("changes"), F.asc("path")], by)


def stable_files(commit_files: DataFrame, as_of: str, more_than: int = 5, by: By = REPO) -> DataFrame:
    """Changed files that do not churn."""
    return file_churn(commit_files, as_of, by).filter(F.col("changes") <= more_than)


def abandoned_files(
    commit_files: DataFrame,
    as_of: str,
    older_than: int = 365,
    k: int = 10,
    by: By = REPO,
    sample_first: int | None = None,
) -> DataFrame:
    """Code files untouched for more than a year, the oldest first.

    All files are looked at; ``sample_first`` restricts this to the first so many by path.
    """
    named = commit_files.filter(F.col("path") != "")
    last = named.groupBy(*by, "path").agg(F.max("ts").alias("ts"))
    if sample_first is not None:
        last = top_k(last, sample_first, [F.asc("path")], by).drop("rank")
    old = last.filter(
        (F.unix_micros("ts") < F.unix_micros(moment(as_of)) - older_than * 86_400_000_000)
        & has_suffix(F.col("path"), fixed.ABANDONED_SUFFIXES)
    )
    days = old.select(*by, "path", whole_days(moment(as_of), F.col("ts")).alias("days_since_change"))
    return top_k(days, k, [F.desc("days_since_change"), F.asc("path")], by)


def file_ownership(commit_files: DataFrame, k: int = 10, by: By = REPO) -> DataFrame:
    """Main committer of each key file; ties go to the first name."""
    touched = commit_files.filter(classify.is_key_file(F.col("path")))
    commits = touched.groupBy(*by, "path", "author").agg(F.count_distinct("hash").alias("commits"))
    order = F.struct(-F.col("commits"), F.col("author"))
    owners = commits.groupBy(*by, "path").agg(
        F.min_by("author", order).alias("primary_maintainer"), F.max("commits").alias("commits")
    )
    return top_k(owners, k, [F.asc("path")], by)


# --- contributors ---------------------------------------------------------------------------------


def contributors(commits: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    """Commits per author in the last year, or of all time for repositories without any in it.

    One pass counts recent and older commits apart; the repository's recent total decides whether the older ones go.
    """
    start = moment(as_of) - F.make_interval(years=F.lit(1))
    is_recent = F.coalesce(F.col("ts") >= start, F.lit(False)).alias("is_recent")
    counts = without_merges(commits).groupBy(*by, "author", is_recent).agg(F.count("*").alias("n"))
    counts = counts.withColumn("recent", F.when(F.col("is_recent"), F.col("n")).otherwise(0))
    judged = with_total(counts, "recent", by, "recent_total").filter(F.col("is_recent") | (F.col("recent_total") == 0))
    return judged.groupBy(*by, "author").agg(F.sum("n").alias("commits"))


def top_contributors(commits: DataFrame, as_of: str, k: int = 20, by: By = REPO) -> DataFrame:
    return top_k(contributors(commits, as_of, by), k, [F.desc("commits"), F.asc("author")], by)


def bus_factor(authors: DataFrame, min_share: float = BUS_FACTOR_SHARE, by: By = REPO) -> DataFrame:
    """Authors with more than ``min_share`` of all commits, from ``(author, commits)`` rows."""
    totals = with_total(authors, "commits", by)
    return totals.groupBy(*by).agg(
        F.count("*").alias("total_contributors"),
        F.count_if(F.col("commits") / F.col("total") > min_share).alias("bus_factor"),
    )


# --- documentation --------------------------------------------------------------------------------


def is_history_doc(path: Column) -> Column:
    """Documentation by extension, by the start of its name, or as a direct child of a docs directory."""
    suffixes = "|".join(s.replace(".", "\\.") for s in fixed.HISTORY_DOC_SUFFIXES)
    starts = "|".join(fixed.HISTORY_DOC_NAME_STARTS)
    return path.rlike(f"[^/](?:{suffixes})$|(?:^|/)(?:{starts})[^/]*$|(?:^|/){fixed.HISTORY_DOC_DIRECTORY}/[^/]+$")


def doc_updates(commit_files: DataFrame, by: By = REPO) -> DataFrame:
    """Newest commit per documentation file."""
    docs = commit_files.filter(is_history_doc(F.col("path")))
    return docs.groupBy(*by, "path").agg(F.max("ts").alias("ts"))


def latest_doc_updates(commit_files: DataFrame, k: int = 10, by: By = REPO) -> DataFrame:
    return top_k(doc_updates(commit_files, by), k, [F.desc("ts"), F.asc("path")], by)


def doc_overview(commit_files: DataFrame, by: By = REPO) -> DataFrame:
    """Number of documentation files, and the README with its newest commit, NULL without one."""
    is_readme = F.lower("path").contains("readme")
    return doc_updates(commit_files, by).groupBy(*by).agg(
        F.count("*").alias("documentation_files"),
        F.min(F.when(is_readme, F.col("path"))).alias("path"),
        F.max(F.when(is_readme, F.col("ts"))).alias("ts"),
    )


def code_change_lines(commit_files: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    """Length of the name-only log of six months of code commits.

    Two lines per commit and one per file, less the last line feed. Files are counted per commit first,
    so that counting commits needs no distinct.
    """
    code = since(commit_files, as_of, months=6).filter(has_suffix(F.col("path"), fixed.HISTORY_CODE_SUFFIXES))
    per_commit = code.groupBy(*by, "hash").agg(F.count("*").alias("files"))
    return per_commit.groupBy(*by).agg((F.sum("files") + 2 * F.count("*") - 1).alias("lines"))


def _is_outdated(as_of: str, older_than: int = 30, min_lines: int = 10) -> Column:
    return (F.col("lines") > min_lines) & (whole_days(moment(as_of), F.col("ts")) > older_than)


def outdated_docs(
    commit_files: DataFrame, as_of: str, older_than: int = 30, min_lines: int = 10, by: By = REPO
) -> DataFrame:
    """The README, where it is old although code kept changing; at most one row per repository."""
    docs = doc_overview(commit_files, by).filter(F.col("ts").isNotNull())
    judged = join_groups(docs, code_change_lines(commit_files, as_of, by), by)
    return judged.filter(_is_outdated(as_of, older_than, min_lines)).select(
        *by, "path", whole_days(moment(as_of), F.col("ts")).alias("days_since_update")
    )


# --- features and versions ------------------------------------------------------------------------


def feature_commits(commits: DataFrame, as_of: str, k: int = 50, by: By = REPO) -> DataFrame:
    """The newest feature commits of the last year."""
    features = since(commits, as_of, years=1).filter(classify.is_feature_commit(F.col("subject")))
    return top_k(features, k, [F.desc("ts"), F.asc("hash")], by)


def recent_features(commits: DataFrame, as_of: str, k: int = 20, by: By = REPO) -> DataFrame:
    """The k newest feature commits."""
    return feature_commits(commits, as_of, k, by)


def features_per_month(commits: DataFrame, as_of: str, newest: int | None = None, by: By = REPO) -> DataFrame:
    """Feature commits of the last year by month; of the ``newest`` ones only, if a number is given."""
    features = since(commits, as_of, years=1).filter(classify.is_feature_commit(F.col("subject")))
    features = features if newest is None else feature_commits(commits, as_of, newest, by)
    return features.groupBy(*by, F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("features"))


def version_key(tag: Column) -> Column:
    """Sort key under which runs of digits compare as numbers and everything else as text."""

    def padded(run: Column) -> Column:
        number = F.regexp_replace(run, "^0+(?=[0-9])", "")
        # The length goes first; one of more than four digits starts with the sign that follows nine.
        length = F.length(number)
        short, long = F.lpad(length.cast("string"), 4, "0"), F.concat(F.lit(":"), F.lpad(length.cast("string"), 10, "0"))
        return F.concat(F.when(length <= 9999, short).otherwise(long), number)

    return rewrite_matches(tag, "[0-9]+", padded)


def recent_versions(tags: DataFrame, k: int = 10, by: By = REPO) -> DataFrame:
    keyed = tags.filter(F.col("tag") != "").withColumn("version_key", version_key(F.col("tag")))
    order = [F.desc("version_key"), F.desc("ts"), F.asc("message")]
    return top_k(keyed, k, order, by).drop("version_key")


def version_stats(tags: DataFrame, min_share: float = 0.8, by: By = REPO) -> DataFrame:
    compliant = F.avg(classify.is_semver(F.col("tag")).cast("int"))
    return tags.groupBy(*by).agg(
        (F.count("*") > 0).alias("has_versions"),
        F.count("*").alias("total_versions"),
        F.max_by("tag", version_key(F.col("tag"))).alias("latest_version"),
        F.coalesce(compliant > min_share, F.lit(False)).alias("follows_semver"),
    )


# --- summary --------------------------------------------------------------------------------------


def commit_overview(commits: DataFrame, as_of: str, by: By = REPO) -> DataFrame:
    """Age, totals, categories of the last year and recent features, from one pass over the commits."""
    start = moment(as_of) - F.make_interval(days=F.lit(365))
    year = moment(as_of) - F.make_interval(years=F.lit(1))
    merged = F.col("is_merge") if "is_merge" in commits.columns else F.lit(False)
    recent = (F.col("ts") >= start) & ~merged
    flags = classify.commit_categories(F.col("subject"))
    feature = classify.is_feature_commit(F.col("subject")) & (F.col("ts") >= year)
    first, last = F.min("ts"), F.max("ts")
    return commits.groupBy(*by).agg(
        F.coalesce(whole_days(last, first), F.lit(0)).alias("repo_age_days"),
        iso(first).alias("first_commit_date"),
        iso(last).alias("last_commit_date"),
        F.count("*").alias("total_commits"),
        *[F.count_if(flag & recent).alias(name) for name, flag in flags.items()],
        F.count_if(feature).alias("recent_features"),
    )


def churn_overview(
    commit_files: DataFrame, as_of: str, more_than: int = 5, by: By = REPO
) -> DataFrame:
    """Numbers of high-churn files and of stable files."""
    churning = F.col("changes") > more_than
    return file_churn(commit_files, as_of, by).groupBy(*by).agg(
        F.count_if(churning).alias("high_churn_files"), F.count_if(~churning).alias("stable_files")
    )


def history_summary(
    commits: DataFrame,
    commit_files: DataFrame,
    tags: DataFrame,
    as_of: str,
    by: By = REPO,
    files_as_of: str | None = None,
    churn_above: int = 5,
) -> DataFrame:
    """One row per repository with every number the history rules ask for.

    ``files_as_of`` is the "now" of the touched files where it differs from that of the commits.
    """
    now = files_as_of or as_of
    docs = join_groups(doc_overview(commit_files, by), code_change_lines(commit_files, now, by), by)
    outdated = F.when(_is_outdated(now), F.lit(1)).otherwise(0).cast("bigint").alias("outdated_docs")
    summary = commit_overview(commits, as_of, by)
    for part in (
        bus_factor(contributors(commits, as_of, by), by=by),
        churn_overview(commit_files, now, churn_above, by=by),
        docs.select(*by, "documentation_files", outdated),
        version_stats(tags, by=by),
    ):
        summary = join_groups(summary, part, by)
    counts = [c for c, t in summary.dtypes if t == "bigint"]
    return summary.fillna(0, counts).fillna(False, ["has_versions", "follows_semver"])
