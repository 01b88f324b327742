"""Which code stands behind a claim.

The related files of a claim are the pairs of its words with all files that define them: on popular names
that is a product. Verdicts need only how many there are, so counts are joined; ``api_related_files``
lists the pairs for those who ask for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions import fixed_values as fixed
from auditframe.functions.classify import is_correlated_code
from auditframe.functions.code import KEY_LENGTH
from auditframe.functions.documents import api_words, feature_keywords
from auditframe.functions.fixed_values import FEATURE_KEYWORD_LENGTH
from auditframe.operators.facts import fact
from auditframe.operators.grouping import By, join_groups, join_large, join_product

REPO = ("repo_id",)
CLAIM = ("claim_id",)


def symbols(files: DataFrame, by: By = REPO) -> DataFrame:
    """Functions and classes defined per file, each once."""
    return files.select(*by, "path", F.explode(fact(files, "symbols")).alias("symbol"))


def _api_words(claims: DataFrame, by: By) -> DataFrame:
    """Words of API claims with the number of times each occurs in its claim."""
    words = claims.filter(F.col("claim_type") == "api").select(
        *by, *CLAIM, F.explode(api_words(F.col("text"))).alias("symbol")
    )
    return words.groupBy(*by, *CLAIM, "symbol").agg(F.count("*").alias("times"))


def api_related(claims: DataFrame, symbols: DataFrame, by: By = REPO) -> DataFrame:
    """Per API claim with any: how many related files, over all its words, repeated words repeated.

    An equi-join on the word; the definitions are counted per word first, so a name defined in every
    file of a repository is one row there.
    """
    defined = symbols.groupBy(*by, "symbol").agg(F.count("*").alias("files"), F.min("path").alias("first_file"))
    words = _api_words(claims, by)
    hits = join_large(words, defined, [*by, "symbol"])
    return hits.groupBy(*by, *CLAIM).agg(
        F.sum(F.col("times") * F.col("files")).alias("related"), F.min("first_file").alias("first_file")
    )


def api_related_files(claims: DataFrame, symbols: DataFrame, by: By = REPO) -> DataFrame:
    """The related files themselves, one row per claim, word and defining file.

    Their number is the product of both sides on popular names, so nothing but the rows returned is of that size.
    """
    files = symbols.select(*by, "symbol", "path")
    pairs = join_product(files, _api_words(claims, by), [*by, "symbol"], value="path", spread_by="claim_id")
    return pairs.select(*by, "symbol", *CLAIM, "times", "path")


def api_claim_classes(claims: DataFrame, symbols: DataFrame, by: By = REPO) -> DataFrame:
    """The related files by class: per claim and word the class it points to, with its files and links.

    All files that define one name are a class, named by it; ``api_class_files`` lists the members. Both are
    linear in the words of the claims and in the definitions, where the pairs are their product, and together
    they hold every link: a claim is related to each member of its classes, ``times`` times.
    """
    sizes = symbols.groupBy(*by, "symbol").agg(F.count("*").alias("files"))
    hits = join_large(_api_words(claims, by), sizes, [*by, "symbol"])
    return hits.withColumn("links", F.col("times") * F.col("files"))


def api_class_files(claims: DataFrame, symbols: DataFrame, by: By = REPO) -> DataFrame:
    """Members of the classes that any claim points to, each once."""
    named = _api_words(claims, by).select(*by, "symbol")
    return join_large(symbols.select(*by, "symbol", "path"), named, [*by, "symbol"], how="left_semi")


#: Characters that a keyword and a place in a word are joined on: the longer key where the keyword has it.
SHORT_KEY, LONG_KEY = FEATURE_KEYWORD_LENGTH, 2 * FEATURE_KEYWORD_LENGTH


def _places(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece once per place that ``length`` characters follow: these as ``key``, more of them as ``ahead``.

    A row holds a bounded stretch of its piece, so the rows are linear in the text however long a piece is.
    """
    kept = [c for c in pieces.columns if c != "piece"]
    starts = F.explode(F.sequence(F.lit(1), F.length("piece") - (length - 1))).alias("__start")
    placed = pieces.filter(F.length("piece") >= length).select("*", starts)
    key = F.substring(F.col("piece"), F.col("__start"), F.lit(length)).alias("key")
    return placed.select(*kept, key, F.substring(F.col("piece"), F.col("__start"), F.lit(KEY_LENGTH)).alias("ahead"))


def keyword_files(files: DataFrame, keywords: DataFrame, by: By = REPO, texts: DataFrame | None = None) -> DataFrame:
    """For each keyword the first code file that contains it, as a substring, in any case.

    A keyword consists of word characters, so it lies within one word of the text. The distinct words of
    a repository, far fewer than its text, give a row per place; an equi-join on the first characters finds
    the keywords that may begin there, and the characters ahead decide. Short and longer keywords join on
    keys of their own, as many words share four characters but few share eight. Keywords longer than 32
    characters are decided in the files that hold their first 32.

    ``files`` may be a table of facts; ``texts`` then are the files with their texts, which only those keywords need.
    """
    code = files.filter(is_correlated_code(F.col("path")))
    texts = files if texts is None else texts
    wanted = keywords.select(*by, "keyword").distinct().withColumn("head", F.left("keyword", F.lit(KEY_LENGTH)))
    is_long = F.length("keyword") >= LONG_KEY
    words = code.select(*by, "path", F.explode(fact(files, "word_pieces")).alias("piece"))
    # The first file alone decides short keywords; one that exceeds the stretch ahead may need another file.
    firsts = words.groupBy(*by, "piece").agg(F.min("path").alias("path"))
    decided = F.length("keyword") <= KEY_LENGTH
    found = None
    for length, chosen in ((SHORT_KEY, ~is_long), (LONG_KEY, is_long & decided)):
        sought = wanted.filter(chosen).withColumn("key", F.left("keyword", F.lit(length)))
        hits = join_large(_places(firsts, length), sought, [*by, "key"]).filter(F.col("ahead").startswith(F.col("keyword")))
        found = hits.select(*by, "keyword", "path") if found is None else found.unionByName(hits.select(*by, "keyword", "path"))
    anchored = wanted.filter(~decided).withColumn("key", F.left("keyword", F.lit(LONG_KEY)))
    candidates = join_large(_places(words, LONG_KEY), anchored, [*by, "key"]).filter(F.col("ahead") == F.col("head"))
    held = texts.filter(is_correlated_code(F.col("path"))).select(*by, "path", "text")
    verified = join_large(held, candidates.select(*by, "path", "keyword").distinct(), [*by, "path"])
    verified = verified.filter(F.lower("text").contains(F.col("keyword"))).select(*by, "keyword", "path")
    return found.unionByName(verified).groupBy(*by, "keyword").agg(F.min("path").alias("path"))


def feature_related(claims: DataFrame, files: DataFrame, by: By = REPO, texts: DataFrame | None = None) -> DataFrame:
    """Related files of feature claims: the first file for each of at most three keywords."""
    tokens = claims.filter(F.col("claim_type") == "feature").select(
        *by, *CLAIM, F.posexplode(feature_keywords(F.col("text"))).alias("ord", "keyword")
    )
    hits = join_large(tokens, keyword_files(files, tokens, by, texts), [*by, "keyword"])
    listed = F.array_sort(F.collect_list(F.struct("ord", "path")))
    grouped = hits.groupBy(*by, *CLAIM).agg(F.count("*").alias("related"), listed.alias("l"))
    return grouped.select(*by, *CLAIM, "related", F.col("l.path").alias("related_code"))


def security_related(claims: DataFrame, files: DataFrame, by: By = REPO) -> DataFrame:
    """Related files of security claims: the first file for each fixed keyword the claim holds.

    One aggregate finds the eleven files of a repository, whatever the number of claims.
    """
    code = files.filter(is_correlated_code(F.col("path")))
    held = code.select(*by, "path", fact(files, "security_keywords").alias("held"))
    firsts = held.groupBy(*by).agg(
        *[
            F.min(F.when(F.array_contains("held", k), F.col("path"))).alias(f"k_{k}")
            for k in fixed.SECURITY_KEYWORDS
        ]
    )
    lowered = F.lower("text")
    security = claims.filter(F.col("claim_type") == "security").select(*by, *CLAIM, "text")
    joined = join_groups(security, firsts, by)
    related = F.array_compact(
        F.array(*[F.when(lowered.contains(k), F.col(f"k_{k}")) for k in fixed.SECURITY_KEYWORDS])
    )
    listed = joined.select(*by, *CLAIM, related.alias("related_code"))
    return listed.withColumn("related", F.size("related_code").cast("bigint")).filter(F.col("related") > 0)


def correlate(claims: DataFrame, files: DataFrame, texts: DataFrame | None = None, by: By = REPO) -> DataFrame:
    """Add the number of related files to every claim, 0 for types that are not looked up.

    ``files`` may be a table of facts; ``texts`` then are the files with their texts.
    """
    related = (
        api_related(claims, symbols(files, by), by)
        .select(*by, *CLAIM, "related")
        .unionByName(feature_related(claims, files, by, texts).select(*by, *CLAIM, "related"))
        .unionByName(security_related(claims, files, by).select(*by, *CLAIM, "related"))
    )
    joined = join_large(claims, related, [*by, *CLAIM], how="left")
    return joined.fillna(0, ["related"])


def unrelated_claims(claims: DataFrame, related: DataFrame, by: By = REPO) -> DataFrame:
    """Claims without any related code."""
    return join_large(claims, related.select(*by, *CLAIM), [*by, *CLAIM], how="left_anti")
