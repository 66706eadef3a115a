"""Author profiles: roll-up, strata, coverage rates and creator roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numeric import rate


def roll_up(posts: DataFrame, platform: str, author: str, day: Column, profile: Column) -> DataFrame:
    """One row per platform and author: posts, distinct days, days between first and last, whether any post has a profile."""
    rows = posts.where(F.col(author).isNotNull()).select(F.col(platform).alias("platform_key"), F.col(author).alias("author_id"), day.alias("day"), profile.alias("p"))
    return rows.groupBy("platform_key", "author_id").agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct("day").alias("distinct_days"), F.coalesce(F.datediff(F.max("day"), F.min("day")), F.lit(0)).cast("bigint").alias("span_days"),
        F.max(F.coalesce("p", F.lit(False))).alias("has_profile"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


def author_stratum(days: Column, span: Column, profile: Column) -> Column:
    """HISTORY_RICH, BOUNDARY or RANDOM_FRAME."""
    rich = (days >= 3) & (span >= 30)
    return F.when(rich & profile, "HISTORY_RICH").when(rich | profile, "BOUNDARY").otherwise("RANDOM_FRAME")


def coverage(authors: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per platform: authors, and for each flag how many have it and their share to six places."""
    out = authors.groupBy("platform_key").agg(F.count(F.lit(1)).alias("authors"), *[F.sum(F.coalesce(c.cast("int"), F.lit(0))).cast("bigint").alias(f"{n}_n") for n, c in flags.items()])
    return out.select("platform_key", "authors", *[c for n in flags for c in (F.col(f"{n}_n"), rate(F.col(f"{n}_n"), F.col("authors")).alias(f"{n}_rate"))])


#: Scopes of an account, and code sets of the two criteria.
OUT_OF_SCOPE, UNCLEAR, IN_SCOPE = ("ORGANIZATION", "MULTI_AUTHOR"), ("UNCLEAR",), ("PERSONAL_CREATOR",)
EXPERT_CODES = ("EA_CREDENTIAL", "EA_DOMAIN_OCCUPATION", "EA_DOMAIN_VERIFICATION", "EA_INSTITUTION_AFFILIATION", "EA_SPECIALIST_HISTORY")
CONSUMER_CODES = ("CE_FIRSTHAND_REPEAT", "CE_PEER_ORIENTATION")


def _criterion(codes: Column, positive: tuple[str, ...], prefix: str, every: bool) -> tuple[Column, Column]:
    """(verdict, whether codes contradict each other or are unknown): 1, 0 or null; with ``every`` all positive codes are needed for 1."""
    given = F.array_distinct(F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != ""))
    known, none, unknown = F.array(*map(F.lit, positive)), f"{prefix}_NONE", f"{prefix}_UNK"
    strange = F.size(F.array_except(given, F.concat(known, F.array(F.lit(none), F.lit(unknown))))) > 0
    not_alone = (F.array_contains(given, none) | F.array_contains(given, unknown)) & (F.size(given) > 1)
    hits = F.size(F.array_intersect(given, known))
    return F.when(F.array_contains(given, none), 0).when(hits >= (len(positive) if every else 1), 1), strange | not_alone


def creator_role(scope: Column, expert: Column, consumer: Column, distinct_dates: Column, span_days: Column, has_profile: Column) -> Column:
    """struct(expert, consumer, sustained, evidence, role) that codes and material allow.

    Roles are KOL_TYPE, KOC_TYPE, HYBRID, ORDINARY, UNK, NA (not one person's account) and ERROR: a code outside its set, NONE or UNK
    beside another code, or NONE although there is too little material (three dates, thirty days, a profile) to say so.
    """
    e, e_wrong = _criterion(expert, EXPERT_CODES, "EA", False)
    c, c_wrong = _criterion(consumer, CONSUMER_CODES, "CE", True)
    long_known = F.coalesce((distinct_dates >= 3) & (span_days >= 30), F.lit(False))
    covered = long_known & F.coalesce(has_profile, F.lit(False))
    outside = lambda codes, names: F.size(F.array_except(F.coalesce(codes, F.array().cast("array<string>")), F.array(*map(F.lit, names)))) > 0
    unknown_codes = outside(F.transform(expert, lambda c: F.trim(c)), (*EXPERT_CODES, "EA_NONE", "EA_UNK", "")) | outside(F.transform(consumer, lambda c: F.trim(c)), (*CONSUMER_CODES, "CE_NONE", "CE_UNK", ""))
    denied = (F.coalesce(e == 0, F.lit(False)) | F.coalesce(c == 0, F.lit(False))) & ~covered
    text = lambda x: F.coalesce(x.cast("string"), F.lit("UNK"))
    result = lambda x, y, z, evidence, role: F.struct(x.alias("expert"), y.alias("consumer"), z.alias("sustained"), F.lit(evidence).alias("evidence"), role.alias("role"))
    same = lambda value, evidence, role: result(*[F.lit(value)] * 3, evidence, F.lit(role))
    role = F.when((e == 1) & (c == 0), "KOL_TYPE").when((e == 0) & (c == 1), "KOC_TYPE").when(e == 1, "HYBRID").otherwise("ORDINARY")
    return (
        F.when(~F.coalesce(scope, F.lit("")).isin(*OUT_OF_SCOPE, *UNCLEAR, *IN_SCOPE) | unknown_codes, same("UNK", "INVALID", "ERROR"))
        .when(scope.isin(*OUT_OF_SCOPE), same("NA", "OUT_OF_SCOPE", "NA"))
        .when(scope.isin(*UNCLEAR), same("UNK", "INSUFFICIENT", "UNK"))
        .when(e_wrong | c_wrong | denied, same("UNK", "INVALID", "ERROR"))
        .when(covered & e.isNotNull() & c.isNotNull(), result(text(e), text(c), F.lit("1"), "SUFFICIENT", role))
        .otherwise(result(text(e), text(c), text(F.when(long_known, 1)), "INSUFFICIENT", F.lit("UNK")))
    )


def invalid_rows(rows: DataFrame, domains: dict[str, tuple[str, ...]], key: str) -> DataFrame:
    """(key, reasons) of rows with a value outside its closed domain, or with a key that repeats."""
    reasons = [F.when(F.col(c).isNull() | ~F.col(c).isin(*values), F.lit(f"{c}_domain")) for c, values in domains.items()]
    twice = rows.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("__twice"))
    checked = rows.join(twice, key).withColumn("reasons", F.array_compact(F.array(*reasons, F.when(F.col("__twice"), F.lit("duplicate_key")))))
    return checked.where(F.size("reasons") > 0).select(key, "reasons")


def evidence_span(text: Column, quote: Column, start: Column) -> Column:
    """struct(start, end, issue): where a quote stands; a quote that stands twice needs its start given (from 0)."""
    first = F.locate(quote, text) if isinstance(quote, str) else F.call_function("locate", quote, text)
    second = F.call_function("locate", quote, text, first + 1)
    given = F.substring(text, start + 1, F.length(quote)) == quote
    at = F.when(start.isNotNull() & given, start).when(start.isNull() & (first > 0) & (second == 0), first - 1)
    issue = F.when(F.length(quote) == 0, "empty_quote").when(first == 0, "not_found").when(start.isNotNull() & ~given, "wrong_offset").when(start.isNull() & (second > 0), "ambiguous")
    return F.struct(at.cast("int").alias("start"), (at + F.length(quote)).cast("int").alias("end"), issue.alias("issue"))
