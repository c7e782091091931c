"""Adding, removing, listing and checking short links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rules import (
    generate_code,
    normalize_url,
    present,
    present_or_null,
    valid_code,
)
from clickloom.plans.numbering import sequence_number
from clickloom.plans.skew import first_per_key, lookup_join
from clickloom.sources.buckets import Buckets


def resolve_owner(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add `owner_id` by `token`; NULL means the token is unknown."""
    owners = first_per_key(users, "token", "id", [F.col("id").alias("owner_id")])
    return lookup_join(requests, owners, ["token"])


def code_conflicts(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Requests whose `shorturl` is already the code of a link."""
    taken = links.select("shorturl").distinct()
    return lookup_join(requests, taken, ["shorturl"], "left_semi")


def flag_filtered(df: DataFrame, column: str, words: DataFrame, flag: str = "filtered") -> DataFrame:
    """Flag texts that contain any filter word, upper and lower case alike.

    The substrings of the distinct texts that have the length of some word are met
    by an equi-join with the words, so the work grows with the texts and the number
    of word lengths, not with the number of words. The driver sees the lengths only.
    """
    lowered = words.select(F.lower("word").alias("word")).distinct()
    lengths = sorted(r.n for r in lowered.select(F.length("word").alias("n")).distinct().collect())
    texts = df.select(column).dropna().distinct()
    sized = texts.select(
        column, F.lower(F.col(column)).alias("_low"), F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_n")
    ).filter(F.col("_n") <= F.length("_low"))
    starts = F.sequence(F.lit(1), F.length("_low") - F.col("_n") + 1)
    pieces = sized.select(
        column, F.explode(F.transform(starts, lambda at: F.col("_low").substr(at, F.col("_n")))).alias("word")
    )
    bad = lookup_join(pieces.distinct(), lowered, ["word"], "left_semi").select(column).distinct()
    marked = lookup_join(df, bad.withColumn(flag, F.lit(True)), [column])
    known = F.coalesce(F.col(flag), F.lit(False))
    return marked.withColumn(flag, F.when(F.col(column).isNotNull(), known))


def judge_adds(
    requests: DataFrame,
    users: DataFrame,
    words: DataFrame,
    filter_on: bool = True,
    code_salt: str = "",
) -> DataFrame:
    """Add requests with `_failed`, the status of the first rule that fails before
    the code is compared with others, their `_code`, and whether it is `_custom`."""
    custom = present(F.coalesce("customshorturlcode", F.lit("")))
    early = F.when(~present(F.coalesce("token", F.lit(""))), 400).when(
        ~present(F.coalesce("redirecturl", F.lit(""))), 402
    )
    # Requests that already failed are not looked up: their key is NULL.
    asked = requests.withColumn("_early", early).withColumn(
        "_token", F.when(F.col("_early").isNull(), F.col("token"))
    )
    owners = first_per_key(users, "token", "id", [F.col("id").alias("owner_id")])
    judged = lookup_join(asked, owners.withColumnRenamed("token", "_token"), ["_token"])
    judged = flag_filtered(judged, "customshorturlcode", words, "_filtered")
    profane = F.col("_filtered") if filter_on else F.lit(False)
    return judged.select(
        *requests.columns,
        F.coalesce(
            F.col("_early"),
            F.when(F.col("owner_id").isNull(), 401)
            .when(custom & profane, 403)
            .when(custom & ~valid_code(F.col("customshorturlcode")), 405),
        ).alias("_failed"),
        F.when(custom, F.col("customshorturlcode"))
        .otherwise(generate_code(F.col("owner_id"), F.col("request_id"), code_salt))
        .alias("_code"),
        custom.alias("_custom"),
    )


def add_links(
    requests: DataFrame,
    users: DataFrame,
    links: DataFrame,
    words: DataFrame,
    filter_on: bool = True,
    code_salt: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Outcome of each add request and the links to append (without their ids).

    The first rule that fails gives the status. Among requests for the same free
    custom code in one batch the lowest `request_id` wins, unless an earlier request
    was given the same code by chance. The winner is found by pre-aggregated minima
    per code and comes back by the unique `request_id`, so a code that everybody
    asks for never fills one task.
    """
    judged = judge_adds(requests, users, words, filter_on, code_salt)
    winners = (
        judged.filter(F.col("_failed").isNull())
        .groupBy(F.col("_code").alias("shorturl"))
        .agg(
            F.min(F.when(F.col("_custom"), F.col("request_id"))).alias("request_id"),
            F.min(F.when(~F.col("_custom"), F.col("request_id"))).alias("_given"),
        )
        .filter("request_id IS NOT NULL AND (_given IS NULL OR request_id < _given)")
        .join(links.select("shorturl"), "shorturl", "left_anti")
        .select("request_id", F.lit(True).alias("_won"))
    )
    accepted = ~F.col("_custom") | F.col("_won")
    decided = judged.join(winners, "request_id", "left").withColumn(
        "status", F.coalesce(F.col("_failed"), F.when(accepted, 200), F.lit(404))
    )
    granted = F.when(F.col("status") == 200, F.col("_code")).alias("shorturl")
    outcomes = decided.select("request_id", "status", granted)
    new_links = decided.filter("status = 200").select(
        "request_id",
        "redirecturl",
        F.col("_code").alias("shorturl"),
        "token",
        present_or_null(F.col("password")).alias("password"),
    )
    return outcomes, new_links


def remove_links(
    requests: DataFrame, links: DataFrame, clicks: DataFrame | Buckets
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcome of each removal, and the links and clicks that stay.

    The owner of a code removes every link and click row with that code. Within
    a batch the lowest permitted `request_id` does it; a later request for the
    code finds nothing any more. Clicks stored in buckets of the code are not moved.
    """
    blank = F.when(~present(F.coalesce("shorturl", F.lit(""))), F.lit("code missing")).when(
        ~present(F.coalesce("token", F.lit(""))), F.lit("token missing")
    )
    pairs = (
        requests.filter(blank.isNull())
        .groupBy("token", "shorturl")
        .agg(F.min("request_id").alias("request_id"))
    )
    owned = pairs.join(links.select("token", "shorturl"), ["token", "shorturl"], "left_semi")
    winners = owned.groupBy("shorturl").agg(F.min("request_id").alias("request_id"))
    done = winners.select("request_id", F.lit(True).alias("_done"))
    outcomes = (
        requests.select("request_id", blank.alias("_blank"))
        .join(done, "request_id", "left")
        .select(
            "request_id",
            F.when(F.col("_blank").isNotNull(), 400)
            .when(F.col("_done"), 200)
            .otherwise(404)
            .alias("status"),
            F.coalesce("_blank", F.when(F.col("_done").isNull(), F.lit("not found"))).alias("reason"),
        )
    )
    removed = winners.select("shorturl")
    return (
        outcomes,
        lookup_join(links, removed, ["shorturl"], "left_anti"),
        clicks.without_keys(removed)
        if isinstance(clicks, Buckets)
        else lookup_join(clicks, removed, ["shorturl"], "left_anti"),
    )


def list_links(links: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links of the given owners; here any stored password counts, an empty one too."""
    mine = lookup_join(links, tokens.select("token").distinct(), ["token"], "left_semi")
    return mine.select(
        "id", "redirecturl", "shorturl", F.col("password").isNotNull().alias("password")
    )


def list_outcomes(requests: DataFrame, links: DataFrame) -> DataFrame:
    """(request_id, status, links) of each list request: without a token 400, else 200; links
    is how many are listed, 0 also for a token that owns none or is unknown."""
    owned = links.groupBy("token").agg(F.count(F.lit(1)).alias("_links"))
    judged = lookup_join(requests.select("request_id", "token"), owned, ["token"])
    given = present(F.col("token"))
    return judged.select(
        "request_id",
        F.when(given, 200).otherwise(400).alias("status"),
        F.when(given, F.coalesce("_links", F.lit(0))).otherwise(0).alias("links"),
    )


def number_links(links: DataFrame, **options) -> DataFrame:
    """Add `seq`, the place 1.. of a link in its owner's list."""
    return sequence_number(links, "id", ["token"], **options)


def link_report(listed: DataFrame, host: str) -> DataFrame:
    """Display columns of listed links."""

    def url(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    code = F.col("shorturl")
    return listed.select(
        "id",
        F.when(F.col("password"), F.lit("\U0001f512")).otherwise("").alias("lock"),
        url(host, "/api/short/", code).alias("link_text"),
        url("https://", host, "/api/short/", code).alias("link"),
        F.col("redirecturl").alias("target_text"),
        normalize_url(F.col("redirecturl")).alias("target"),
        url("https://", host, "/shorturlanalytics?shorturl=", code).alias("analytics_link"),
    )
