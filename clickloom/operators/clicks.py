"""Resolving hits, building clicks, reports, and password unlocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rules import first_present, normalize_url, present, utc_second
from clickloom.plans.skew import first_per_key, key_counts, lookup_join
from clickloom.sources.buckets import Buckets


def _targets(links: DataFrame) -> DataFrame:
    """One row per code: a code may be stored twice, the lowest id counts."""
    return first_per_key(
        links,
        "shorturl",
        "id",
        [
            F.lit(True).alias("_known"),
            F.col("redirecturl").alias("_target"),
            F.col("password").alias("_password"),
        ],
    )


def _protected() -> Column:
    return present(F.coalesce("_password", F.lit("")))


def resolve_hits(hits: DataFrame, links: DataFrame) -> DataFrame:
    """404 for an unknown code, 200 (password page) for a protected link, else 302."""
    joined = lookup_join(hits, _targets(links), ["shorturl"])
    outcome = F.when(F.col("_known").isNull(), 404).when(_protected(), 200).otherwise(302)
    return joined.withColumn("outcome", outcome).select(
        *hits.columns,
        "outcome",
        F.when(F.col("outcome") == 302, normalize_url(F.col("_target"))).alias("location"),
    )


def enrich_geo(
    hits: DataFrame, geo: DataFrame, how: str = "left", weights: DataFrame | None = None
) -> DataFrame:
    """Add isp, city, region and country by `ip`; `how="inner"` drops failed lookups."""
    places = geo.select("ip", "isp", "city", "region", "country")
    return lookup_join(hits, places, ["ip"], how, weights=weights)


def build_clicks(hits: DataFrame, links: DataFrame, geo: DataFrame, how: str = "left") -> DataFrame:
    """Click rows of the hits on known codes, in the stored column layout."""
    seen = hits.select(
        "id",
        "shorturl",
        utc_second(F.col("ts")).alias("timestamp"),
        first_present(F.col("xff"), F.col("remote_addr")).alias("ip"),
        "useragent",
    )
    known = lookup_join(seen, _targets(links), ["shorturl"], "inner").select(
        *seen.columns,
        F.col("_target").alias("referrer"),
        F.when(_protected(), "No").otherwise("N/A").alias("password_status"),
    )
    # Busy addresses are counted on the hits themselves, not behind the join.
    return enrich_geo(known, geo, how, key_counts(seen, ["ip"])).select(
        "id",
        "shorturl",
        "timestamp",
        "ip",
        "useragent",
        "referrer",
        "isp",
        "city",
        "region",
        "country",
        "password_status",
    )


def clicks_for(clicks: DataFrame | Buckets, codes: DataFrame) -> DataFrame:
    """All click rows of the given codes; clicks stored in buckets of the code stay there."""
    if isinstance(clicks, Buckets):
        return clicks.with_keys(codes)
    wanted = codes.select("shorturl").distinct()
    return lookup_join(clicks, wanted, ["shorturl"], "left_semi")


def analytics_outcome(
    requests: DataFrame, clicks: DataFrame | Buckets, links: DataFrame
) -> DataFrame:
    """Per request: 400 blank, 200 with clicks, 201 link without clicks, 404 neither.

    Clicks are looked at first, so clicks whose link is gone still give 200. Of clicks
    stored in buckets of the code only that column is read, and no row of it is moved.
    """
    asked = requests.select("shorturl").filter(present(F.col("shorturl"))).distinct()
    if isinstance(clicks, Buckets):
        codes = clicks.keys_in_use(asked)
    else:
        codes = clicks.select("shorturl").distinct()
    clicked = codes.withColumn("_clicked", F.lit(True))
    linked = links.select("shorturl").distinct().withColumn("_linked", F.lit(True))
    per_code = (
        asked.join(clicked, "shorturl", "left")
        .join(linked, "shorturl", "left")
        .select("shorturl", F.when(F.col("_clicked"), 200).when(F.col("_linked"), 201).alias("_s"))
    )
    joined = lookup_join(requests, per_code, ["shorturl"])
    blank = ~present(F.coalesce("shorturl", F.lit("")))
    return joined.select(
        *requests.columns, F.when(blank, 400).otherwise(F.coalesce("_s", F.lit(404))).alias("status")
    )


def click_totals(links: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks per code, 0 for a link without any."""
    counted = clicks.groupBy("shorturl").agg(F.count(F.lit(1)).alias("clicks"))
    return (
        links.select("shorturl")
        .distinct()
        .join(counted, "shorturl", "left")
        .select("shorturl", F.coalesce("clicks", F.lit(0)).alias("clicks"))
    )


def click_report(clicks: DataFrame) -> DataFrame:
    """The report columns in their fixed order, with the link to follow."""
    return clicks.select(
        "timestamp",
        "ip",
        F.col("referrer").alias("redirect"),
        normalize_url(F.col("referrer")).alias("redirect_link"),
        "isp",
        F.col("password_status").alias("authorized"),
        "city",
        "region",
        "country",
        "useragent",
    )


def unlock_outcomes(attempts: DataFrame, links: DataFrame, clicks: DataFrame) -> DataFrame:
    """Status of each attempt (click_id, shorturl, password).

    `matched` is the number of click rows the update meets, NULL where it is not
    reached.
    """
    blank = F.lit(False)
    for name in ("click_id", "password", "shorturl"):
        blank = blank | ~present(F.coalesce(F.col(name).cast("string"), F.lit("")))
    asked = attempts.withColumn("_blank", blank)
    checked = lookup_join(asked, _targets(links), ["shorturl"])
    right = F.col("password") == F.col("_password")
    checked = checked.withColumn(
        "_failed",
        F.when(F.col("_blank"), 400)
        .when(F.col("_known").isNull(), 404)
        .when(F.coalesce(right, F.lit(False)), F.lit(None))
        .otherwise(401),
    )
    # Only right passwords are looked up among the clicks.
    checked = checked.withColumn("_id", F.when(F.col("_failed").isNull(), F.col("click_id")))
    # Of all click ids only the tried ones go on: few attempts are broadcast to the clicks.
    tried = attempts.select(F.col("click_id").alias("_id"))
    ids = (
        clicks.select(F.col("id").alias("_id"))
        .join(tried.dropna().distinct(), "_id", "left_semi")
        .withColumn("_found", F.lit(1).cast("long"))
    )
    joined = lookup_join(checked, ids, ["_id"], weights=key_counts(tried, ["_id"])).withColumn(
        "matched", F.when(F.col("_failed").isNull(), F.coalesce("_found", F.lit(0)))
    )
    status = F.coalesce("_failed", F.when(F.col("matched") > 0, 200).otherwise(404))
    return joined.select(
        *attempts.columns,
        status.alias("status"),
        F.when(F.col("matched") > 0, normalize_url(F.col("_target"))).alias("location"),
        "matched",
    )


def unlock_effect(outcomes: DataFrame) -> DataFrame:
    """Rows met by the update of each attempt that got that far."""
    return outcomes.filter(F.col("matched").isNotNull()).select("click_id", "shorturl", "matched")


def apply_unlocks(clicks: DataFrame, outcomes: DataFrame, strict: bool = False) -> DataFrame:
    """Clicks with the status after the successful attempts.

    The click id alone decides, as in the service; `strict` also compares the code.
    Both sides are unique on the key, so no key is hot.
    """
    keys = ["id", "shorturl"] if strict else ["id"]
    opened = (
        outcomes.filter("status = 200")
        .select(F.col("click_id").alias("id"), "shorturl")
        .select(*keys)
        .distinct()
        .withColumn("_opened", F.lit(True))
    )
    status = F.when(F.col("_opened"), "Yes").otherwise(F.col("password_status"))
    return (
        clicks.join(opened, keys, "left")
        .withColumn("password_status", status)
        .select(*clicks.columns)
    )
