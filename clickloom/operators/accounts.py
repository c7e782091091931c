"""Sign-up checks and account registration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rules import generate_token, has_whitespace, present
from clickloom.plans.numbering import with_next_ids

# Texts shown to the user.
MISMATCH = "Passwords do not match"
UNFILLED = "Please fill out all fields"
WHITESPACE_IN_PASSWORD = "Password must not contain any whitespace"

REQUIRED = ["firstname", "lastname", "username", "password"]


def _any_blank(names: list[str]):
    blank = F.lit(False)
    for name in names:
        blank = blank | ~present(F.coalesce(name, F.lit("")))
    return blank


def check_signup_form(requests: DataFrame) -> DataFrame:
    """Add `problem`, the first form rule that fails; NULL when the form may be sent."""
    first, again = (F.coalesce(c, F.lit("")) for c in ("password", "password_again"))
    fields = [*REQUIRED, "password_again"]
    return requests.withColumn(
        "problem",
        F.when(first != again, MISMATCH)
        .when(_any_blank(fields), UNFILLED)
        .when(has_whitespace(first), WHITESPACE_IN_PASSWORD),
    )


def complete_requests(requests: DataFrame) -> DataFrame:
    """Registrations that leave no required field out."""
    return requests.filter(~_any_blank(REQUIRED))


def first_requests(requests: DataFrame, key: str) -> DataFrame:
    """The lowest `request_id` per key; combined before the shuffle."""
    return requests.groupBy(key).agg(F.min("request_id").alias("request_id"))


def register(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome of each registration and the accounts to append, with id and token.

    The earliest request for a free name wins. Names are compared as a
    pre-aggregated set; the winner comes back by the unique `request_id`. Tokens are
    drawn when the accounts are written, so write them once.
    """
    winners = first_requests(complete_requests(requests), "username").join(
        users.select("username"), "username", "left_anti"
    )
    won = winners.select("request_id", F.lit(True).alias("_won"))
    judged = requests.join(won, "request_id", "left")
    missing = _any_blank(REQUIRED)
    outcomes = judged.select(
        "request_id",
        F.when(F.col("_won"), 200).otherwise(400).alias("status"),
        F.when(missing, "field missing")
        .when(F.col("_won").isNull(), "name taken")
        .alias("reason"),
    )
    accepted = judged.filter("_won").select(
        "request_id",
        "firstname",
        "lastname",
        "username",
        generate_token().alias("token"),
    )
    return outcomes, with_next_ids(users, accepted, "request_id").select(
        "id", "firstname", "lastname", "username", "token", "request_id"
    )
