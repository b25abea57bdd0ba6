"""User and token tables as snapshots: what the review application asks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(users: DataFrame) -> DataFrame:
    return users.filter("not account_enabled and not is_deleted")


def current(users: DataFrame) -> DataFrame:
    return users.filter("not is_deleted")


def updated(users: DataFrame, changes: DataFrame, key: str = "user_id") -> DataFrame:
    """Users with the non-null columns of ``changes`` (one row a user) put in their place."""
    new = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in new])
    return users.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in new else F.col(x) for x in users.columns])


def email_conflicts(users: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, email): changes to an address that another user has."""
    return (changes.filter("email is not null").alias("c").join(users.alias("u"), (F.lower("c.email") == F.lower("u.email")) & (F.col("c.user_id") != F.col("u.user_id")))
            .select("c.user_id", "c.email").distinct())


def usable(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that are neither used nor over."""
    return tokens.filter(~F.col("is_used") & (F.col("expires_at") > now))


def revoked(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Tokens, those of these users marked used."""
    gone = users.select("user_id", F.lit(True).alias("_gone")).distinct()
    return tokens.join(gone, "user_id", "left").withColumn("is_used", F.col("is_used") | F.coalesce("_gone", F.lit(False))).select(*tokens.columns)


def token_owner(tokens: DataFrame, users: DataFrame, presented: DataFrame) -> DataFrame:
    """(token, user_id, email): presented tokens found by their hash, with the user that they belong to."""
    hashed = presented.select("token", F.sha2("token", 256).alias("token_hash"))
    return hashed.join(tokens, "token_hash").join(users.select("user_id", "email"), "user_id").select("token", "user_id", "email")
