"""Tenancy: scoped look-ups, plans and quotas, admission, upserts, a login limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plan, sessions at once, users, minutes a month, days kept.
PLANS = [("starter", 5, 60, 1200, 30), ("business", 25, 180, 12000, 180), ("enterprise", 100, 480, 120000, 730)]


def plan_table(spark) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, max_sessions int, max_minutes int, monthly_minutes int, days int")


def in_scope(df: DataFrame, organization: Column, key: Column) -> DataFrame:
    """Rows of one organisation by key; another tenant's row is as absent as a missing one."""
    return df.filter((F.col("organization_id") == organization) & key)


def normal_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def email_collisions(users: DataFrame) -> DataFrame:
    """Emails that more than one user of an organisation has."""
    return users.groupBy("organization_id", normal_email(F.col("email")).alias("email")).agg(F.count("*").alias("n_users"), F.min("user_id").alias("first_user")).filter("n_users > 1")


def with_plan(organizations: DataFrame, plans: DataFrame, default: str = "starter") -> DataFrame:
    """Organisations with their plan's limits; an unknown plan counts as the default one."""
    known = organizations.join(plans.select("plan"), "plan", "left_semi").select("organization_id").withColumn("known", F.lit(True))
    named = organizations.join(known, "organization_id", "left").withColumn("plan", F.when(F.col("known"), F.col("plan")).otherwise(default)).drop("known")
    return named.join(plans, "plan", "left")


def admissions(requests: DataFrame, organizations: DataFrame, platform_max: int) -> DataFrame:
    """Decides requests (organization_id, live, platform_live); organizations has status and max_sessions.

    The first reason counts: platform full, unknown organisation, inactive, over its quota.
    """
    df = requests.join(organizations.select("organization_id", "status", "max_sessions"), "organization_id", "left")
    decision = (
        F.when(F.col("platform_live") >= platform_max, "platform_full")
        .when(F.col("status").isNull(), "unknown_organization")
        .when(~F.col("status").isin("active", "trial"), "organization_inactive")
        .when(F.col("live") >= F.col("max_sessions"), "quota_exceeded")
        .otherwise("accept")
    )
    retry = F.when(decision == "platform_full", 15).when(decision == "quota_exceeded", 30)
    return df.withColumn("decision", decision).withColumn("retry_after", retry)


def monthly_minutes(sessions: DataFrame) -> DataFrame:
    """Completed minutes by organisation and month, with totals of both (rollup)."""
    done = sessions.filter("status = 'completed'").withColumn("month", F.date_format("started_at", "yyyy-MM"))
    return done.rollup("organization_id", "month").agg(F.bround(F.sum("minutes"), 6).alias("minutes"), F.count("*").alias("n_sessions"), F.grouping_id().cast("long").alias("level"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; the columns ``keep`` of an existing row stay."""
    fields = [c for c in old.columns if c != key]
    joined = old.select(key, F.struct(*fields).alias("o")).join(new.select(key, F.struct(*fields).alias("n")), key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(key, *(pick(c).alias(c) for c in fields))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def rejected_writes(new: DataFrame, users: DataFrame, organizations: DataFrame) -> DataFrame:
    """New users that break a constraint, with its name."""
    taken = users.select("organization_id", normal_email(F.col("email")).alias("email")).distinct().withColumn("taken", F.lit(True))
    known = organizations.select("organization_id").distinct().withColumn("known", F.lit(True))
    df = new.withColumn("email", normal_email(F.col("email"))).join(known, "organization_id", "left").join(taken, ["organization_id", "email"], "left")
    reason = F.when(F.col("known").isNull(), "unknown organization").when(F.col("taken"), "email in use")
    return df.withColumn("reason", reason).filter("reason IS NOT NULL").select("user_id", "organization_id", "reason")


def limit_logins(attempts: DataFrame, most: int = 10, seconds: float = 300.0) -> DataFrame:
    """Marks attempts (key, at, attempt_id) as allowed: at most ``most`` allowed ones in any ``seconds``.

    Refused attempts don't count, so each answer depends on those before: the attempts of a key
    stream through a task in order, which keeps the last ``most`` allowed times only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = object(), []
        for batch in batches:
            allowed = []
            for k, at in zip(batch["key"], batch["at"], strict=True):
                if k != key:
                    key, recent = k, []
                recent = [t for t in recent if at - t < seconds]
                ok = len(recent) < most
                if ok:
                    recent.append(at)
                allowed.append(ok)
            yield batch.assign(allowed=allowed)

    ordered = attempts.select("key", "at", "attempt_id").repartition("key").sortWithinPartitions("key", "at", "attempt_id")
    return ordered.mapInPandas(run, attempts.select("key", "at", "attempt_id").schema.add("allowed", "boolean"))
