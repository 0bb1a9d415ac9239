"""Query cost: spending per user and period, budgets, the most expensive queries. Costs are whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.operators import ordered
from govspark.runtime import floor_to, small_side

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
PREVIEW = 200


def cost_by_user(log: DataFrame, budgets: DataFrame, default_daily_cents: int) -> DataFrame:
    """Per user, spending and queries per UTC day and per UTC hour, with the share of the daily budget used."""
    grouped = (log.select("user_name", "cost_cents", floor_to("ts_us", DAY_US).alias("day_us"),
                          floor_to("ts_us", HOUR_US).alias("hour_us"))
               .groupBy("user_name", "day_us", "hour_us")
               .agg(F.sum("cost_cents").alias("cost_cents"), F.count(F.lit(1)).alias("queries")))
    days = grouped.groupBy("user_name", "day_us").agg(F.sum("cost_cents").alias("cost_cents"), F.sum("queries").alias("queries"))
    both = days.select("user_name", F.lit("day").alias("period"), F.col("day_us").alias("start_us"), "cost_cents", "queries").unionByName(
        grouped.select("user_name", F.lit("hour").alias("period"), F.col("hour_us").alias("start_us"), "cost_cents", "queries"))
    limit = F.coalesce("daily_cents", F.lit(default_daily_cents))
    return both.join(small_side(budgets.select("user_name", "daily_cents")), "user_name", "left").withColumn(
        "budget_pct", F.when((F.col("period") == "day") & (limit > 0), F.round(F.col("cost_cents") / limit * 100, 6))
    ).drop("daily_cents")


def budget_decisions(log: DataFrame, budgets: DataFrame, default_daily_cents: int, default_hourly_cents: int) -> DataFrame:
    """The exact outcome of admitting queries under daily and hourly budgets, as ``outcome``:
    admitted, daily_exceeded or hourly_exceeded. Costs are not negative; a limit of 0 means none.

    Rejected queries cost nothing, so within an hour a user is admitted up to the first query that finds
    either sum at its limit, and rejected until the hour ends. Hence an hour before the day's limit is
    reached contributes the smallest prefix sum that reaches the hourly limit (or all of it), and the
    day's spending before an hour is the sum of those — no row-by-row feedback is left.
    """
    rows = (log.withColumn("_hour", floor_to("ts_us", HOUR_US)).withColumn("_day", floor_to("ts_us", DAY_US))
            .join(small_side(budgets.select("user_name", "daily_cents", "hourly_cents")), "user_name", "left")
            .withColumn("_daily", F.coalesce("daily_cents", F.lit(default_daily_cents)))
            .withColumn("_hourly", F.coalesce("hourly_cents", F.lit(default_hourly_cents))))
    rows = ordered.prior_sums(rows, ["user_name", "_hour"], ["ts_us", "audit_id"], {"_spent": F.col("cost_cents")})
    upto = F.col("_spent") + F.col("cost_cents")
    hours = rows.groupBy("user_name", "_day", "_hour").agg(
        F.sum("cost_cents").alias("_all"),
        F.min(F.when((F.col("_hourly") > 0) & (upto >= F.col("_hourly")), upto)).alias("_capped"))
    past = W.partitionBy("user_name", "_day").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    hours = hours.select("user_name", "_hour", "_capped",
                         F.coalesce(F.sum(F.coalesce("_capped", "_all")).over(past), F.lit(0)).alias("_before"))
    decided = rows.join(hours, ["user_name", "_hour"])
    room = F.col("_daily") - F.col("_before")
    by_day = (F.col("_daily") > 0) & (F.col("_spent") >= room)
    by_hour = (F.col("_hourly") > 0) & (F.col("_spent") >= F.col("_hourly"))
    # The daily limit is named first; it also holds when the query that met the hourly one passed both.
    names_day = (F.col("_daily") > 0) & ((F.col("_hourly") <= 0) | (room < F.col("_hourly"))
                                         | F.coalesce(F.col("_capped") >= room, F.lit(False)))
    outcome = F.when(~by_day & ~by_hour, "admitted").when(names_day, "daily_exceeded").otherwise("hourly_exceeded")
    return decided.withColumn("outcome", outcome).drop(
        "_hour", "_day", "_daily", "_hourly", "_spent", "_before", "_capped", "daily_cents", "hourly_cents")


def top_cost_queries(log: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most expensive queries, with at most 200 characters of their text."""
    preview = F.when(F.char_length("sql_text") > PREVIEW, F.concat(F.substring("sql_text", 1, PREVIEW), F.lit("..."))).otherwise(F.col("sql_text"))
    return log.select("audit_id", "user_name", "cost_cents", preview.alias("sql_preview")).orderBy(
        F.desc("cost_cents"), "audit_id").limit(n)
