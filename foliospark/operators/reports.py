"""Reports over jobs, users, models and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.jobs import percent


def by_engine(jobs: DataFrame, kind: str = "engine") -> DataFrame:
    """(engine, status) to jobs, completed and failed ones and the success rate of each."""
    sums = jobs.groupBy(kind).agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return sums.withColumn("success_rate", percent(F.col("completed"), F.col("jobs")))


def accuracy(feedback: DataFrame, kind: str = "engine") -> DataFrame:
    """(engine, correct) to rated results and the share of correct ones; unrated ones (null) don't count."""
    rated = feedback.where("correct is not null").groupBy(kind).agg(F.count("*").alias("rated"), F.count_if("correct").alias("correct"))
    return rated.withColumn("accuracy", percent(F.col("correct"), F.col("rated")))


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, prompt_tokens, completion_tokens) and (model, price per 1,000 tokens) to calls, tokens and cost of each model; without a price the cost is null."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    sums = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))
    return sums.join(prices, "model", "left").select("model", "calls", "tokens", (F.col("tokens") / 1000 * F.col("price")).alias("cost"))


def user_activity(events: DataFrame) -> DataFrame:
    """(user_id, action, at) to number, first and last time and active days of each user."""
    return events.groupBy("user_id").agg(F.count("*").alias("actions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_distinct(F.to_date("at")).alias("days"))


def daily(jobs: DataFrame, at: str, seconds: Column) -> DataFrame:
    """Jobs of each day with the mean and the longest time."""
    return jobs.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("jobs"), F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("longest_seconds"))


#: Logarithm of a distinct-count sketch's size: its relative error is some 1.04 / sqrt(2^12), 1.6 %; size of a quantile sketch: ranks are within some 1.65 %.
DISTINCT, QUANTILES = 12, 200
#: What a day's state holds besides its dimensions.
_SUMS = ("jobs", "failed", "seconds", "longest")


def day_state(jobs: DataFrame, dims: list[str], at: str = "at", user: str = "user_id", seconds: str = "seconds", failed: str = "failed") -> DataFrame:
    """Jobs as mergeable state: a row for each day and combination of dims, with sums and with sketches of users and times."""
    return jobs.groupBy(F.to_date(at).alias("day"), *dims).agg(
        F.count("*").alias("jobs"), F.count_if(F.col(failed)).alias("failed"), F.sum(seconds).alias("seconds"), F.max(seconds).alias("longest"),
        F.hll_sketch_agg(user, DISTINCT).alias("users"), F.kll_sketch_agg_double(F.col(seconds).cast("double"), F.lit(QUANTILES)).alias("times"),
    )


def write_state(jobs: DataFrame, path: str, dims: list[str], **columns: str) -> None:
    """Writes the state of the days in jobs, a folder each; those days are replaced, others stay as they are and aren't read."""
    state = day_state(jobs, dims, **columns)
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    jobs.sparkSession.catalog.refreshByPath(path)


def write_users(jobs: DataFrame, path: str, dims: list[str], at: str = "at", user: str = "user_id") -> None:
    """Writes who worked on the days in jobs, a row for each user, day and combination of dims; those days are replaced, as by write_state(). For exact numbers of users."""
    rows = jobs.select(F.to_date(at).alias("day"), *dims, F.col(user).alias("user")).distinct()
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    jobs.sparkSession.catalog.refreshByPath(path)


def exact_users(users: DataFrame, by: list[str]) -> DataFrame:
    """by and users: the exact number of users of what write_users() wrote, null left out."""
    return users.select(*by, "user").distinct().groupBy(*by).agg(F.count("user").alias("users"))


def merged_state(state: DataFrame, by: list[str]) -> DataFrame:
    """State rolled up to fewer dimensions; it is state again, so days make weeks and weeks make years."""
    return state.groupBy(*by).agg(
        *[(F.max if c == "longest" else F.sum)(c).alias(c) for c in _SUMS], F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("times").alias("times"),
    )


def state_report(state: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """jobs, failed ones, success rate, mean and longest time (exact), users and quantiles of times (within the sketches' error) for each of by, from state alone."""
    rolled = merged_state(state, by)
    return rolled.select(
        *by, "jobs", "failed", percent(F.col("jobs") - F.col("failed"), F.col("jobs")).alias("success_rate"), (F.col("seconds") / F.col("jobs")).alias("mean_seconds"), "longest",
        F.hll_sketch_estimate("users").alias("users"), *[F.kll_sketch_get_quantile_double("times", F.lit(float(s))).alias(name) for name, s in shares.items()],
    )
