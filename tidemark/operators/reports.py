"""Reports over notices, runs, users and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alerts import top_per_group
from .search import any_phrase, open_at


def portal_counts(notices: DataFrame) -> DataFrame:
    return notices.groupBy("portal").agg(F.count("*").alias("n"))


def dashboard_stats(notices: DataFrame, as_of: Column, phrases: list[str], text: Column) -> DataFrame:
    """One scan: total, closing within 7 days, created since the start of the day, open notices with a watched phrase."""
    return notices.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("closing").between(as_of, as_of + F.expr("interval 7 days"))).alias("closing_soon"),
        F.count_if(F.col("created") >= F.date_trunc("day", as_of)).alias("created_today"),
        F.count_if(open_at(as_of) & any_phrase(text, phrases)).alias("phrase_matches"),
    )


def stated_totals(runs: DataFrame) -> DataFrame:
    """The latest total that each portal stated; ties of the start time go to the larger run id."""
    stated = runs.where(F.col("stated_total").isNotNull())
    return stated.groupBy("portal").agg(F.max_by("stated_total", F.struct("started", "run_id")).alias("stated_total"))


def stated_summary(totals: DataFrame, portal: str) -> DataFrame:
    """Over ``stated_totals``: their sum, the number of portals that stated one, and the total of one portal, or 0."""
    named = F.sum(F.when(F.col("portal") == portal, F.col("stated_total")))
    return totals.agg(F.coalesce(F.sum("stated_total"), F.lit(0)).alias("total_reported"), F.count("*").alias("portals_reporting"), F.coalesce(named, F.lit(0)).alias("named_total"))


def coverage(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Stored and stated numbers of each portal, and the gap, never negative."""
    both = counts.join(totals, "portal", "full")
    return both.select("portal", F.coalesce("n", F.lit(0)).alias("n_stored"), "stated_total", F.greatest(F.lit(0), F.col("stated_total") - F.coalesce("n", F.lit(0))).alias("gap"))


def last_finished(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max(F.when(F.col("status").isin("success", "partial"), F.col("finished"))).alias("last_finished"))


def portal_summary(registry: DataFrame, runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Registry with last run, last success and number of notices.

    Runs shrink to one row a portal before any join; the joins are small whatever the log holds.
    """
    when = F.struct("started", "run_id")
    last = runs.groupBy("portal").agg(
        F.max_by("status", when).alias("last_status"),
        F.max("started").alias("last_started"),
        F.max(F.when(F.col("status") == "success", F.col("started"))).alias("last_success"),
    )
    return registry.join(last, "portal", "left").join(counts, "portal", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def portal_health(enabled: Column, assisted: Column, status: Column) -> Column:
    """disabled (without an assisted path), running, never run, ok, failed, else the status itself."""
    return F.when(~enabled & ~assisted, "disabled").when(status == "running", "running").when(status.isNull(), "never run").when(status == "success", "ok").when(status == "failed", "failed").otherwise(status)


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return top_per_group(runs, ["portal"], [F.desc("started"), F.desc("run_id")], n)


def run_report(runs: DataFrame, portal: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """The latest runs, at most 200."""
    out = runs.where(F.col("portal") == portal) if portal else runs
    out = out.where(F.col("status") == status) if status else out
    return out.orderBy(F.desc("started"), F.desc("run_id")).limit(min(200, max(1, limit)))


def run_status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("portal", "status").agg(F.count("*").alias("n"))


def run_duration(started: Column, finished: Column, as_of: Column) -> Column:
    """Whole seconds from start to finish, or to ``as_of`` while running; never negative."""
    end = F.coalesce(finished.cast("timestamp"), as_of.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(end) - F.unix_micros(started.cast("timestamp"))) / 1_000_000))


def age(at: Column, as_of: Column) -> Column:
    """How long ago, in whole minutes, hours or days; a moment or the future is just now."""
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    hours = F.floor(minutes / 60)
    return F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).otherwise(ago(F.floor(hours / 24), "d"))


def closing_urgency(closing: Column, as_of: Column) -> Column:
    """closed, urgent (within a day), soon (within three), normal; null without a date."""
    days = (F.unix_micros(closing.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 86_400_000_000
    return F.when(closing.isNull(), None).when(days < 0, "closed").when(days <= 1, "urgent").when(days <= 3, "soon").otherwise("normal")


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Sessions that are active and not expired, with their user."""
    return sessions.where(F.col("active") & (F.col("expires") > as_of)).join(users, "user_id")


def user_report(users: DataFrame, sessions: DataFrame, alerts: DataFrame, subscriptions: DataFrame | None = None) -> DataFrame:
    """Users with their numbers of sessions and alerts, zero included; both are counted before the join. And their subscription, if given."""
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    out = users.join(count(sessions, "n_sessions"), "user_id", "left").join(count(alerts, "n_alerts"), "user_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_sessions", "n_alerts")})
    return out if subscriptions is None else out.join(subscriptions, "user_id", "left")


def relevance_counts(notices: DataFrame) -> DataFrame:
    return notices.groupBy("relevance").agg(F.count("*").alias("n"))


def stated_sum(listed: DataFrame, key: str, count: str) -> DataFrame:
    """Total of an index, and of its distinct entries."""
    return listed.agg(F.sum(count).alias("stated_total"), F.count_distinct(key).alias("n_distinct"))
