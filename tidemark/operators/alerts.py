"""Keyword alerts: which new notices to send to whom, exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import search
from .text_index import TextIndex, sent

PER_KEYWORD = 20


def live_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Active ones with at least one keyword."""
    return subscriptions.where(F.col("active") & (F.size("keywords") > 0))


def keyword_rows(subscriptions: DataFrame) -> DataFrame:
    """(user_id, keyword) of live subscriptions, repeated keywords once."""
    return live_subscriptions(subscriptions).select("user_id", F.explode("keywords").alias("keyword")).distinct()


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task keeps only its own first ones before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def keyword_matches(notices: DataFrame, keywords: DataFrame, as_of: Column, per_keyword: int = PER_KEYWORD, index: TextIndex | None = None, substrings: TextIndex | None = None) -> DataFrame:
    """(keyword, portal, notice_id, rank): the best open notices of each distinct keyword, searched once for all who share it.

    A keyword is searched as a query of its own, by the whole dispatch of ``search``: a reference finds ids that contain it. With an index the search of words reads
    only their postings, and stops when the best are certain.
    """
    distinct = keywords.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("q")).distinct()
    found = search(notices, distinct, as_of, limit=per_keyword, index=index, totals=False, substrings=substrings)
    return found.select(F.col("query_id").alias("keyword"), "portal", "notice_id", "rank")


def user_matches(subscriptions: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct notices of each user. Matches go to the users' rows if they are few: a keyword that most users have would be one task's."""
    return keyword_rows(subscriptions).join(sent(matches.select("keyword", "portal", "notice_id")), "keyword").select("user_id", "portal", "notice_id").distinct()


def unsent(candidates: DataFrame, sent_log: DataFrame) -> DataFrame:
    return candidates.join(sent_log, ["user_id", "portal", "notice_id"], "left_anti")


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def digests(rows: DataFrame, users: DataFrame, notices: DataFrame) -> DataFrame:
    """One mail a user: address, subject, text and HTML over all their new notices, by portal and id.

    A delivery address wins over the user's own. What a user gets is bounded by keywords * 20 notices.
    """
    full = rows.join(notices.select("portal", "notice_id", "title", "closing", "url"), ["portal", "notice_id"])
    items = F.sort_array(F.collect_list(F.struct("portal", "notice_id", "title", F.coalesce(F.date_format("closing", "yyyy-MM-dd"), F.lit("unknown")).alias("closes"), "url")))
    each = full.groupBy("user_id").agg(items.alias("items"))
    line = lambda x: F.concat(F.lit("- ["), x["portal"], F.lit("] "), x["title"], F.lit(" (closes "), x["closes"], F.lit(") - "), x["url"])
    item = lambda x: F.concat(F.lit("<li><strong>["), escape_html(x["portal"]), F.lit("]</strong> "), escape_html(x["title"]), F.lit("<br/>Closes: "), x["closes"], F.lit(' <a href="'), escape_html(x["url"]), F.lit('">View</a></li>'))
    n = F.size("items")
    out = each.select(
        "user_id",
        n.alias("n_notices"),
        F.concat(n.cast("string"), F.lit(" new notice"), F.when(n == 1, "").otherwise("s"), F.lit(" matching your alerts")).alias("subject"),
        F.array_join(F.transform("items", line), "\n").alias("body"),
        F.concat(F.lit("<ul>"), F.array_join(F.transform("items", item), ""), F.lit("</ul>")).alias("html"),
    )
    return out.join(users.select("user_id", F.coalesce("delivery_email", "email").alias("address")), "user_id")


def cycle_totals(fresh: DataFrame) -> DataFrame:
    """How many users a cycle notifies, and how many notices it sends to them in all."""
    return fresh.agg(F.count_distinct("user_id").alias("users_notified"), F.count("*").alias("notices_sent"))


def alert_cycle(notices: DataFrame, subscriptions: DataFrame, users: DataFrame, sent_log: DataFrame, as_of: Column, index: TextIndex | None = None, substrings: TextIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(digests, log candidates) of the notices that are open at ``as_of``. Delivery happens outside; see ``log_delivered``."""
    matches = keyword_matches(notices, keyword_rows(subscriptions), as_of, index=index, substrings=substrings)
    fresh = unsent(user_matches(subscriptions, matches), sent_log)
    people = users.join(subscriptions.select("user_id", "delivery_email"), "user_id")
    return digests(fresh, people, notices), fresh


def log_delivered(candidates: DataFrame, delivered: DataFrame, sent_log: DataFrame) -> DataFrame:
    """The sent log with the candidates of users whose delivery succeeded; a replay adds nothing."""
    keys = ["user_id", "portal", "notice_id"]
    new = candidates.join(delivered.select("user_id").distinct(), "user_id", "left_semi")
    return sent_log.select(keys).unionByName(new.select(keys).join(sent_log, keys, "left_anti"))


def alert_history(sent_log: DataFrame, n: int = 100) -> DataFrame:
    return top_per_group(sent_log, ["user_id"], [F.desc("sent_at"), F.col("portal"), F.col("notice_id")], n)
