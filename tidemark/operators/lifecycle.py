"""Change-data operators on keyed notices: merge, expire, suppress, upsert, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, legacy_relevance, relevance

KEYS = ["portal", "notice_id"]


def with_hash(notices: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``content_hash`` over the named columns, in the order of their names."""
    return notices.withColumn("content_hash", content_hash({c: F.col(c) for c in columns}))


def is_valid(required: tuple[str, ...] = ("portal", "notice_id", "title")) -> Column:
    """Whether a row can be merged: it has its keys and a title."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.coalesce(F.trim(c) != "", F.lit(False))
    return ok


def backfill_relevance(notices: DataFrame, legacy: bool = False) -> DataFrame:
    """``notices`` with a label where it is null, by the rules of today or by the ``legacy`` set; others keep theirs."""
    rules = legacy_relevance if legacy else relevance
    label = rules(*map(F.col, ("title", "category", "organisation", "department")))
    return notices.withColumn("relevance", F.coalesce("relevance", label))


def merge_actions(batch: DataFrame, stored: DataFrame, tombstones: DataFrame, as_of: Column, ordinal: str = "ordinal", keys: list[str] = KEYS) -> DataFrame:
    """What merging each row of a batch does: insert, update, touch or skip.

    ``batch`` has the keys, closing, content_hash and ``ordinal``, the order of its rows within a key. A key with a
    tombstone is skipped, and so is one that is not stored while its rows so far have all closed before
    ``as_of``. A stored key with an equal hash is touched, otherwise updated. Rows of one key act one after the other: each is compared with the version
    before it. One shuffle of the batch on the keys serves the joins and the windows.
    """
    current = stored.select(*keys, F.col("content_hash").alias("stored_hash"), F.lit(True).alias("exists"))
    gone = tombstones.select(*keys).distinct().withColumn("tombstone", F.lit(True))
    rows = batch.join(current, keys, "left").join(gone, keys, "left")
    per_key = Window.partitionBy(*keys).orderBy(ordinal)
    is_open = F.col("closing").isNull() | (F.col("closing") >= as_of)
    seen_open = F.max(is_open.cast("int")).over(per_key.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("kept", F.col("tombstone").isNull() & (F.coalesce("exists", F.lit(False)) | seen_open))
    # The version before: the hash of the last kept row, else the stored one.
    before = F.last(F.when(F.col("kept"), F.col("content_hash")), ignorenulls=True).over(per_key.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(before, F.col("stored_hash"))
    rows = rows.withColumn("previous_hash", before)
    action = F.when(~F.col("kept"), "skip").when(F.col("previous_hash").isNull(), "insert").when(F.col("previous_hash") == F.col("content_hash"), "touch").otherwise("update")
    return rows.withColumn("action", action).drop("stored_hash", "exists", "tombstone", "kept", "previous_hash")


def merge_counters(actions: DataFrame, failed: int = 0) -> DataFrame:
    """inserted, updated, skipped (touched rows count as skipped) and failed of a merge, in one row."""
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(n("insert").alias("inserted"), n("update").alias("updated"), n("skip", "touch").alias("skipped"), F.lit(failed).cast("long").alias("failed"))


def run_status(inserted: Column, updated: Column, skipped: Column, failed: Column) -> Column:
    """success, partial if rows failed and none did anything else, failed is up to the caller's error."""
    return F.when((failed > 0) & (inserted + updated + skipped == 0), "partial").otherwise("success")


def merge_snapshot(batch: DataFrame, stored: DataFrame, tombstones: DataFrame, as_of: Column, run_id: str, ordinal: str = "ordinal", keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, actions): the last version of each key.

    ``stored`` has the batch's columns (without ordinal) and last_seen_at, last_seen_run. A touched key only moves these two. Running it
    again with the same batch changes nothing else.
    """
    actions = merge_actions(batch, stored, tombstones, as_of, ordinal, keys)
    data = [c for c in batch.columns if c not in (ordinal, *keys)]
    written = F.col("action").isin("insert", "update")
    # The last version that was written; null for keys that were only touched.
    version = F.max_by(F.when(written, F.struct(*data)), F.when(written, F.col(ordinal))).alias("v")
    seen = actions.where("action <> 'skip'").groupBy(*keys).agg(version).withColumn("seen", F.lit(True))
    both = stored.join(seen, keys, "full")
    return both.select(
        *keys,
        *[F.when(F.col("v").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) for c in data],
        F.when(F.col("seen"), as_of.cast("timestamp")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.col("seen"), F.lit(run_id)).otherwise(F.col("last_seen_run")).alias("last_seen_run"),
    ), actions


def expire(notices: DataFrame, tombstones: DataFrame, as_of: Column, grace_days: int = 0, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(survivors, tombstones): notices that closed before ``as_of`` less the grace become tombstones; earlier ones stay."""
    cutoff = as_of - F.make_dt_interval(F.lit(grace_days))
    over = F.coalesce(F.col("closing") < cutoff, F.lit(False))
    fresh = notices.where(over).select(*keys, F.col("closing").cast("timestamp").alias("closed_at"), as_of.cast("timestamp").alias("deleted_at")).dropDuplicates(keys)
    return notices.where(~over), tombstones.unionByName(fresh.join(tombstones, keys, "left_anti"))


def suppress(notices: DataFrame, tombstones: DataFrame, ids: DataFrame, as_of: Column, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(survivors, tombstones) after deleting the keys in ``ids``; closed_at is the closing date or ``as_of``."""
    wanted = ids.select(*keys).distinct()
    hit = notices.join(wanted, keys, "left_semi").dropDuplicates(keys)
    fresh = hit.select(*keys, F.coalesce(F.col("closing").cast("timestamp"), as_of.cast("timestamp")).alias("closed_at"), as_of.cast("timestamp").alias("deleted_at"))
    return notices.join(wanted, keys, "left_anti"), tombstones.unionByName(fresh.join(tombstones, keys, "left_anti"))


def upsert_by_key(current: DataFrame, changes: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last change of each key replaces its row."""
    others = [c for c in current.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), ordinal).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in others])
    return current.join(last, keys, "left_anti").select(current.columns).unionByName(last.select(current.columns))


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and the rows of ``incoming`` whose key it lacks; of repeated ones one."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current, keys, "left_anti").select(current.columns))


def close_orphan_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs that are still running become failed, with a message and a finish time."""
    orphan = F.col("status") == "running"
    return runs.withColumns({"finished": F.when(orphan, as_of).otherwise(F.col("finished")), "message": F.when(orphan, "interrupted").otherwise(F.col("message")), "status": F.when(orphan, "failed").otherwise(F.col("status"))})


def cascade(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Children whose parent was not removed."""
    return children.join(removed.select(key).distinct(), key, "left_anti")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti").where(F.col(child_key).isNotNull())


def staleness(notices: DataFrame, full_runs: DataFrame) -> DataFrame:
    """Notices of a portal that its latest full run (portal, run_started) has not seen."""
    latest = full_runs.groupBy("portal").agg(F.max("run_started").alias("run_started"))
    return notices.join(latest, "portal").where(F.col("last_seen_at") < F.col("run_started"))
