"""Continuous ingest: files of normalised notices, one merge and one alert step for each micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.lifecycle import KEYS, is_valid, merge_actions
from ..sources import feed
from ..sources.store import read_version

COUNTERS = ["rows", "inserted", "updated", "skipped", "failed", "closed_on_arrival"]
RUN = "query string, batch long, run string, status string, started timestamp, finished timestamp, " + ", ".join(f"{c} long" for c in COUNTERS) + ", message string"


def changed_rows(actions: DataFrame, data: list[str], as_of, run: str) -> DataFrame:
    """(keys, v, last_seen_at, last_seen_run, inserted, updated): what a merge's actions change, one row for each key that is not skipped, with how many of its rows did what."""
    wrote = F.col("action").isin("insert", "update")
    version = F.max_by(F.when(wrote, F.struct(*data)), F.when(wrote, F.col("ordinal"))).alias("v")
    did = [F.count_if(F.col("action") == a).alias(c) for c, a in (("inserted", "insert"), ("updated", "update"))]
    seen = actions.where("action <> 'skip'").groupBy(*KEYS).agg(version, *did)
    return seen.select(*KEYS, "v", as_of.alias("last_seen_at"), F.lit(run).alias("last_seen_run"), "inserted", "updated")


def log_run(spark: SparkSession, root: str, query: str, batch: int, run: str, status: str, started: datetime, finished: datetime | None = None, counted: dict | None = None, message: str | None = None) -> None:
    """The one row of a batch in a query's run log: a replay and a change of status replace it."""
    row = (query, batch, run, status, started, finished, *[(counted or {}).get(c) for c in COUNTERS], message)
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/{query}-{batch}")


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """All runs: running, success, partial (rows failed and nothing else came), failed with its message, or skipped."""
    try:
        return spark.read.schema(RUN).parquet(f"{root}/runs/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN)


class Endings(StreamingQueryListener):
    """Tells the run log of streams that ended by an error outside of a batch, such as a source that cannot be read."""

    def __init__(self) -> None:
        self.on_error: dict[str, Callable[[str], None]] = {}
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 (names of the interface)
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        tell = self.on_error.pop(self.names.pop(str(event.runId), ""), None)
        if tell and event.exception:
            tell(event.exception)


_listening: dict[str, Endings] = {}


def endings(spark: SparkSession) -> Endings:
    """The listener of a session's application, added once."""
    own = spark.sparkContext.applicationId
    if own not in _listening:
        _listening[own] = Endings()
        spark.streams.addListener(_listening[own])
    return _listening[own]


def start_ingest(
    spark: SparkSession,
    source: str,
    schema: str,
    root: str,
    checkpoint: str,
    as_of: Callable[[int], str],
    alerts: Callable[[DataFrame, int], None] | None = None,
    on_counters: Callable[[int, dict], None] | None = None,
    on_rejects: Callable[[int, DataFrame], None] | None = None,
    max_files: int = 1000,
    name: str = "ingest",
    enabled: bool = True,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None),
) -> StreamingQuery | None:
    """Merges new Parquet files of ``source`` into the table notices at ``root``, respecting its table tombstones.

    ``as_of(batch)`` is the reference time of a batch. Rows act in the order of their ``ordinal``, if the schema has one, else of
    their file's time and name and their place in it. Rows without a key or title are rejected and do not stop the others. A batch reads the keys and hashes of
    the stored rows it meets, and appends what it changes to the table's feed (``sources/feed.py``), so its writes follow its own size; a feed
    that has outgrown its base is folded before the next batch. A replayed batch merges against the same rows as before, as it is left out of what it
    meets, and replaces its own changes and its row of the run log (``run_log``): success or partial with its counters, failed with
    the error. A stream that ends by an error outside of a batch leaves a failed row, too. A source that is not ``enabled`` is not read: its row says skipped, and there is no query to return. Counters are
    counted from the batch and from what it wrote, by queries of their own: a figure observed on the way counts again what another executor or a repeated stage computes again.

    Alerts run after each batch and must consult the sent log, which makes them safe to repeat. Ids that were suppressed or expired never
    come back: tombstones are a stored table, not stream state with a time limit.
    """
    if not enabled:
        now = clock()
        log_run(spark, root, name, -1, f"{name}-disabled", "skipped", now, now, message="the source is disabled")
        return None
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    if "ordinal" not in stream.columns:
        stream = stream.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index").alias("ordinal"))

    def merge(batch: DataFrame, number: int, run: str) -> dict:
        feed.fold(spark, root, "notices", KEYS, before=number)
        now = F.lit(as_of(number)).cast("timestamp")
        data = [c for c in read_version(spark, root, "notices").columns if c not in (*KEYS, *feed.SEEN)]
        rows = batch.withColumn("valid", is_valid())
        # Computed once, though actions, keys and rejects all use it; what is lost is read again from the files.
        rows = rows.persist()
        try:
            good = rows.where("valid").drop("valid")
            stored = feed.present_keys(spark, root, "notices", KEYS, good, ["content_hash"], before=number)
            actions = merge_actions(good, stored, read_version(spark, root, "tombstones").join(good.select(KEYS), KEYS, "left_semi"), now)
            feed.append(root, "notices", changed_rows(actions, data, now, run), number)
            came = rows.agg(F.count_if("valid").alias("rows"), F.count_if(~F.col("valid")).alias("failed"), F.count_if(F.col("valid") & (F.col("closing") < now)).alias("closed_on_arrival")).first().asDict()
            did = feed.totals(spark, root, "notices", number, ["inserted", "updated"])
            counted = {"rows": came["rows"]} | did | {"skipped": came["rows"] - sum(did.values())} | {c: came[c] for c in ("failed", "closed_on_arrival")}
            if on_rejects:
                on_rejects(number, rows.where("not valid").drop("valid"))
        finally:
            rows.unpersist()
        return counted

    known: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        run, started = f"batch-{number}", clock()
        log_run(spark, root, name, number, run, "running", started)
        try:
            counted = merge(batch, number, run)
            if alerts:
                seen = feed.seen_since(spark, root, "notices", KEYS, number)
                alerts(feed.present_keys(spark, root, "notices", KEYS, seen, [c for c in read_version(spark, root, "notices").columns if c not in KEYS]), number)
        except Exception as e:
            known.append(number)
            log_run(spark, root, name, number, run, "failed", started, clock(), message=f"{type(e).__name__}: {e}"[:1000])
            raise
        nothing_else = counted["failed"] > 0 and counted["inserted"] + counted["updated"] + counted["skipped"] == 0
        log_run(spark, root, name, number, run, "partial" if nothing_else else "success", started, clock(), counted)
        if on_counters:
            on_counters(number, counted | {"status": "partial" if nothing_else else "success"})

    def ended(error: str) -> None:
        if not known:  # no batch's own failure
            now = clock()
            log_run(spark, root, name, -1, f"{name}-unread", "failed", now, now, message=error[:1000])

    title = f"{name}-{uuid.uuid4().hex}"
    endings(spark).on_error[title] = ended
    return stream.writeStream.queryName(title).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
