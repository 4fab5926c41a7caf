"""The run log's counters are exact when cached rows are computed more than once, as they are on several executors."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tidemark.sources.store import write_version
from tidemark.streaming.ingest import run_log, start_ingest

ROW = "portal string, notice_id string, title string, closing timestamp, content_hash string"


def test_rows_that_no_cache_holds_count_once(spark, tmp_path, monkeypatch):
    # Off-heap memory is not set up here: no block can be kept, so each use computes the rows again.
    persist = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *level: persist(self, StorageLevel(False, True, True, False)))
    root, source = str(tmp_path / "store"), str(tmp_path / "in")
    stored = spark.createDataFrame([("p", "1", "old", None, "h0", None, "r"), ("p", "2", "same", None, "h", None, "r")], ROW + ", last_seen_at timestamp, last_seen_run string")
    gone = spark.createDataFrame([("p", "dead", None, None)], "portal string, notice_id string, closed_at timestamp, deleted_at timestamp")
    write_version(spark, root, {"notices": stored, "tombstones": gone})
    rows = [("p", "1", "new", None, "h1"), ("p", "2", "same", None, "h"), ("p", "3", "x", None, "h"), ("p", "dead", "b", None, "h"), ("p", None, "d", None, "h")]
    spark.createDataFrame(rows, ROW).write.parquet(source)
    start_ingest(spark, source, ROW, root, str(tmp_path / "cp"), lambda n: "2026-07-01 00:00:00").awaitTermination(120)
    found = run_log(spark, root).select("rows", "inserted", "updated", "skipped", "failed", "closed_on_arrival").collect()
    assert [tuple(r) for r in found] == [(4, 1, 1, 2, 1, 0)]
