"""Registered queries of the feeds: orders are written as the feeds' JSON and markup, and parsed back."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lifecycle import KEYS
from ..sources import feed, html_feeds, json_feeds, store
from ..streaming.ingest import run_log, start_ingest
from . import views
from .registry import STAMP, query, stamp
from .views import AS_OF, MERGE_SQL, as_of, table

BASE = "https://e.org/app"
FLAT_SQL = "SELECT {} FROM orders"


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))


def _joined(*parts) -> Column:
    """Texts and columns one after the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by_customer(rows, body: Column, begin: str, end: str):
    """One page for each customer: the rows of its orders in a frame."""
    each = rows.groupBy(F.col("o_custkey").alias("page_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    return each.select("page_no", _joined(begin, F.col("rows"), end).alias("html"), F.lit(BASE).alias("base_url"))


def _columns() -> tuple[Column, Column, Column]:
    return F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")


@query(f"""SELECT 'B/' || o_orderkey AS notice_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'Long ' || o_orderkey END AS title, CASE WHEN o_orderstatus = 'O' THEN 'Org' ELSE 'Ministry' END AS organisation, 'Ministry' AS department,
    o_orderpriority AS category, 'Quantity: ' || o_custkey || CASE WHEN o_orderkey % 2 = 1 THEN ' | Rate Contract' ELSE '' END AS description, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value, {STAMP.format('o_orderdate')} AS closing,
    'https://e.org/' || CASE WHEN o_orderkey % 7 = 5 THEN 'showdirectradocumentPdf' WHEN o_orderkey % 7 = 2 THEN 'showradocumentPdf' ELSE 'showbidDocument' END || '/' || o_orderkey AS url FROM orders""")
def array_feed(spark, d):
    key, priority, status = _columns()
    one = F.array
    doc = F.struct(
        one(key).alias("b_id"), one(_joined("B/", key)).alias("b_bid_number"), one(priority).alias("b_category_name"), one(F.when(status != "F", _joined("  Long  ", key))).alias("bd_category_name"),
        one(F.col("o_custkey").cast("string")).alias("b_total_quantity"), one(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("b_total_value"), one((key % 7).cast("int")).alias("b_bid_type"), one((key % 2).cast("int")).alias("is_rc_bid"),
        one(F.lit("Ministry")).alias("ba_official_details_minName"), one(F.when(status == "O", "Org")).alias("ba_official_details_orgName"), one(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("final_end_date_sort"),
    )
    docs = _orders(spark, d).select(F.from_json(F.to_json(doc, {"ignoreNullFields": "false"}), json_feeds.ARRAY_FEED).alias("d")).select("d.*")
    found = json_feeds.array_feed(docs, "p", "https://e.org")
    return found.select("notice_id", "title", "organisation", "department", "category", "description", F.col("value").cast("string").alias("value"), stamp("closing").alias("closing"), "url")


@query(f"""SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS VARCHAR) AS notice_id, o_orderpriority AS title, CASE WHEN o_custkey % 3 <> 0 THEN 'S Organisation ' || o_custkey % 3 END AS organisation,
    CASE WHEN o_custkey % 5 <> 0 THEN 'Department ' || o_custkey % 5 END AS department, o_orderpriority || ' | R' || o_orderkey AS description, {STAMP.format('o_orderdate')} AS closing FROM orders WHERE o_orderstatus <> 'P'""")
def epoch_feed(spark, d):
    key, priority, status = _columns()
    doc = F.struct(
        key.alias("currenttenderid"), F.when(key % 3 == 0, -key).alias("currentOrgTenderId"), _joined(" R", key).alias("currenttenderrefno"), F.when(status == "P", " ").otherwise(priority).alias("currentdescription"),
        (F.col("o_custkey") % 5).alias("currentdeptid"), (F.col("o_custkey") % 3).alias("currentorgid"), F.unix_millis("at").alias("currentbidEndDate"),
    )
    docs = _orders(spark, d).select(F.from_json(F.to_json(doc), json_feeds.EPOCH_FEED).alias("d")).select("d.*")
    return json_feeds.epoch_feed(docs, "b", "S", "u").select("notice_id", "title", "organisation", "department", "description", stamp("closing").alias("closing"))


@query(f"""SELECT CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE 'N-' || o_orderkey END AS notice_id, o_orderpriority AS title, 'dep ' || o_custkey AS department, CASE WHEN o_orderkey % 2 = 0 THEN 'c' ELSE 'Government eProcurement' END AS category, {STAMP.format('o_orderdate')} AS closing FROM orders WHERE o_orderkey <> 0 OR o_orderstatus <> 'F'""")
def flat_feed(spark, d):
    key, priority, status = _columns()
    doc = F.struct(
        key.alias("id"), F.when(status == "F", " ").otherwise(_joined("N-", key)).alias("tenderNumber"), _joined(" ", priority, "  ").alias("title"), F.when(key % 2 == 0, "c").alias("category"), _joined("dep ", F.col("o_custkey")).alias("deptName"),
        F.date_format("at", "dd-MM-yyyy HH:mm:ss").alias("tenderClosureDate"),
    )
    docs = _orders(spark, d).select(F.from_json(F.to_json(doc), json_feeds.FLAT_FEED).alias("d")).select("d.*")
    return json_feeds.flat_feed(docs, "k", "u").select("notice_id", "title", "department", "category", stamp("closing").alias("closing"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 5 = 0")
def feed_rejects(spark, d):
    key, priority, status = _columns()
    rows = _orders(spark, d).withColumns({"number": F.when(key % 5 != 0, key.cast("string")), "title": F.when(status == "P", "").otherwise(priority)})
    return json_feeds.rejects(rows, F.col("number"), F.col("title")).select("o_orderkey")


@query(f"""SELECT 'T' || o_orderkey AS notice_id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS value, {STAMP.format("date_trunc('minute', o_orderdate)")} AS closing FROM orders""")
def corrigendum_feed(spark, d):
    """One body for each customer, with every notice twice; and one that is no JSON."""
    key, priority, _ = _columns()
    doc = F.struct(
        _joined("T", key).alias("sTenderNo"), _joined(priority, " ").alias("sNameOfWork"), F.when(key % 2 == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise("0").alias("mEstimatedCost"),
        F.upper(F.date_format("at", "dd/MM/yyyy hh:mm a")).alias("dtBidSubmissionClosingDate"),
    )
    bodies = _orders(spark, d).groupBy("o_custkey").agg(F.sort_array(F.collect_list(doc)).alias("docs")).select(F.to_json(F.concat("docs", "docs")).alias("body"))
    found = json_feeds.corrigendum_feed(bodies.union(bodies.limit(1).select(F.lit("<html>"))), "body", "t", "u")
    return found.select("notice_id", "title", F.col("value").cast("string").alias("value"), stamp("closing").alias("closing"))


def _month(c: str) -> Column:
    return F.upper(F.date_format(c, "dd-MMM-yyyy hh:mm a"))


MINUTE = STAMP.format("date_trunc('minute', o_orderdate)")


@query(f"SELECT 'R/' || o_orderkey AS notice_id, o_orderpriority || ' & é ' || o_orderkey AS title, {MINUTE} AS closing, 'https://e.org/app/d?id=' || o_orderkey AS url FROM orders")
def listing_feed(spark, d):
    key, priority, _ = _columns()
    row = _joined('<tr><td><a href="d?id=', key, '">', priority, " &amp; &eacute; ", key, "</a></td><td>Reference No: R/", key, "</td><td>", _month("at"), "</td></tr>")
    pages = _by_customer(_orders(spark, d), row, '<table><tr><th>x</th></tr><tr><td><a href="/more">More</a></td><td>credits</td></tr>', "</table>")
    return html_feeds.listing(pages, "g").select("notice_id", "title", stamp("closing").alias("closing"), "url")


@query("SELECT n_name AS name, count(*) AS n, 'https://e.org/app?DirectLink=' || n_nationkey AS url FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def organisation_index(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey").count().join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = _joined("<tr><td>1</td><td>", F.col("n_name"), '</td><td><a href="?DirectLink=', F.col("n_nationkey"), '">', F.format_number("count", 0), "</a></td></tr>")
    pages = counts.groupBy(F.col("n_regionkey").alias("page_no")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    head, other = "<table><tr><td>S.No</td><td>Organisation Name</td><td>Tender Count</td></tr>", '<table><tr><td>1</td><td>Other</td><td><a href="?DirectLink=0">7</a></td></tr></table>'
    return html_feeds.organisation_index(pages.select("page_no", _joined(other, head, F.col("rows"), "</table>", other).alias("html"), F.lit(BASE).alias("base_url")))


@query(f"SELECT '2026_' || o_orderkey AS notice_id, o_orderpriority AS title, 'Org ' || o_orderstatus AS organisation, 'Dep' AS department, o_orderpriority || ' | REF/' || o_custkey || ' | Org ' || o_orderstatus || ' | Dep | X' AS description, {MINUTE} AS closing, 'https://e.org/t/' || o_orderkey AS url FROM orders")
def organisation_notices(spark, d):
    key, priority, status = _columns()
    day = _month("at")
    row = _joined('<tr class="odd"><td>1</td><td>', day, "</td><td>", day, "</td><td>", day, '</td><!-- <td>old</td> --><td><a href="/t/', key, '">[', priority, "]</a> [REF/", F.col("o_custkey"), "][2026_", key, "]</td><td>Org ", status, "||Dep||X</td></tr>")
    pages = _by_customer(_orders(spark, d), row, '<table><tr class="list_header"><td>e-Published Date</td><td>Title and Ref.No./Tender ID</td></tr>', "</table>")
    return html_feeds.organisation_notices(pages, "g").select("notice_id", "title", "organisation", "department", "description", stamp("closing").alias("closing"), "url")


@query(f"""SELECT 'A/' || o_orderkey AS notice_id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS department,
    CASE WHEN o_orderkey % 2 = 0 THEN {MINUTE} ELSE strftime(make_timestamp(CASE WHEN make_timestamp(1998, month(o_orderdate), least(day(o_orderdate), 28), hour(o_orderdate), minute(o_orderdate), 0) < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 1999 ELSE 1998 END, month(o_orderdate), least(day(o_orderdate), 28), hour(o_orderdate), minute(o_orderdate), 0), '%Y-%m-%d %H:%M:%S') END AS closing FROM orders""")
def block_feed(spark, d):
    """Even orders in blocks with a full date, odd ones in blocks whose date has no year."""
    key, priority, status = _columns()
    one = _joined('<div class="samer"><a class="coli-tno">A/', key, '</a><a class="tDesc">', priority, " in Division No: ", status, '.</a><span class="coli-date">', F.upper(F.date_format("at", "dd/MM/yyyy hh:mm a")), "</span></div>")
    two = _joined('<div class="update-nag"><h4>', F.date_format("at", "MMM"), "</h4><h4>", F.least(F.dayofmonth("at"), F.lit(28)), "</h4><h4>", F.upper(F.date_format("at", "hh:mm a")), "</h4><p>x</p><p>A/", key, "</p><p>", priority, "</p></div>")
    pages = _by_customer(_orders(spark, d), F.when(key % 2 == 0, one).otherwise(two), "<div>", "</div>")
    return html_feeds.block_listing(pages, "c", as_of()).select("notice_id", "title", "department", stamp("closing").alias("closing"))


@query(f"SELECT 'N/' || o_orderkey AS notice_id, 'Org' || o_custkey AS organisation, 'Dep - Office' AS department, {MINUTE} AS closing FROM orders")
def report_feed(spark, d):
    key, _, _ = _columns()
    row = _joined("<tr><td>1</td><td>5</td><td>N/", key, "</td><td>", F.date_format("at", "dd-MM-yyyy HH:mm"), "</td></tr>")
    pages = _by_customer(_orders(spark, d), row, "", "")
    other = "<table><tr><td>1</td><td>2</td><td>other</td><td>01-01-1998 10:00</td></tr></table>"
    framed = pages.withColumn("html", _joined(other, '<table id="mytable"><tbody><tr><td class="table_heading_row" colspan="4">Org', F.col("page_no"), "-Dep-Office</tr>", F.col("html"), "</tbody></table>"))
    return html_feeds.closing_report(framed, "r").select("notice_id", "organisation", "department", stamp("closing").alias("closing"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL")
def calendar_feed(spark, d):
    days = _orders(spark, d).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).count()
    entry = _joined('\\"', F.col("day"), '\\": ', F.col("count"))
    months = days.groupBy(F.left("day", F.lit(7)).alias("page_no")).agg(F.array_join(F.collect_list(entry), ", ").alias("rows"))
    return html_feeds.calendar_counts(months.select("page_no", _joined("<script>var d = JSON.parse('{", F.col("rows"), "}');</script>").alias("html"), F.lit(BASE).alias("base_url"))).select("day", F.col("n").cast("long").alias("n"))


@query(f"SELECT 'GEM/2026/B/' || (1000000 + o_orderkey) AS notice_id, 'Supply of ' || o_orderpriority || ' goods' AS title, 'Ministry of ' || o_orderstatus AS organisation, {STAMP.format('CAST(o_orderdate AS DATE)')} AS published, {MINUTE} AS closing FROM orders")
def visible_feed(spark, d):
    """Free rows whose dates come in three formats, between rows of other kinds."""
    key, priority, status = _columns()
    half, plain = F.upper(F.date_format("at", "dd-MM-yyyy hh:mm a")), F.date_format("at", "dd/MM/yyyy HH:mm")
    number = _joined("GEM/2026/B/", key + 1000000)
    rows = _orders(spark, d).select(F.array(number, _joined("Supply of ", priority, " goods"), _joined("Ministry of ", status), F.date_format("at", "dd/MM/yyyy"), half).alias("cells"), F.array(F.lit("/a")).alias("links"))
    rows = rows.unionByName(rows.select(F.array(F.lit("Home"), F.lit("Contact")).alias("cells"), "links"))
    found = html_feeds.visible_rows(rows, "v", BASE)
    return found.select("notice_id", "title", "organisation", stamp("published").alias("published"), stamp("closing").alias("closing"))


# Snapshots and streams, in the shared folder


def _folder(spark, name: str) -> str:
    return f"{views.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT 'customer' AS name, c_custkey AS key, c_name AS value FROM customer UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'exported', 1, CAST((SELECT count(*) FROM customer) AS VARCHAR)
    UNION ALL SELECT 'restored', 1, CAST((SELECT count(*) FROM nation) AS VARCHAR) UNION ALL SELECT 'unordered', 0, '0' UNION ALL SELECT 'folders', 2, '2026-01-02T03-04-05-000000'""")
def snapshot_roundtrip(spark, d):
    """The newer of two exports as JSON in the order of ids, restored, checked, published and read again; with the numbers of rows that both steps return."""
    out, root = _folder(spark, "export"), _folder(spark, "store")
    tables, keys = {t: table(spark, d, t) for t in ("nation", "customer")}, {"nation": ["n_nationkey"], "customer": ["c_custkey"]}
    store.export_snapshot({"nation": tables["nation"].where("n_nationkey > 3")}, out, keys, datetime(2025, 12, 31))
    last, counts = store.export_snapshot({t: df.orderBy(F.desc(keys[t][0])) for t, df in tables.items()}, out, keys, datetime(2026, 1, 2, 3, 4, 5))
    found = store.exports(spark, out)
    back = store.publish_snapshot(spark, found[-1], root, ["nation", "customer"], [("customer", "c_nationkey", "nation", "n_nationkey")], confirm=True)
    rows = [store.read_version(spark, root, t).select(F.lit(t).alias("name"), F.col(k).cast("long").alias("key"), F.col(v).alias("value")) for t, k, v in (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"))]
    # Rows that stand before a smaller id: in a file, or in one of a smaller name.
    placed = spark.read.schema("c_custkey long").json(f"{last}/customer").select("c_custkey", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    within = placed.withColumn("before", F.lag("c_custkey").over(Window.partitionBy("file").orderBy("at"))).where("before > c_custkey").count()
    files = placed.groupBy("file").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high")).orderBy("file").collect()
    across = sum(a["high"] > b["low"] for a, b in zip(files, files[1:]))
    numbers = [("exported", 1, str(counts["customer"])), ("restored", 1, str(back["nation"])), ("unordered", 0, str(within + across)), ("folders", len(found), last.rsplit("/", 1)[-1])]
    return store.union_sources([*rows, spark.createDataFrame(numbers, "name string, key long, value string")])


_stores: dict[tuple, tuple[str, str]] = {}


def _ingested(spark, d) -> tuple[str, str]:
    """The store, and the folder of the sent rows, after all orders came in as two batches of a stream; one run for all queries of a session.

    The second batch has rows without a title, too, and its first attempt fails after the merge, so the batch is replayed.
    """
    own = (spark.sparkContext.applicationId, d)
    if own in _stores:
        return _stores[own]
    source, root, sent = _folder(spark, "source"), _folder(spark, "store"), _folder(spark, "sent")
    batch = views.batch(spark, d)
    untitled = batch.where("ordinal = 1 and status = 'P'").withColumns({"title": F.lit(None).cast("string"), "ordinal": F.lit(2)})
    batch = batch.unionByName(untitled)
    store.write_version(spark, root, {"notices": views.stored_notices(spark, d), "tombstones": views.tombstones(spark, d)})
    schema, failed = ", ".join(f"{n} {t}" for n, t in batch.dtypes), []

    def alert(rows, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("forced once")
        rows.select(F.lit(number).alias("batch"), *KEYS).write.mode("append").parquet(sent)

    for n in (1, 2):
        # An upsert by batch: the second one's files come later.
        batch.where(F.col("ordinal") == n).write.mode("append").parquet(source)
        start = lambda: start_ingest(spark, source, schema, root, f"{root}-checkpoint", lambda number: AS_OF, alert)
        try:
            start().awaitTermination()
        except StreamingQueryException:
            start().awaitTermination()
    _stores[own] = root, sent
    return _stores[own]


SEEN_SQL = ", met AS (SELECT portal, notice_id, max(ordinal) FILTER (action <> 'skip') AS last_seen, max(ordinal) FILTER (action IN ('insert', 'update')) AS last_written FROM actions GROUP BY ALL)"
INGESTED_SQL = MERGE_SQL + SEEN_SQL + """ SELECT coalesce(w.portal, s.portal) AS portal, coalesce(w.notice_id, s.notice_id) AS notice_id, CAST(coalesce(w.value, s.value) AS VARCHAR) AS value, CASE WHEN last_seen IS NULL THEN 'run-0' ELSE 'batch-' || (last_seen - 1) END AS last_seen_run
    FROM stored s FULL JOIN (SELECT a.* FROM actions a JOIN met m ON a.portal = m.portal AND a.notice_id = m.notice_id AND a.ordinal = m.last_written AND a.action IN ('insert', 'update')) w ON s.portal = w.portal AND s.notice_id = w.notice_id
    LEFT JOIN met ON met.portal = coalesce(w.portal, s.portal) AND met.notice_id = coalesce(w.notice_id, s.notice_id)"""


def _as_read(rows):
    return rows.select("portal", "notice_id", F.col("value").cast("string").alias("value"), "last_seen_run")


@query(INGESTED_SQL)
def ingest_stream(spark, d):
    """Base and feed, read as one table."""
    root, _ = _ingested(spark, d)
    return _as_read(feed.present(spark, root, "notices", KEYS))


@query(INGESTED_SQL)
def ingest_folded(spark, d):
    """The base alone, after the feed was folded into it."""
    root, _ = _ingested(spark, d)
    feed.fold(spark, root, "notices", KEYS, share=0)
    return _as_read(store.read_version(spark, root, "notices"))


@query(MERGE_SQL + f"""SELECT ordinal - 1 AS batch, 'success' AS status, count(*) AS rows, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action IN ('skip', 'touch')) AS skipped,
    CASE WHEN ordinal = 2 THEN (SELECT count(*) FROM orders_n WHERE status = 'P') ELSE 0 END AS failed, count(*) FILTER (closing < TIMESTAMP '{AS_OF}') AS closed_on_arrival FROM actions GROUP BY ALL""")
def ingest_runs(spark, d):
    """The run log: one row a batch, though the second one was tried twice."""
    root, _ = _ingested(spark, d)
    return run_log(spark, root).select("batch", "status", "rows", "inserted", "updated", "skipped", "failed", "closed_on_arrival")


@query(MERGE_SQL + f"""SELECT ordinal - 1 AS batch, count(*) AS rows, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action IN ('skip', 'touch')) AS skipped,
    CASE WHEN ordinal = 2 THEN (SELECT count(*) FROM orders_n WHERE status = 'P') ELSE 0 END AS failed, count(*) FILTER (closing < TIMESTAMP '{AS_OF}') AS closed_on_arrival FROM actions GROUP BY ALL""")
def ingest_metrics(spark, d):
    """The counters of the merges alone."""
    return ingest_runs(spark, d).drop("status")


@query(MERGE_SQL + "SELECT DISTINCT ordinal - 1 AS batch, portal, notice_id FROM actions WHERE action <> 'skip'")
def ingest_alerts(spark, d):
    return spark.read.parquet(_ingested(spark, d)[1])
