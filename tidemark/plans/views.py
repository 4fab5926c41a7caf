"""Notice tables over the synthetic star schema. All of them are whole tables; nothing is sampled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-01 00:00:00"
RUN_AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices from documents: the first line is the title, the whole text the description; none of them closes."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("portal"), F.concat(F.lit("D"), F.col("doc_id")).alias("notice_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), F.col("lang").alias("category"),
        F.lit(None).cast("string").alias("organisation"), F.lit(None).cast("string").alias("department"), F.col("n_chars").alias("published"), F.lit(None).cast("timestamp").alias("closing"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored tables of a session: ``spark.checkpoint.dir``."""
    from ..sources.store import cut

    cut(spark.range(1))  # sets the folder where a local session has none
    return spark.sparkContext.getCheckpointDir()


_indexed: dict[tuple, tuple] = {}
#: Rows of a stored table for each of its files.
EACH_FILE = 50_000


def dealt(notices: DataFrame) -> DataFrame:
    """``notices`` in a partition for every ``EACH_FILE`` rows, unless they have as many anyway.

    Short rows compress to a few bytes each: a million fit one file with one row group, which a single task reads, and whoever reads the stored table would do that.
    """
    n = notices.count() // EACH_FILE + 1
    return notices if n <= notices.rdd.getNumPartitions() else notices.repartition(n, "portal", "notice_id")


def indexed(spark: SparkSession, sf_dir: str, name: str, notices: DataFrame) -> tuple:
    """(table, index): ``notices`` as a stored table with its text index, in the shared folder; written once in a session."""
    from ..operators.text_index import build

    own = (spark.sparkContext.applicationId, sf_dir, name)
    if own not in _indexed:
        root = f"{shared_folder(spark)}/indexed-{uuid.uuid4().hex}"
        dealt(notices).write.parquet(f"{root}/table")
        stored = spark.read.schema(notices.schema).parquet(f"{root}/table")
        _indexed[own] = stored, build(spark, f"{root}/index", stored)
    return _indexed[own]


def substrings_of_documents(spark: SparkSession, sf_dir: str) -> tuple:
    """(table, index): the documents with the index of their runs; written once in a session."""
    from ..operators.substring_index import build

    notices = documents(spark, sf_dir)
    own = (spark.sparkContext.applicationId, sf_dir, "runs of documents")
    if own not in _indexed:
        _indexed[own] = notices, build(spark, f"{shared_folder(spark)}/indexed-{uuid.uuid4().hex}/runs", notices)
    return _indexed[own]


def indexed_documents(spark: SparkSession, sf_dir: str) -> tuple:
    return indexed(spark, sf_dir, "documents", documents(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated notices from orders, their customers and nations."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_name").alias("portal"), F.col("o_orderkey").cast("string").alias("notice_id"), F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"), F.col("c_name").alias("organisation"),
        F.col("c_mktsegment").alias("department"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"), F.col("o_orderdate").cast("timestamp").alias("closing"),
    )


ORDERS_SQL = """orders_n AS (
  SELECT n_name AS portal, CAST(o_orderkey AS VARCHAR) AS notice_id, o_orderpriority || ' ' || c_name AS title, c_name AS organisation, c_mktsegment AS department,
    o_orderpriority AS category, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS value, CAST(o_orderdate AS TIMESTAMP) AS closing
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

DOCUMENTS_SQL = r"""documents_n AS (
  SELECT source AS portal, 'D' || doc_id AS notice_id, split_part(text, chr(10), 1) AS title, text AS description, lang AS category, n_chars AS published FROM documents)"""


def stored_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store before the merge: orders that are not open any more, as hashed notices."""
    from ..operators.lifecycle import with_hash

    rows = with_hash(orders(spark, sf_dir).where("status <> 'O'"), HASHED)
    return rows.withColumns({"last_seen_at": F.lit("1998-01-01 00:00:00").cast("timestamp"), "last_seen_run": F.lit("run-0")})


HASHED = ["title", "organisation", "category", "status", "value"]


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as they come in, and urgent ones a second time with another value."""
    from ..operators.lifecycle import with_hash

    rows = orders(spark, sf_dir).withColumn("ordinal", F.lit(1))
    again = rows.where("category = '1-URGENT'").withColumns({"value": (F.col("value") + 1).cast("decimal(18,2)"), "ordinal": F.lit(2)})
    return with_hash(rows.unionByName(again), HASHED)


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of low priority that were fulfilled count as deleted before."""
    rows = orders(spark, sf_dir).where("category = '5-LOW' and status = 'F'")
    return rows.select("portal", "notice_id", F.col("closing").alias("closed_at"), F.col("closing").alias("deleted_at"))


HASH_SQL = "sha256('category=' || coalesce(category, '') || '|organisation=' || coalesce(organisation, '') || '|status=' || coalesce(status, '') || '|title=' || coalesce(title, '') || '|value=' || coalesce(CAST(value AS VARCHAR), ''))"
MERGE_SQL = f"""WITH {ORDERS_SQL},
stored AS (SELECT *, {HASH_SQL} AS content_hash FROM orders_n WHERE status <> 'O'),
tomb AS (SELECT portal, notice_id FROM orders_n WHERE category = '5-LOW' AND status = 'F'),
rows AS (SELECT *, 1 AS ordinal FROM orders_n UNION ALL
  SELECT portal, notice_id, title, organisation, department, category, status, CAST(value + 1 AS DECIMAL(18,2)), closing, 2 FROM orders_n WHERE category = '1-URGENT'),
batch AS (SELECT *, {HASH_SQL} AS content_hash FROM rows),
flagged AS (
  SELECT b.*, s.content_hash AS stored_hash, t.portal IS NULL AND (s.portal IS NOT NULL OR
    max(CASE WHEN b.closing IS NULL OR b.closing >= TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END) OVER (PARTITION BY b.portal, b.notice_id ORDER BY b.ordinal) = 1) AS kept
  FROM batch b LEFT JOIN stored s USING (portal, notice_id) LEFT JOIN tomb t ON b.portal = t.portal AND b.notice_id = t.notice_id),
prior AS (SELECT *, coalesce(lag(content_hash) OVER (PARTITION BY portal, notice_id, kept ORDER BY ordinal), stored_hash) AS previous FROM flagged),
actions AS (SELECT *, CASE WHEN NOT kept THEN 'skip' WHEN previous IS NULL THEN 'insert' WHEN previous = content_hash THEN 'touch' ELSE 'update' END AS action FROM prior)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log from events: the type is the portal, values above 50 are stated totals."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("success", "partial", "failed", "running", "skipped"))), F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5 + 1)
    return e.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("portal"), F.col("ts").cast("timestamp").alias("started"), status.alias("status"),
        F.when(F.col("value") > 50, F.floor("value")).alias("stated_total"), F.when(status != "running", F.col("ts").cast("timestamp") + F.expr("interval 90 seconds")).alias("finished"),
        F.lit(None).cast("string").alias("message"), F.col("user_id"),
    )


RUNS_SQL = """runs AS (
  SELECT *, CASE WHEN status <> 'running' THEN started + INTERVAL 90 SECONDS END AS finished FROM (
    SELECT event_id AS run_id, event_type AS portal, CAST(ts AS TIMESTAMP) AS started, user_id,
      ['success', 'partial', 'failed', 'running', 'skipped'][CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 5 + 1] AS status,
      CASE WHEN value > 50 THEN CAST(floor(value) AS BIGINT) END AS stated_total FROM events))"""
