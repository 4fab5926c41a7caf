"""JSON feeds as notices. Readers take a schema; rows without id or title are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..functions.text import clean, content_hash, document_link, filled, relevance

NOTICE = "portal string, notice_id string, title string, organisation string, department string, category string, description string, value decimal(18,2), published timestamp, closing timestamp, opening timestamp, url string, status string, state string, document_url string"

ARRAY_FEED = "id string, b_id array<long>, b_bid_number array<string>, b_category_name array<string>, bd_category_name array<string>, b_total_quantity array<string>, b_total_value array<string>, b_bid_type array<int>, b_eval_type array<int>, is_rc_bid array<int>, ba_is_global_tendering array<int>, ba_official_details_minName array<string>, ba_official_details_deptName array<string>, ba_official_details_orgName array<string>, final_start_date_sort array<string>, final_end_date_sort array<string>"
EPOCH_FEED = "currenttenderid long, currentOrgTenderId long, currenttenderrefno string, currentdescription string, currentdeptid long, currentorgid long, currentTenderPublishDate long, currentbidEndDate long, currentbidOpenDate long"
FLAT_FEED = "id long, tenderNumber string, title string, description string, category string, categoryText string, deptName string, publishedDate string, tenderClosureDate string"
CORRIGENDUM = "array<struct<sTenderNo:string,nTenderID:string,sDepartmentName:string,sCircle_Division:string,sNameOfWork:string,mEstimatedCost:string,dtBidSubmissionClosingDate:string>>"


def read_feed(spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool = True) -> DataFrame:
    """JSON files by an explicit schema. A document that cannot be read is a row with ``_corrupt`` and does not fail the others."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def notices(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows in the common schema; columns that are not given are null, rows without id or title go."""
    shape = [(f.split(" ")[0], f.split(" ")[1]) for f in NOTICE.replace(", ", ";").split(";")]
    given = df.select(*[(columns[n] if n in columns else F.lit(None)).cast(t).alias(n) for n, t in shape])
    return given.where(filled(F.col("notice_id")).isNotNull() & filled(F.col("title")).isNotNull())


def normalised(rows: DataFrame, hashed: list[str]) -> DataFrame:
    """Rows of ``notices`` as they are stored: with the relevance label, and a content hash over ``hashed`` that may take it in."""
    labelled = rows.withColumn("relevance", relevance(*map(F.col, ("title", "category", "organisation", "department"))))
    return labelled.withColumn("content_hash", content_hash({c: F.col(c) for c in hashed}))


def rejects(df: DataFrame, notice_id: Column, title: Column) -> DataFrame:
    """The rows that ``notices`` drops."""
    return df.where(filled(notice_id).isNull() | filled(title).isNull())


def first_per_key(df: DataFrame, keys: list[str], *position: str) -> DataFrame:
    """The first row of each key in page order (``dropDuplicates`` would take any)."""
    order = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def array_feed(docs: DataFrame, portal: str, origin: str) -> DataFrame:
    """Documents whose every field is an array with one element."""
    one = lambda c: F.get(c, F.lit(0))
    text = lambda c: filled(clean(one(c).cast("string")))
    ministry, short = text("ba_official_details_minName"), text("b_category_name")
    link = document_link(origin, one("b_id"), one("b_bid_type"), F.coalesce(one("b_eval_type"), F.lit(0)))
    parts = [F.concat(F.lit("Quantity: "), text("b_total_quantity")), F.when(one("is_rc_bid") == 1, "Rate Contract"), F.when(one("ba_is_global_tendering") == 1, "Global Tender")]
    return notices(
        docs, portal=F.lit(portal), notice_id=text("b_bid_number"), title=F.coalesce(text("bd_category_name"), short), organisation=F.coalesce(text("ba_official_details_orgName"), ministry),
        department=F.coalesce(text("ba_official_details_deptName"), ministry), category=F.coalesce(short, F.lit("Bid")), description=filled(F.concat_ws(" | ", *parts)),
        value=text("b_total_value").try_cast("decimal(18,2)"), published=dates.iso(one("final_start_date_sort")), closing=dates.iso(one("final_end_date_sort")), url=link, status=F.lit("active"),
    )


def epoch_feed(docs: DataFrame, portal: str, state: str, url: str) -> DataFrame:
    """Flat documents with dates in milliseconds; labels come from numeric ids other than zero."""
    title = clean(F.col("currentdescription"))
    labelled = lambda name, c: F.when(F.col(c) != 0, F.concat(F.lit(f"{name} "), F.col(c).cast("string")))
    return notices(
        docs, portal=F.lit(portal), notice_id=F.coalesce("currentOrgTenderId", "currenttenderid").cast("string"), title=title, organisation=labelled(f"{state} Organisation", "currentorgid"),
        department=labelled("Department", "currentdeptid"), category=F.lit("Government eProcurement"), description=F.concat_ws(" | ", title, filled(F.trim("currenttenderrefno"))),
        published=dates.epoch_millis(F.col("currentTenderPublishDate")), closing=dates.epoch_millis(F.col("currentbidEndDate")), opening=dates.epoch_millis(F.col("currentbidOpenDate")), url=F.lit(url), status=F.lit("active"),
    )


def flat_feed(docs: DataFrame, portal: str, url: str) -> DataFrame:
    """Flat documents with dates as DD-MM-YYYY HH:MM:SS; the id is the number, else the internal id."""
    return notices(
        docs, portal=F.lit(portal), notice_id=F.coalesce(filled(F.trim("tenderNumber")), F.when(F.col("id") != 0, F.col("id").cast("string"))), title=clean(F.col("title")), department=F.col("deptName"),
        category=F.coalesce("categoryText", "category", F.lit("Government eProcurement")), description=filled(clean(F.col("description"))),
        published=dates.dash_seconds(F.col("publishedDate")), closing=dates.dash_seconds(F.col("tenderClosureDate")), url=F.lit(url), status=F.lit("active"),
    )


def corrigendum_feed(raw: DataFrame, text_col: str, portal: str, url: str) -> DataFrame:
    """Bodies that hold a JSON array; anything else gives no rows. The first row of an id wins, a cost counts above zero."""
    rows = raw.select(F.monotonically_increasing_id().alias("doc"), F.posexplode(F.from_json(text_col, CORRIGENDUM)).alias("pos", "r")).select("doc", "pos", "r.*")
    number = F.coalesce(filled(F.trim("sTenderNo")), F.when(F.col("nTenderID") != "0", filled(F.trim("nTenderID"))))
    cost = F.col("mEstimatedCost").try_cast("decimal(18,2)")
    rows = first_per_key(rows.withColumn("number", number).where(F.col("number").isNotNull() & filled(clean(F.col("sNameOfWork"))).isNotNull()), ["number"], "doc", "pos")
    return notices(
        rows, portal=F.lit(portal), notice_id=F.col("number"), title=clean(F.col("sNameOfWork")), department=F.coalesce(filled(F.trim("sDepartmentName")), filled(F.trim("sCircle_Division"))),
        category=F.lit("Government eProcurement"), value=F.when(cost > 0, cost), closing=dates.slash_half_day(F.col("dtBidSubmissionClosingDate")), url=F.lit(url), status=F.lit("active"),
    )
