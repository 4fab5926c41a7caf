"""Browsing a stored order: a page costs the same however deep it is.

The rows are dealt into ranges of the order, newest first and undated last, and written with one folder a range. The ranges' sizes add up to where each begins, so a
page is read from the one or few ranges that hold it, and the largest task sorts one range. Who only wants the first pages of a table once takes ``search.browse``.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .search import clamp_page

#: Rows of a range when an order is stored.
EACH_RANGE = 1_000_000
#: Ranges at most: beyond, they get longer. Their sizes and the sample that sets their bounds pass through the driver.
MOST_RANGES = 1024
RANGE = "range_of_order"


def order() -> list:
    return [F.desc_nulls_last("published"), F.asc("portal"), F.asc("notice_id")]


@dataclass(frozen=True)
class StoredOrder:
    """A stored order of notices. ``starts`` has the place of each range's first row and, at its end, the number of all rows: one number a range."""

    spark: SparkSession
    root: str
    schema: StructType
    starts: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, page: int = 1, limit: int = 20) -> DataFrame:
        """The rows of a page in their order, with the totals of ``search.browse``; past the last page there are none."""
        page, limit = clamp_page(page, limit)
        first = min((page - 1) * limit, self.total)
        last = min(first + limit, self.total)
        low = max(bisect_right(self.starts, first) - 1, 0)
        ranges = [r for r in range(low, len(self.starts) - 1) if self.starts[r] < last and first < last]
        rows = self.spark.read.schema(self.schema).parquet(self.root).where(F.col(RANGE).isin(ranges)).drop(RANGE)
        own = rows.orderBy(*order()).offset(first - self.starts[low]).limit(limit)
        return own.withColumns({"total_count": F.lit(self.total).cast("long"), "pages": F.lit(math.ceil(self.total / limit)).cast("long")})


def store_order(notices: DataFrame, root: str, each: int = EACH_RANGE) -> StoredOrder:
    """Writes ``notices`` (with portal, notice_id and published) in their order to a new folder, about ``each`` rows a range, or more if that would take over ``MOST_RANGES`` ranges.

    All three columns deal the rows, so days on which very many were published are split as well. Rows that repeat a key stay, side by side. An empty table
    has no ranges.
    """
    spark = notices.sparkSession
    ranges = min(math.ceil(notices.count() / each), MOST_RANGES)
    dealt = notices.repartitionByRange(max(ranges, 1), *order()).withColumn(RANGE, F.spark_partition_id())
    dealt.write.partitionBy(RANGE).parquet(root)
    schema = StructType([*notices.schema.fields, StructField(RANGE, IntegerType())])
    sizes = {r[0]: r[1] for r in spark.read.schema(schema).parquet(root).groupBy(RANGE).agg(F.count(F.lit(1))).collect()}  # one row a range
    return StoredOrder(spark, root, schema, tuple(accumulate((sizes.get(r, 0) for r in range(max(sizes, default=-1) + 1)), initial=0)))
