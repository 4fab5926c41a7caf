"""A keyed table as a base and a feed of changes: what a batch changes is appended, whatever the size of the table.

The base is a published table (``sources/store.py``). A batch's changes are a folder of its own with one row for each key: the new version ``v``,
null for a key that was only seen again, and when and by which run it was seen. The present rows are the last version of each key over base and feed. When the
feed outgrows a share of the base, its batches are folded into a new base, which changes no row. Folders of folded batches are not read any more.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .store import published, read_version, write_version

#: Columns that every row of a table with a feed has, beside its keys and its data.
SEEN = ["last_seen_at", "last_seen_run"]
#: Rows of a feed, as a share of the base's, from which it is folded.
SHARE = 0.25


def _folder(root: str, name: str, batch: int | None = None) -> str:
    return f"{root}/feed/{name}" + ("" if batch is None else f"/batch={batch}")


def append(root: str, name: str, changes: DataFrame, batch: int) -> None:
    """Writes the changes of a batch; a replay of the batch replaces them."""
    changes.write.mode("overwrite").parquet(_folder(root, name, batch))


def totals(spark: SparkSession, root: str, name: str, batch: int, counts: list[str]) -> dict[str, int]:
    """Sums over what a batch appended, by columns of counts that its changes had beside the feed's own."""
    found = spark.read.schema(", ".join(f"{c} long" for c in counts)).parquet(_folder(root, name, batch))
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).first().asDict()


def changes_schema(base: StructType, keys: list[str]) -> StructType:
    data = StructType([f for f in base if f.name not in (*keys, *SEEN)])
    return StructType([base[k] for k in keys] + [StructField("v", data)] + [base[c] for c in SEEN])


def changes(spark: SparkSession, root: str, name: str, keys: list[str], after: int | None = None, before: int | None = None) -> DataFrame:
    """(keys, v, seen columns, batch) of the batches that the base does not hold; or of those greater than ``after``, and less than ``before``."""
    entry = published(spark, root, name)
    schema = StructType.fromJson(json.loads(entry["schema"]))
    whole = StructType(changes_schema(schema, keys).fields).add("batch", "long")
    try:
        found = spark.read.schema(whole).option("basePath", _folder(root, name)).parquet(_folder(root, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)
    found = found.where(F.col("batch") > F.lit(entry["batch"] if after is None else after))
    return found if before is None else found.where(F.col("batch") < before)


def merged(base: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The present rows: ``base`` with the last version and sight of each key of ``feed``.

    The feed is small against the base, so it is aggregated by key and joined to it, instead of one aggregate over both that would shuffle the base.
    """
    data = [c for c in base.columns if c not in (*keys, *SEEN)]
    last = feed.groupBy(*keys).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("batch"))).alias("v"), F.max_by(F.struct(*SEEN), "batch").alias("s"))
    newest = lambda c, group: F.when(F.col(group).isNotNull(), F.col(f"{group}.{c}")).otherwise(F.col(c)).alias(c)
    kept = base.join(last, keys, "left").select(*keys, *[newest(c, "v") for c in data], *[newest(c, "s") for c in SEEN])
    fresh = last.where(F.col("v").isNotNull()).join(base.select(keys), keys, "left_anti").select(*keys, *[F.col(f"v.{c}").alias(c) for c in data], *[F.col(f"s.{c}").alias(c) for c in SEEN])
    return kept.unionByName(fresh).select(base.columns)


def present(spark: SparkSession, root: str, name: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The table as it is now, or as it was before a batch that the base does not hold yet."""
    return merged(read_version(spark, root, name), changes(spark, root, name, keys, before=before), keys)


def present_keys(spark: SparkSession, root: str, name: str, keys: list[str], wanted: DataFrame, columns: list[str], before: int | None = None) -> DataFrame:
    """Some columns of the rows whose key is in ``wanted``: nothing else of base and feed reaches a shuffle."""
    own = wanted.select(keys).distinct()
    base = read_version(spark, root, name).select(*keys, *columns, *SEEN).join(own, keys, "left_semi")
    data = [c for c in columns if c not in SEEN]
    cut = lambda v: F.when(F.col(v).isNotNull(), F.struct(*[F.col(f"{v}.{c}") for c in data])).alias(v)
    feed = changes(spark, root, name, keys, before=before).select(*keys, cut("v"), *SEEN, "batch").join(own, keys, "left_semi")
    return merged(base, feed, keys).select(*keys, *columns)


def fold(spark: SparkSession, root: str, name: str, keys: list[str], before: int | None = None, share: float = SHARE) -> bool:
    """Makes base and feed one new base if the feed has more than ``share`` of the base's rows; True if it did.

    Counts come from the files' footers. ``before`` leaves the batches from that one on in the feed: a batch that may be replayed must not be folded.
    """
    feed = changes(spark, root, name, keys, before=before)
    last, n = feed.agg(F.max("batch"), F.count(F.lit(1))).first()
    if not n or n <= share * read_version(spark, root, name).count():
        return False
    write_version(spark, root, {name: present(spark, root, name, keys, before)}, batch=last)
    return True


def seen_since(spark: SparkSession, root: str, name: str, keys: list[str], batch: int) -> DataFrame:
    """(keys, written) of a batch's own changes: ``written`` where it brought a new version."""
    return changes(spark, root, name, keys, after=batch - 1, before=batch + 1).select(*keys, written())


def written() -> Column:
    return F.col("v").isNotNull().alias("written")
