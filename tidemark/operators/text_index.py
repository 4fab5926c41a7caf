"""A stored inverted index for text search: postings of word stems, and how good the best of each block is.

A posting is (token, portal, notice_id, rank), with the rank that full-text search gives the token in the notice. Postings are dealt into buckets by token, which are
folders, so a search reads the buckets of its own tokens and no text. A *block* is the postings of a token in one of ``SHARDS`` shares of the notices; blocks
keep their greatest rank and their size. Who wants the k best notices of a query evaluates the most promising shards first, and after that only
those whose greatest ranks add up to what the k-th found has.

What a batch changes is appended: the postings of its new versions, and the keys that it changed or removed. A posting counts if its batch is the last one that
changed its key. Everything is plain Parquet folders: ``postings/batch=/bucket=``, ``blocks/batch=`` and ``changed/batch=``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["portal", "notice_id"]
#: Shares of the notices that blocks tell apart.
SHARDS = 64
#: Postings for each bucket when an index is built, and the greatest number of buckets.
EACH_BUCKET, MOST_BUCKETS = 500_000, 4096
#: Shards that a query evaluates first.
FIRST_SHARDS = 4
#: Rows of a table that is sent to all tasks of a join.
MOST_SENT = 50_000

POSTING = "token string, shard int, portal string, notice_id string, rank double, batch long, bucket int"
BLOCK = "token string, shard int, top double, n long, batch long"
CHANGED = "portal string, notice_id string, batch long"


def shard_of() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(SHARDS)).cast("int").alias("shard")


def sent(df: DataFrame) -> DataFrame:
    """``df``, computed once, and sent to all tasks of a join if it has few rows. Spark deals both sides by the key if the few keys leave most partitions empty, so one
    that most rows of the other side have would fill one task."""
    from .search import cut

    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def whole_title(title: Column) -> Column:
    """A token that stands for a title as a whole; no word holds its first character."""
    return F.concat(F.lit("="), F.hex(F.xxhash64(F.lower(title))))


def postings_of(notices: DataFrame) -> DataFrame:
    """(token, keys, rank) of the notices' words and, with rank 0, of their whole titles."""
    from .search import token_table

    titles = notices.where("title is not null").select(whole_title(F.col("title")).alias("token"), *KEYS, F.lit(0.0).alias("rank"))
    return token_table(notices, KEYS).select("token", *KEYS, "rank").unionByName(titles)


@dataclass(frozen=True)
class TextIndex:
    """The index in a folder. ``n_buckets`` is fixed when it is built, ``make`` gives the (token, keys, rank) of notices."""

    spark: SparkSession
    root: str
    n_buckets: int
    make: Callable[[DataFrame], DataFrame] = postings_of

    def bucket(self, token: str = "token") -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.n_buckets)).cast("int")

    def _write(self, rows: DataFrame, batch: int) -> None:
        """Postings of a batch, sorted by block inside of each bucket, then their blocks; a replay replaces both."""
        at = f"{self.root}/postings/batch={batch}"
        # Rebalanced: a token that most notices have is split over several tasks and files of its bucket.
        dealt = rows.select("token", *KEYS, "rank", self.bucket().alias("bucket")).hint("rebalance", "bucket").withColumn("shard", shard_of()).sortWithinPartitions("bucket", "token", "shard")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = self.spark.read.schema("token string, shard int, rank double").parquet(at)
        blocks = written.groupBy("token", "shard").agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("n"))
        blocks.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.root}/blocks/batch={batch}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def update(self, batch: int, written: DataFrame, removed: DataFrame | None = None) -> None:
        """Appends what a merge did: ``written`` are the whole rows of inserted and updated notices, ``removed`` (keys) those that expired or were suppressed."""
        keys = written.select(KEYS) if removed is None else written.select(KEYS).unionByName(removed.select(KEYS))
        keys.distinct().write.mode("overwrite").parquet(f"{self.root}/changed/batch={batch}")
        self._write(self.make(written), batch)

    def live(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (keys, batch) that no later batch changed. The changes since the index was built are small against it."""
        last = self._read("changed", CHANGED).groupBy(*KEYS).agg(F.max("batch").alias("last"))
        return rows.join(last, KEYS, "left").where(F.col("last").isNull() | (F.col("last") <= F.col("batch"))).drop("last", "batch")

    def wanted(self, tokens: DataFrame) -> Column:
        """The condition on ``bucket`` that leaves the buckets of some tokens; their number is bounded by that of all buckets."""
        return F.col("bucket").isin([r[0] for r in tokens.select(self.bucket().alias("b")).distinct().collect()])

    def postings(self, tokens: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """(token, shard, keys, rank) of the tokens asked for, from their own buckets; of ``blocks`` (token, shard) only, if they are given."""
        found = self._read("postings", POSTING).where(self.wanted(tokens)).drop("bucket")
        own = sent(tokens.select("token").distinct() if blocks is None else blocks.distinct())
        return self.live(found.join(own, own.columns, "left_semi"))

    def blocks(self, tokens: DataFrame) -> DataFrame:
        """(token, shard, top, n) of the tokens asked for; what later batches changed still counts in them, so ``top`` is a bound."""
        found = self._read("blocks", BLOCK).join(sent(tokens.select("token").distinct()), "token", "left_semi")
        return found.groupBy("token", "shard").agg(F.max("top").alias("top"), F.sum("n").alias("n"))


def build(spark: SparkSession, root: str, notices: DataFrame, n_buckets: int | None = None, make: Callable[[DataFrame], DataFrame] = postings_of, characters_each: int = 10, kind: type[TextIndex] = TextIndex) -> TextIndex:
    """Indexes ``notices`` (keys and the fields of ``search.WEIGHTS``) in a new folder; the number of buckets follows the number of notices' postings.

    A search of some tokens then reads about as many of them. To fold what was appended since, build anew from the present notices.
    """
    if n_buckets is None:
        # A notice's postings are estimated by its characters, ``characters_each`` for one; buckets only have to be neither few nor tiny.
        characters = notices.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in ("title", "description") if c in notices.columns), F.lit(0)))).first()[0] or 0
        n_buckets = max(16, min(MOST_BUCKETS, int(characters / characters_each / EACH_BUCKET)))
    index = kind(spark, root, n_buckets, make)
    index._write(make(notices), -1)
    return index


def combined(postings: DataFrame, terms: DataFrame, need: DataFrame, match: str, keys: list[str] = KEYS) -> DataFrame:
    """(query_id, keys, text_rank) of postings (token, keys, rank) that meet ``terms`` (query_id, alternative, token): with ``match`` all, notices that have all tokens of an
    alternative; with any, those that have one. The best alternative's mean rank counts."""
    hits = postings.join(sent(terms), "token").groupBy("query_id", "alternative", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank"))
    met = hits.join(need, ["query_id", "alternative"])
    met = met.where("n = need") if match == "all" else met
    return met.groupBy("query_id", *keys).agg(F.max(F.col("rank") / F.col("need")).alias("text_rank"))


def best_matches(index: TextIndex, terms: DataFrame, need: DataFrame, sure: DataFrame, scored: Callable[[DataFrame], DataFrame], k: int, match: str = "all") -> DataFrame:
    """The results that the ``k`` best ones of each query are among, ties included, without evaluating every shard.

    ``terms`` has query_id, alternative and token; ``sure`` (query_id, keys) are notices that may score beyond their text rank: their shards are evaluated first, so
    that no other notice can score more than its shard's bound. ``scored`` makes results with query_id and score of (query_id, keys, text_rank),
    dropping what must not be found; score may not exceed 100 * text_rank but for ``sure`` notices. All inputs are read more than once: cut them before.
    """
    from .search import cut

    tops = index.blocks(terms).join(terms, "token").groupBy("query_id", "alternative", "shard").agg(F.count(F.lit(1)).alias("has"), F.sum("top").alias("top"))
    tops = tops.join(need, ["query_id", "alternative"])
    tops = tops.where("has = need") if match == "all" else tops
    bound = tops.groupBy("query_id", "shard").agg((F.max(F.col("top") / F.col("need")) * 100 + 1e-6).alias("bound"))
    forced = sure.select("query_id", shard_of()).distinct().withColumn("forced", F.lit(True))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard")  # at most SHARDS rows of each query
    shards = cut(bound.join(forced, ["query_id", "shard"], "full").withColumn("nth", F.row_number().over(order)))

    def evaluated(chosen: DataFrame) -> DataFrame:
        terms_of = chosen.select("query_id", "shard").join(terms, "query_id")
        rows = index.postings(terms, terms_of.select("token", "shard")).join(sent(terms_of), ["token", "shard"])
        hits = rows.groupBy("query_id", "alternative", *KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank")).join(need, ["query_id", "alternative"])
        hits = hits.where("n = need") if match == "all" else hits
        return hits.groupBy("query_id", *KEYS).agg(F.max(F.col("rank") / F.col("need")).alias("text_rank"))

    early = F.coalesce("forced", F.lit(False)) | (F.col("nth") <= FIRST_SHARDS)
    unranked = sure.select("query_id", *KEYS).withColumn("text_rank", F.lit(None).cast("double"))
    first = cut(scored(evaluated(shards.where(early)).unionByName(unranked).groupBy("query_id", *KEYS).agg(F.max("text_rank").alias("text_rank"))))
    kth = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", F.col("score").alias("kth"))
    late = shards.where(~early).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    return first.unionByName(scored(evaluated(late)).select(first.columns))
