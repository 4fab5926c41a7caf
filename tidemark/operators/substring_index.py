"""A stored index of ids, titles and descriptions for searches by containment, signs and blanks included.

Its tokens are the *runs* of a field in lower case: what stands between changes from letters and digits to signs and blanks, and back. Where a text contains a query, the
query's inner runs are runs of the text, its first one ends such a run, its last one begins one, and a single one stands inside of one. So a search looks the runs with a query's
beginnings up in the *vocabulary* (grams of one to three characters of the distinct runs, far fewer than those of all texts), counts the runs found in the blocks, reads the
postings of the rarest ones only, and verifies the notices that have them all. Postings, blocks, merges and replays are those of ``text_index.TextIndex``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text_index
from .text_index import KEYS, MOST_SENT, TextIndex

FIELDS = ("notice_id", "title", "description")
#: Characters of a gram, and the runs of a query that are intersected; one that many more notices have than the rarest is left to the verification.
GRAM, RAREST, MORE = 3, 4, 8
RUNS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
VOCABULARY = "gram string, token string, bucket int"


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many characters of a text; it is cut into characters once, so the work is linear."""
    run = lambda chars, n: F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[chars[i + k] for k in range(n)]))).otherwise(F.array().cast("array<string>"))
    once = F.transform(F.array(F.split(text, "")), lambda chars: F.flatten(F.array(*[run(chars, n) for n in sizes])))
    return F.array_distinct(once[0])


def runs(text: Column) -> Column:
    """The runs of letters and digits, and those of other characters, in their order: joined they are the text."""
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))


def postings_of(notices: DataFrame) -> DataFrame:
    """(token, keys, rank) of the distinct runs of the notices' fields; a notice's are known from its row alone."""
    fields = [F.coalesce(runs(F.lower(c)), F.array().cast("array<string>")) for c in FIELDS if c in notices.columns]
    found = notices.select(*KEYS, F.explode(F.array_distinct(F.flatten(F.array(*fields)))).alias("token"))
    return found.select("token", *KEYS, F.lit(0.0).alias("rank"))


@dataclass(frozen=True)
class SubstringIndex(TextIndex):
    """A text index of runs, with ``vocabulary/batch=/bucket=``: the grams of the runs that a batch brought, in buckets by gram."""

    def _write(self, rows: DataFrame, batch: int) -> None:
        super()._write(rows, batch)
        own = self.spark.read.schema("token string").parquet(f"{self.root}/blocks/batch={batch}").distinct()
        each = own.select("token", F.explode(grams(F.col("token"), list(range(1, GRAM + 1)))).alias("gram"))
        dealt = each.select("gram", "token", self.bucket("gram").alias("bucket")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/vocabulary/batch={batch}")

    def vocabulary(self, wanted: DataFrame) -> DataFrame:
        """(gram, token) of the grams asked for, from their own buckets."""
        found = self._read("vocabulary", VOCABULARY).where(self.wanted(wanted.select(F.col("gram").alias("token"))))
        return found.select("gram", "token").join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi")


def build(spark: SparkSession, root: str, notices: DataFrame, n_buckets: int | None = None) -> TextIndex:
    """Indexes the runs of ``notices`` in a new folder; a notice has one for several characters."""
    return text_index.build(spark, root, notices, n_buckets, make=postings_of, characters_each=5, kind=SubstringIndex)


def candidates(index: SubstringIndex, asked: DataFrame) -> DataFrame:
    """(query_id, keys) of the notices that have a query's rarest runs; ``asked`` (query_id, q) is in lower case, trimmed and not empty.

    A query with a run that no notice has finds none.
    """
    from .search import cut

    own = asked.select("query_id", F.posexplode(runs(F.col("q"))).alias("at", "run"), (F.size(runs(F.col("q"))) - 1).alias("last"))
    begun, ended = F.col("at") == 0, F.col("at") == F.col("last")
    own = cut(own.withColumns({"begun": begun, "ended": ended, "gram": F.left("run", F.lit(GRAM))}))
    outer = own.where("begun or ended")
    # An inner run is one of the text's, the first may be its end, the last its beginning.
    fits = (F.col("begun") | F.startswith("token", "run")) & (F.col("ended") | F.endswith("token", "run")) & F.contains("token", "run")
    met = index.vocabulary(outer).join(F.broadcast(outer), "gram").where(fits).select("query_id", "at", "token")
    tokens = met.unionAll(own.where("not begun and not ended").select("query_id", "at", F.col("run").alias("token"))).distinct()
    known = cut(tokens)
    counts = cut(known.join(index.blocks(known).groupBy("token").agg(F.sum("n").alias("df")), "token").groupBy("query_id", "at").agg(F.sum("df").alias("df"), F.count(F.lit(1)).alias("tokens")))
    rarest = Window.partitionBy("query_id").orderBy("df", "at")  # as many rows as a query has runs
    ranked = own.select("query_id", "at").join(counts, ["query_id", "at"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.withColumns({"nth": F.row_number().over(rarest), "least": F.min("df").over(Window.partitionBy("query_id"))})
    picked = cut(ranked.where((F.col("nth") <= RAREST) & (F.col("df") <= MORE * F.col("least")) & (F.col("least") > 0)).select("query_id", "at", "tokens"))
    chosen = tokens.join(F.broadcast(picked.drop("tokens")), ["query_id", "at"])
    chosen = F.broadcast(chosen) if (picked.agg(F.sum("tokens")).first()[0] or 0) <= MOST_SENT else chosen
    need = picked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    # A query's runs are places in it: a notice may have several tokens for one, and one token may stand for several.
    hits = index.postings(known.join(F.broadcast(picked.select("query_id", "at")), ["query_id", "at"])).join(chosen, "token").groupBy("query_id", *KEYS).agg(F.size(F.collect_set("at")).alias("n"))
    return hits.join(F.broadcast(need), "query_id").where("n = need").select("query_id", *KEYS)
