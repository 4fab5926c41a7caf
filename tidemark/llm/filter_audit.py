"""How filters act on each other: what each removes, in every order, and what would have gone anyway.

Each filter has a relation of its own, the numbers of the rows that fail it, written once. A left-anti join with a filter's
relation is what survives it, a left-semi join of survivors with it is what it removes from them. What survives a prefix of an
order depends on the set of its filters alone, so 2^n sets stand for all n! orders; rows that fail nothing
survive every one of them and are only counted.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words end at a space or one of the five ASCII line and tab characters.
NO_WORD = r"[\x20\x09-\x0D]+"
COUNTS = ["n", "good", "toxic"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, NO_WORD), lambda w: w != "")


def text_rules(text: Column, words: Column) -> dict[str, Column]:
    """Conditions under which a text fails: few words, repeated words, many capitals, signs."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(row, id, part, digest, A, B, C, D) of every row: its number, its part, its text's SHA-256 and the rules of the text alone.

    Null texts count as empty, null parts as the empty string. Other columns are ignored. A row's number holds for what is written
    from it; write it before it is used twice.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    worded = source.withColumn("w", words_of(F.col("t")))
    rules = text_rules(F.col("t"), F.col("w"))
    return worded.select("row", "id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[c.alias(k) for k, c in rules.items()])


def repeated(rows: DataFrame) -> DataFrame:
    """The ``rows`` (id, digest) whose text stands under a smaller id, too; rows without an id neither fail nor make others fail.

    Only ids that are not the first of their text stay, so the join's key is (id, digest): a text of very many rows is
    no hot key.
    """
    named = rows.where("id is not null")
    return named.join(named.groupBy("digest").agg(F.min("id").alias("id")), ["id", "digest"], "left_anti")


def failing_relations(rows: DataFrame) -> dict[str, DataFrame]:
    """One stored relation (row) for each filter: the numbers of the rows that fail it."""
    found = {k: rows.where(F.col(k)) for k in "ABCD"} | {"E": repeated(rows)}
    return {k: stored(df.select("row"), f"audit-fails-{k}") for k, df in found.items()}


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with good and toxic: whether a label row of their id has quality 1, and toxic 1. An id's label rows count as one."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    marks = own.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    return rows.join(marks, "id", "left").withColumns({m: F.coalesce(m, F.lit(0)) for m in ("good", "toxic")})


def counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def survivors(rows: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """``rows`` once for each set of filters that they survive (``gone``, a bit for each filter in order).

    One anti-join for each filter; a row goes on with and without the filter in its set, and the join takes away those that
    fail it and have it. All joins are on the row's number, so the rows are dealt out once.
    """
    alive = rows.withColumn("gone", F.lit(0))
    for bit, (name, df) in enumerate(fails.items()):
        both = alive.withColumn("gone", F.explode(F.array("gone", F.col("gone") + (1 << bit)))).alias("a")
        alive = both.join(df.alias("f"), (F.col("a.row") == F.col("f.row")) & F.col("a.gone").bitwiseAND(F.lit(1 << bit)).cast("boolean"), "left_anti")
    return alive


def removals(rows: DataFrame, fails: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(part, gone, n, good, toxic) of the survivors of each set of filters, and (part, gone, filter, n, good, toxic) of those of them that a filter removes.

    Only rows that fail something are followed.
    """
    failing = reduce(DataFrame.unionAll, fails.values())
    alive = stored(survivors(rows.join(failing, "row", "left_semi"), fails).select("row", "part", "gone", "good", "toxic"), "audit-survivors")
    removed = [alive.join(df, "row", "left_semi").withColumn("filter", F.lit(name)) for name, df in fails.items()]
    return counted(alive, "part", "gone"), counted(reduce(DataFrame.unionAll, removed), "part", "gone", "filter")


def order_steps(names: list[str]) -> list[tuple[str, int, str, int]]:
    """(filter_order, step, filter, gone): the steps of every order, and the set of the filters before each."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    return [("".join(order), i + 1, f, sum(bit[g] for g in order[:i])) for order in permutations(names) for i, f in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step, as ``part, filter_order, step`` and counts of the part's rows:

    kept after the step, removed by it, redundant (its filter's failing rows that earlier ones removed), unique_fails (failing
    its filter only), good_lost and toxic_lost (removed rows with these labels), shapley (its filter's removed over all orders).
    Every row of ``docs`` counts, also repeated ones and those without an id (these have no label and no smaller id). An empty table
    has no part and gives no rows. Extra columns are ignored.
    """
    rows = stored(facts(docs, id_col, text_col, part_col), "audit-facts")
    fails = failing_relations(rows)
    names = list(fails)
    marked = stored(labelled(rows.select("row", "id", "part"), labels, id_col), "audit-marked")
    alive, removed = (stored(df, f"audit-{n}") for df, n in zip(removals(marked, fails), ("alive", "removed"), strict=True))
    totals = counted(marked, "part")
    # Survivors that fail nothing: all rows of the part less those that the empty set has.
    followed = alive.where("gone = 0").select("part", F.col("n").alias("followed"))
    parts = totals.join(followed, "part", "left").select("part", (F.col("n") - F.coalesce("followed", F.lit(0))).alias("clean"))
    spark, everything = docs.sparkSession, (1 << len(names)) - 1
    steps = spark.createDataFrame(order_steps(names), "filter_order string, step int, filter string, gone int").withColumn("bit", F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(names) for x in (f, 1 << i)]), F.col("filter")))
    kinds = steps.groupBy("filter", "bit", "gone").agg(F.count("*").alias("orders"))  # 80 rows
    # All that a filter does after each set of others, zeros included.
    wanted = parts.withColumn("k", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("filter", "bit", "gone", "orders"), k, strict=True)]) for k in sorted(map(tuple, kinds.collect()))]))).select("part", "clean", "k.*")
    done = wanted.join(removed, ["part", "filter", "gone"], "left").join(alive.select("part", F.col("gone").alias("after"), F.col("n").alias("left")), (wanted["part"] == alive["part"]) & (F.col("after") == wanted["gone"] + wanted["bit"]), "left")
    done = done.select(wanted["part"], wanted["filter"], wanted["gone"], "bit", "orders", (F.col("clean") + F.coalesce("left", F.lit(0))).alias("kept"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    each = done.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("n")).alias("shapley"), F.max(F.when(F.col("gone") == 0, F.col("n"))).alias("fails"), F.max(F.when(F.col("gone") + F.col("bit") == everything, F.col("n"))).alias("unique_fails"))
    out = done.join(each, ["part", "filter"]).join(F.broadcast(steps.select("filter_order", "step", "filter", "gone")), ["filter", "gone"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
