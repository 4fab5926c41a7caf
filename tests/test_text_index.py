"""The stored index gives what reading all texts gives, from its own buckets only."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, text_index

WORDS = "boots survey surveys helmet radio army night vision goggles repair of the falling hopping ponies glass x1 2days".split()
SCHEMA = "portal string, notice_id string, title string, description string, published int, closing timestamp"


def as_of():
    return F.lit("2026-07-01 00:00:00").cast("timestamp")


def rows(rng, n):
    say = lambda most: " ".join(rng.choices(WORDS, k=rng.randrange(most)))
    return [(rng.choice("pq"), f"N{i}", say(4), say(12), rng.randrange(5), rng.choice([None, datetime(2026, 1, 1), datetime(2027, 1, 1)])) for i in range(n)]


def notices(spark, own):
    return spark.createDataFrame(own, SCHEMA).withColumns({c: F.lit(None).cast("string") for c in ("category", "organisation", "department")})


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(11)
    n = notices(spark, rows(rng, 400)).cache()
    asked = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(25)] + ["nvg", "n1", "n39", "boots", "helmet radio", "zzzz", ""]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string").cache()
    return n, q, text_index.build(spark, str(tmp_path_factory.mktemp("index")), n)


def found(df):
    return sorted((r.query_id, r.portal, r.notice_id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("match", ["all", "any"])
def test_equal_to_reading_texts(made, match):
    n, q, index = made
    assert found(search.fulltext_search(n, q, index, match)) == found(search.fulltext_search(n, q, None, match)) != []


@pytest.mark.parametrize("match", ["all", "any"])
def test_the_best_are_certain(spark, made, match):
    """A search that stops early has the first page that all results have, also with conditions of its own."""
    n, q, index = made
    own = q.where("q <> ''").withColumn("portals", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("p"))))
    page = lambda **more: sorted((r.query_id, r.rank, r.portal, r.notice_id, r.mode) for r in search.search(n, own, as_of(), limit=5, match=match, **more).collect())
    assert page(index=index, totals=False) == page() != []


def test_both_modes_differ(made):
    n, q, index = made
    every, some = (set(found(search.fulltext_search(n, q, index, m))) for m in ("all", "any"))
    assert len({x[:3] for x in every}) < len({x[:3] for x in some})


def test_only_asked_buckets_are_read(spark, made):
    n, q, index = made
    terms = search.alternatives(spark.createDataFrame([(1, "helmet")], "query_id int, q string"))
    bucket = terms.select(index.bucket()).first()[0]
    plan = index.postings(terms)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ (= {bucket}\)|IN \({bucket}\))", plan)
    read = {f.split("bucket=")[1].split("/")[0] for f in index._read("postings", text_index.POSTING).where(index.wanted(terms)).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {str(bucket)} and index.n_buckets == 16


def test_merges_keep_it_up(spark, tmp_path):
    """After inserts, updates, an expiry and replays the index finds what the present texts say."""
    rng = random.Random(12)
    state = {r[1]: r for r in rows(rng, 120)}
    index = text_index.build(spark, str(tmp_path / "i"), notices(spark, list(state.values())))
    queries = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "query_id int, q string")
    for batch in range(3):
        changed = [(state[k][0], k, *r[2:]) for k, r in zip(rng.sample(sorted(state), 20), rows(rng, 20))]
        new = [(p, f"new{batch}-{k}", *more) for p, k, *more in rows(rng, 10)]
        gone = rng.sample(sorted(set(state) - {r[1] for r in changed}), 10)
        removed = spark.createDataFrame([(state[k][0], k) for k in gone], "portal string, notice_id string")
        index.update(batch, notices(spark, changed[:5]), removed.limit(1))  # an attempt that was lost
        for _ in range(2):  # and a replay
            index.update(batch, notices(spark, changed + new), removed)
        state = {k: r for k, r in state.items() if k not in gone} | {r[1]: r for r in changed + new}
    present = notices(spark, list(state.values()))
    assert found(search.fulltext_search(present, queries, index)) == found(search.fulltext_search(present, queries))
    first = search.search(present, queries, as_of(), limit=3, index=index, totals=False)
    assert sorted((r.query_id, r.rank, r.notice_id) for r in first.collect()) == sorted((r.query_id, r.rank, r.notice_id) for r in search.search(present, queries, as_of(), limit=3).collect())
