"""The stored index of grams finds what reading all texts finds, from the buckets of the rarest grams only."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, substring_index

SCHEMA = "portal string, notice_id string, title string, description string"


def rows(rng, n, first=0):
    text = lambda most: "".join(rng.choice("abE1/-_ x2é😀%") for _ in range(rng.randint(0, most)))
    return [("p", f"{i}/{text(4)}", text(25), text(60) if i % 3 else None) for i in range(first, first + n)]


def notices(spark, own):
    return spark.createDataFrame(own, SCHEMA).withColumn("published", F.lit(1))


def by_hand(own, asked):
    out = set()
    for i, q in asked:
        q = q.strip(" ").lower()
        for _, key, title, description in own:
            key_, title, description = key.lower(), title.lower(), (description or "").lower()
            score = 10000 * (key_ == q) + 8000 * (q in key_) + 6000 * (q in title) + 4000 * (q in description)
            if q and score:
                out.add((i, key, float(score)))
    return out


def found(df):
    rows = [(r.query_id, r.notice_id, r.score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(5)
    own = rows(rng, 150)
    own.append(("p", "long", "", "".join(rng.choice("abcdefgh ") for _ in range(5000)) + "zq" + "k" * 1020 + "/ /end"))
    asked = [(i, t[3][a : a + rng.randint(1, 7)]) for i, t in enumerate(own[:60]) if t[3] for a in (rng.randint(0, 30),)]
    asked += [(900, "%"), (901, "//"), (902, "  "), (903, "/ /e"), (904, "zqk"), (905, own[150][3][1020:1030]), (906, "nobody"), (907, ""), (908, "😀"), (909, own[150][3][:3000]), (910, "kkkk/")]
    return own, asked, notices(spark, own).cache(), substring_index.build(spark, str(tmp_path_factory.mktemp("grams")), notices(spark, own))


def test_equal_to_brute_force_with_and_without_the_index(spark, made):
    own, asked, n, index = made
    q = spark.createDataFrame(asked, "query_id int, q string")
    assert found(search.reference_search(n, q, index)) == by_hand(own, asked) == found(search.reference_search(n, q))


def test_no_notice_meets_all_queries_and_few_buckets_are_read(spark, made):
    _, _, n, index = made
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for signs in ("//", "%"):
            q = spark.createDataFrame([(1, signs)], "query_id int, q string")
            for own in (index, None):
                plan = search.reference_search(n, q, own)._jdf.queryExecution().toString()
                assert "NestedLoop" not in plan and "Cartesian" not in plan
        plan = substring_index.candidates(index, q)._jdf.queryExecution().executedPlan().toString()
        bucket = q.select(index.bucket("q")).first()[0]
        assert f"= {bucket})" in plan or f"IN ({bucket})" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merges_keep_it_up(spark, tmp_path):
    rng = random.Random(6)
    state = {r[1]: r for r in rows(rng, 60)}
    index = substring_index.build(spark, str(tmp_path / "g"), notices(spark, list(state.values())))
    changed = [(r[0], k, *r[2:]) for k, r in zip(rng.sample(sorted(state), 12), rows(rng, 12))] + rows(rng, 8, 500)
    gone = rng.sample(sorted(set(state) - {r[1] for r in changed}), 10)
    removed = spark.createDataFrame([("p", k) for k in gone], "portal string, notice_id string")
    index.update(0, notices(spark, changed[:3]), removed.limit(1))  # an attempt that was lost
    index.update(0, notices(spark, changed), removed)
    state = {k: r for k, r in (state | {r[1]: r for r in changed}).items() if k not in gone}
    own = list(state.values())
    asked = [(i, r[2][2:5]) for i, r in enumerate(own[:40])] + [(99, "/"), (98, "x2"), (97, gone[0])]
    assert found(search.reference_search(notices(spark, own), spark.createDataFrame(asked, "query_id int, q string"), index)) == by_hand(own, asked)


def test_empty_table(spark, tmp_path):
    none = notices(spark, []).limit(0)
    index = substring_index.build(spark, str(tmp_path / "e"), none)
    q = spark.createDataFrame([(1, "ab"), (2, "//")], "query_id int, q string")
    assert search.reference_search(none, q, index).collect() == [] == search.reference_search(none, q).collect()
