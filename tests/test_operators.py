import random
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import alerts, lifecycle, search
from tidemark.sources import feed
from tidemark.sources.store import write_version
from tidemark.streaming.ingest import run_log, start_ingest

NOW = datetime(2026, 7, 1)


def as_of():
    return F.lit("2026-07-01 00:00:00").cast("timestamp")

ROW = "portal string, notice_id string, title string, closing timestamp, content_hash string"


def test_merge_equals_a_sequential_model(spark):
    rng = random.Random(7)
    dates = [None, datetime(2026, 6, 1), datetime(2026, 8, 1)]
    keys = [f"k{i}" for i in range(40)]
    stored = {k: ("old", f"h{rng.randint(0, 2)}") for k in keys[:15]}
    gone = set(keys[10:20])
    batch = [("p", rng.choice(keys), f"t{n}", rng.choice(dates), f"h{rng.randint(0, 2)}", n) for n in range(300)]
    expected, state, seen = {}, dict(stored), set()
    for _, k, title, closing, h, n in batch:
        if k in gone or (k not in state and closing is not None and closing < NOW):
            expected[n] = "skip"
            continue
        expected[n] = "insert" if k not in state else "touch" if state[k][1] == h else "update"
        seen.add(k)
        if expected[n] != "touch":
            state[k] = (title, h)
    b = spark.createDataFrame(batch, ROW + ", ordinal int")
    s = spark.createDataFrame([("p", k, t, None, h, NOW, "r0") for k, (t, h) in stored.items()], ROW + ", last_seen_at timestamp, last_seen_run string")
    t = spark.createDataFrame([("p", k) for k in gone], "portal string, notice_id string")
    new, actions = lifecycle.merge_snapshot(b, s, t, as_of(), "r1")
    assert {r.ordinal: r.action for r in actions.collect()} == expected
    got = {r.notice_id: r for r in new.collect()}
    assert {k: (r.title, r.content_hash) for k, r in got.items()} == state
    assert {k for k, r in got.items() if r.last_seen_run == "r1"} == seen
    counts = lifecycle.merge_counters(actions).first()
    assert counts.inserted == sum(v == "insert" for v in expected.values()) and counts.skipped == sum(v in ("skip", "touch") for v in expected.values())


def test_search_treats_signs_literally_and_ranks(spark):
    rows = [("p", "AB_1/2", "Night vision goggles", "for the army", None), ("p", "ABX1/2", "Boots", "ref AB_1/2", None), ("q", "Z", "Closed nvg", "", datetime(2026, 1, 1)), ("q", "Y", "Goggle for night visions", "100% off", None)]
    n = spark.createDataFrame(rows, "portal string, notice_id string, title string, description string, closing timestamp").withColumns({"published": F.lit(1), "category": F.lit(None).cast("string"), "organisation": F.lit(None).cast("string"), "department": F.lit(None).cast("string")})
    q = spark.createDataFrame([(1, "AB_1/2", "ab_1/2"), (2, "nvg", "nvg"), (3, "nigth vision gogles", "nigth vision gogles"), (4, "zzzz qqqq", "zzzz qqqq"), (5, "%", "")], "query_id int, q string, normal string")
    got = {}
    for r in search.search(n, q, as_of()).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.notice_id, r.score))
    assert sorted(got[1]) == [(1, "AB_1/2", 18000.0), (2, "ABX1/2", 4000.0)]
    assert {x[1] for x in got[2]} == {"AB_1/2", "Y"}  # the alias' words, stemmed; the closed one is out
    assert got[3][0][1] == "AB_1/2" or "AB_1/2" in {x[1] for x in got[3]}
    assert 4 not in got and 5 not in got


def test_alerts_send_once(spark):
    n = spark.createDataFrame([("p", "1", "red bolt", 1, None, "u1"), ("p", "2", "red <ring>", 2, NOW, "u2")], "portal string, notice_id string, title string, published int, closing timestamp, url string")
    subs = spark.createDataFrame([(1, ["red", "bolt"], True, "d@x.org"), (2, ["ring"], True, None), (3, ["red"], False, None), (4, [], True, None)], "user_id int, keywords array<string>, active boolean, delivery_email string")
    users = spark.createDataFrame([(i, f"u{i}@x.org") for i in range(1, 5)], "user_id int, email string")
    log = spark.createDataFrame([(2, "p", "9")], "user_id int, portal string, notice_id string")
    digests, fresh = alerts.alert_cycle(n, subs, users, log, as_of())
    got = {r.user_id: r for r in digests.collect()}
    assert set(got) == {1, 2}
    assert (got[1].address, got[1].subject, got[2].subject) == ("d@x.org", "2 new notices matching your alerts", "1 new notice matching your alerts")
    assert "closes unknown" in got[1].body and "&lt;ring&gt;" in got[2].html
    log = alerts.log_delivered(fresh, spark.createDataFrame([(1,)], "user_id int"), log)
    assert {(r.user_id, r.notice_id) for r in alerts.alert_cycle(n, subs, users, log, as_of())[1].collect()} == {(2, "2")}
    assert alerts.log_delivered(fresh, spark.createDataFrame([(1,)], "user_id int"), log).count() == log.count()


def test_expire_keeps_earlier_tombstones(spark):
    n = spark.createDataFrame([("p", "a", datetime(2026, 5, 1)), ("p", "b", None), ("p", "c", datetime(2026, 9, 1))], "portal string, notice_id string, closing timestamp")
    t = spark.createDataFrame([("p", "a", datetime(2025, 1, 1), datetime(2025, 1, 1))], "portal string, notice_id string, closed_at timestamp, deleted_at timestamp")
    left, gone = lifecycle.expire(n, t, as_of(), 2)
    assert {r.notice_id for r in left.collect()} == {"b", "c"}
    assert [(r.notice_id, r.closed_at.year) for r in gone.collect()] == [("a", 2025)]
    assert lifecycle.expire(n.limit(0), t, as_of())[0].count() == 0


def test_stream_is_idempotent_and_respects_tombstones(spark, tmp_path):
    root, source = str(tmp_path / "store"), str(tmp_path / "in")
    empty = spark.createDataFrame([], ROW + ", last_seen_at timestamp, last_seen_run string")
    gone = spark.createDataFrame([("p", "dead", NOW, NOW)], "portal string, notice_id string, closed_at timestamp, deleted_at timestamp")
    write_version(spark, root, {"notices": empty, "tombstones": gone})
    rows = [("p", "1", "a", None, "h1"), ("p", "dead", "b", None, "h"), ("p", "late", "c", datetime(2026, 1, 1), "h"), ("p", None, "d", None, "h")]
    sent, counters, rejected = [], {}, {}
    run = lambda: start_ingest(spark, source, ROW, root, str(tmp_path / "cp"), lambda n: "2026-07-01 00:00:00", lambda df, n: sent.extend((n, r.notice_id) for r in df.collect()), counters.__setitem__, lambda n, df: rejected.__setitem__(n, [r.notice_id for r in df.collect()])).awaitTermination(120)
    spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(source)
    run()
    spark.createDataFrame(rows[:1], ROW).coalesce(1).write.mode("append").parquet(source)
    run()
    got = feed.present(spark, root, "notices", lifecycle.KEYS).collect()
    assert [(r.notice_id, r.title, r.last_seen_run) for r in got] == [("1", "a", "batch-1")]
    assert sent == [(0, "1"), (1, "1")]
    assert counters[0] == {"inserted": 1, "updated": 0, "skipped": 2, "failed": 1, "status": "success", "rows": 3, "closed_on_arrival": 1}
    assert counters[1] == {"inserted": 0, "updated": 0, "skipped": 1, "failed": 0, "status": "success", "rows": 1, "closed_on_arrival": 0}
    assert rejected == {0: [None], 1: []}


def test_writes_follow_the_batch_and_failures_leave_one_row(spark, tmp_path):
    from pathlib import Path

    import pytest

    def size(folder):
        return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))

    root, source, cp = (str(tmp_path / n) for n in ("store", "in", "cp"))
    text = F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(4)])
    rows = spark.range(30_000).select(F.lit("p").alias("portal"), F.col("id").cast("string").alias("notice_id"), text.alias("title"), F.lit(None).cast("timestamp").alias("closing"), F.col("id").cast("string").alias("content_hash"))
    gone = spark.createDataFrame([], "portal string, notice_id string, closed_at timestamp, deleted_at timestamp")
    write_version(spark, root, {"notices": rows.withColumns({"last_seen_at": F.lit(NOW), "last_seen_run": F.lit("r0")}), "tombstones": gone})
    before = size(root)
    batch = rows.where("notice_id % 30 = 0").withColumns({"title": F.concat(F.lit("new "), "title"), "content_hash": F.concat(F.lit("n"), "content_hash")})
    batch.coalesce(1).write.parquet(source)
    tried = []

    def alert(df, n):
        tried.append(df.count())
        if len(tried) == 1:
            raise ValueError("no mail")

    start = lambda **more: start_ingest(spark, source, ROW, root, cp, lambda n: "2026-07-01 00:00:00", alert, **more)
    with pytest.raises(Exception, match="no mail"):
        start().awaitTermination(120)
    assert [(r.batch, r.status, "no mail" in r.message) for r in run_log(spark, root).collect()] == [(0, "failed", True)]
    start().awaitTermination(120)
    assert [(r.batch, r.status, r.updated, r.skipped, r.message) for r in run_log(spark, root).collect()] == [(0, "success", 1000, 0, None)]
    assert tried == [1000, 1000]
    grown = size(root) - before - size(root + "/runs")
    assert 0 < grown < 2 * size(source) and grown < before / 10
    now = {r.notice_id: r.title for r in feed.present(spark, root, "notices", lifecycle.KEYS).collect()}
    assert len(now) == 30_000 and sum(t.startswith("new ") for t in now.values()) == 1000
    assert start(name="off", enabled=False) is None
    assert sorted((r.query, r.status) for r in run_log(spark, root).collect()) == [("ingest", "success"), ("off", "skipped")]


def test_search_modes_conditions_and_pages(spark):
    rows = [("p", "A1", "Red boots", "open", 3), ("q", "B2", "Surveying the boots", "open", 2), ("p", "C3/2026", "Helmet for surveys", "closed", 1), ("q", "D4", "Boot", "closed", None)]
    n = spark.createDataFrame(rows, "portal string, notice_id string, title string, status string, published int").withColumns({c: F.lit(None).cast("string") for c in ("description", "category", "organisation", "department")} | {"closing": F.lit(None).cast("timestamp")})
    asked = [
        (1, "the boots", None, None, None), (2, None, ["survey"], None, None), (3, None, None, ["q"], None), (4, " ", [], None, "closed"), (5, "C3/", None, None, None),
        (6, "c3/2026", ["helmet"], None, None), (7, "Boots", None, ["p"], "open"), (8, "boots", None, ["p"], "closed"), (9, "\uff22\uff12", None, None, None), (10, "--- !", None, None, None), (11, "the", None, None, None),
    ]
    q = spark.createDataFrame(asked, "query_id int, q string, keywords array<string>, portals array<string>, status string")
    got = {}
    for r in search.search(n, q, as_of()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.mode, r.notice_id, r.total_count))
    assert {x[1] for x in got[1]} == {"A1", "B2", "D4"} and {x[0] for x in got[1]} == {"text"}
    assert {x[1] for x in got[2]} == {"B2", "C3/2026"}
    assert got[3] == [("browse", "B2", 2), ("browse", "D4", 2)] and got[4] == [("browse", "C3/2026", 2), ("browse", "D4", 2)]
    assert got[5] == [("raw_reference", "C3/2026", 1)]
    assert 6 not in got  # a structured reference that nothing holds does not fall through
    assert [x[1] for x in got[7]] == ["A1"] and {x[0] for x in got.get(8, [])} <= {"fuzzy"}
    assert got[9] == [("text", "B2", 1)] and 10 not in got and all(x[0] == "fuzzy" for x in got.get(11, []))


def test_references_equal_brute_force_and_no_plan_compares_all_pairs(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ab1/-_ x2") for _ in range(rng.randint(1, 25)))
    rows = [("p", f"{i}{text()}", text(), text() if i % 3 else None) for i in range(150)]
    n = spark.createDataFrame(rows, "portal string, notice_id string, title string, description string").withColumns({"published": F.lit(1), "closing": F.lit(None).cast("timestamp")})
    asked = [(i, t[a : a + rng.randint(1, 5)]) for i, (_, _, t, _) in enumerate(rows) for a in (rng.randint(0, 8),)] + [(900, "%"), (901, "//"), (902, "  ")]
    found = search.reference_search(n, spark.createDataFrame(asked, "query_id int, q string"))
    expected = set()
    for i, q in asked:
        q = q.strip(" ").lower()
        for _, key, title, description in rows:
            score = 10000 * (key == q) + 8000 * (q in key) + 6000 * (q in title) + 4000 * (q in (description or ""))
            if q and score:
                expected.add((i, key, float(score)))
    assert {(r.query_id, r.notice_id, r.score) for r in found.collect()} == expected
    full = n.withColumns({c: F.lit(None).cast("string") for c in ("category", "organisation", "department")})
    words = spark.createDataFrame([(1, "ab1"), (2, "x2")], "query_id int, q string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (search.fulltext_search(full, words), search.tiered_search(full, words), search.reference_search(full, words), search.search(full, words, as_of()), alerts.keyword_matches(full, words.select(F.col("q").alias("keyword")), as_of())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_operators(spark):
    n = spark.createDataFrame([("Spares", "Army", None), ("Tank", "Navy", None), ("Tank", "Navy", "kept")], "title string, organisation string, relevance string").withColumns({"category": F.lit(None).cast("string"), "department": F.lit(None).cast("string")})
    assert [r.relevance for r in lifecycle.backfill_relevance(n).collect()] == ["irrelevant", "relevant", "kept"]
    assert [r.relevance for r in lifecycle.backfill_relevance(n.withColumn("title", F.lit("Counterspare")), legacy=True).collect()] == ["irrelevant", "irrelevant", "kept"]
    words = ["boots", "surveying", "surveyed", "surveys", "hopping", "hoped", "agreed", "ponies", "caresses", "ring", "red", "sky", "glass", "2days", "falling"]
    got = [r.token for r in search.stemmed(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    assert got == ["boot", "survei", "survei", "survei", "hop", "hope", "agree", "poni", "caress", "ring", "red", "sky", "glass", "2days", "fall"]


def test_every_word_begins_as_its_stem_says(spark):
    bases = ["hop", "hope", "stat", "agre", "pla", "pon", "mis", "fil", "siz", "go", "a", "tr", "conflat", "fail", "happ", "sk", "see", "feed", "bed", "y", "s", "tann", "fizz", "e", "eb"]
    ends = ["", "s", "es", "ies", "sses", "ed", "eds", "ing", "ings", "eed", "eeds", "y", "ys", "ying", "yings", "ied", "ping", "pings", "ped", "e", "ee", "ss", "bling", "ated", "izing", "bed"]
    words = search.stemmed(spark.createDataFrame([(b + e,) for b in bases for e in ends], "word string").distinct())
    for word, token in [tuple(r) for r in words.select("word", "token").collect()]:
        assert word[:2] in by_token(spark, token), (word, token)


_INITIALS: dict[str, set[str]] = {}


def by_token(spark, token):
    if token not in _INITIALS:
        _INITIALS[token] = {r[0] for r in search.initials(spark.createDataFrame([(token,)], "token string")).collect()}
    return _INITIALS[token]
