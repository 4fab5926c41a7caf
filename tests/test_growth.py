"""What a step shuffles, keeps in one task or sends to the driver grows no faster than its input."""

import random
import re
from html import unescape

from pyspark.sql import functions as F

from tidemark.functions import html
from tidemark.operators import alerts, pages, search, substring_index
from tidemark.plans import views
from tidemark.sources import html_feeds

SCHEMA = "portal string, notice_id string, title string, description string, published int"


def made(spark, n, words):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choices(words, k=40))
    return spark.createDataFrame([("p", f"N{i}", say(), say(), i) for i in range(n)], SCHEMA)


def test_a_notice_has_no_more_postings_than_runs(spark):
    notices = made(spark, 20, ["survey", "helmet", "radio", "night vision", "x1/2"])
    runs = notices.select(F.sum(sum(F.size(substring_index.runs(c)) for c in ("notice_id", "title", "description")))).first()[0]
    found = substring_index.postings_of(notices)
    assert found.count() <= runs
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_stored_table_of_many_short_rows_is_read_by_several_tasks(spark, tmp_path):
    rows = spark.range(2 * views.EACH_FILE + 1, numPartitions=1).selectExpr("'p' AS portal", "concat('N', id) AS notice_id", "'x' AS title", "'' AS description")
    stored, _ = views.indexed(spark, str(tmp_path), "short rows", rows)
    files = [r.n for r in stored.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(files) == 3 and max(files) < views.EACH_FILE and sum(files) == 2 * views.EACH_FILE + 1
    assert views.dealt(rows.limit(10)).rdd.getNumPartitions() == 1


def test_ranges_of_a_stored_order_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "MOST_RANGES", 4)
    rows = made(spark, 100, ["a"]).drop("title", "description")
    stored = pages.store_order(rows, str(tmp_path / "o"), each=5)
    assert len(stored.starts) <= 5 and stored.total == 100
    assert [r.published for r in stored.page(3).collect()] == list(range(59, 39, -1))


def test_few_keys_that_most_rows_have_are_sent_to_the_tasks(spark):
    """Neither users with one keyword nor notices with one word are dealt by it."""
    users = spark.range(500).select(F.col("id").alias("user_id"), F.array(F.lit("red")).alias("keywords"), F.lit(True).alias("active"))
    matches = spark.createDataFrame([("red", "p", "1", 1)], "keyword string, portal string, notice_id string, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [alerts.user_matches(users, matches)]
        plans.append(search.reference_search(made(spark, 20, ["customer"]), spark.createDataFrame([(1, "customer")], "query_id int, q string")))
        for plan in (p._jdf.queryExecution().executedPlan().toString() for p in plans):
            assert "BroadcastHashJoin [keyword" in plan or "BroadcastHashJoin [word" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_are_counted_inside_their_row(spark):
    notices = made(spark, 20, ["survey", "surveys", "Helmet", "radio", "the"])
    found = search.field_words(notices, search.KEYS)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    by_hand = sorted((r.notice_id, f, w, r[f].lower().split().count(w)) for r in notices.collect() for f in ("title", "description") for w in set(r[f].lower().split()) - {"the"})
    assert sorted((r.notice_id, r.field, r.word, r.tf) for r in found.collect()) == by_hand
    none = spark.createDataFrame([("p", "1", None, "the  ", 1), ("p", "2", "", "a-b", 1)], SCHEMA)
    assert {(r.notice_id, r.word) for r in search.field_words(none, search.KEYS).collect()} <= {("2", "a"), ("2", "b")}
    assert search.token_table(none, search.KEYS).where("token = 'b'").select("rank").collect()[0][0] == 0.1


def test_a_listing_row_is_read_once(spark):
    """Conditions and columns do not repeat what a row's cells are read with."""
    pages = spark.createDataFrame([(1, "<table></table>", "https://e.org/app")], "page_no long, html string, base_url string")
    plan = html_feeds.listing(pages, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AM") <= 6 and plan.count("regexp_replace") <= 40


def test_a_block_is_read_in_one_pass(spark):
    """Both layouts come from one scan of the pages, a block of both classes as either."""
    head = '<div class="samer update-nag"><a class="coli-tno">A1</a><a class="tDesc">one in Division No: D.</a><span class="coli-date">02/01/1999 10:00 AM</span>'
    pages = spark.createDataFrame([(1, head + "<h4>Jan</h4><h4>3</h4><h4>09:00 AM</h4><p>x</p><p>A2</p><p>two</p></div>", "u")], "page_no long, html string, base_url string")
    found = html_feeds.block_listing(pages, "c", F.lit("1998-06-01").cast("timestamp"))
    assert sorted((r.notice_id, r.title, r.department, str(r.closing)) for r in found.collect()) == [("A1", "one", "D", "1999-01-02 10:00:00"), ("A2", "two", None, "1999-01-03 09:00:00")]
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_python_sees_references_and_no_markup(spark):
    texts = ["<p>a &amp; b</p>", "&eacute;&#233;&#xE9; &lt;x&gt;", "&notit; &foo; &bar", "&#38;lt; &eacute&#59; &&amp;&", "none", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string").select("i", html.decoded("html").alias("d"))
    sign = lambda m: html.MARKUP_SIGNS.get(unescape(m[0]), unescape(m[0]))
    assert [r.d for r in rows.orderBy("i").collect()] == [None if t is None else re.sub(html.REFERENCE, sign, t) for t in texts]
    udf = rows._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython [", 1)[1]
    assert udf.startswith("characters(CASE WHEN Contains(html")


def test_words_are_ranked_and_titles_matched_without_a_shuffle_of_words_or_trigrams(spark, monkeypatch):
    notices = views.documents(spark, "/root/testdata/sf0.001").withColumn("organisation", F.when(F.length("description") % 2 == 0, F.substring("description", 1, 80)))
    ranks = search.token_table(notices, search.KEYS)
    assert "Exchange" not in ranks._jdf.queryExecution().executedPlan().toString()
    as_rows = lambda df: {(r.portal, r.notice_id, r.token): round(r.rank, 9) for r in df.collect()}
    assert as_rows(ranks) == as_rows(search.weighted(search.stemmed(search.field_words(notices, search.KEYS)), search.KEYS))
    queries = notices.select(F.xxhash64("notice_id").alias("query_id"), F.substring("title", 1, 30).alias("q")).limit(40).cache()
    few = search.similar_titles(notices, queries)
    assert "hashpartitioning(gram" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "MOST_SENT", 0)
    many = search.similar_titles(notices, queries)
    assert few.count() > 40 and sorted(few.collect()) == sorted(many.collect())
