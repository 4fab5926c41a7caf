"""All registered queries of the notice operators, each with its SQL equivalent."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, html, text
from ..operators import alerts, lifecycle, pages, reports, search, text_index
from ..sources import html_feeds, json_feeds, store
from . import views
from .views import AS_OF, DOCUMENTS_SQL, MERGE_SQL, ORDERS_SQL, RUN_AS_OF, RUNS_SQL, as_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
O_SQL, N_SQL, R_SQL = f"WITH {ORDERS_SQL} ", f"WITH {DOCUMENTS_SQL} ", f"WITH {RUNS_SQL} "


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = inspect.cleandoc(sql)
        return f

    return keep


def stamp(c):
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


# Merge and lifecycle


@query(MERGE_SQL + "SELECT portal, notice_id, ordinal, action FROM actions")
def merge_actions(spark, d):
    found = lifecycle.merge_actions(views.batch(spark, d), views.stored_notices(spark, d), views.tombstones(spark, d), as_of())
    return found.select("portal", "notice_id", "ordinal", "action")


@query(MERGE_SQL + """SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action IN ('skip', 'touch')) AS skipped,
    CAST(0 AS BIGINT) AS failed, 'success' AS status FROM actions""")
def merge_counters(spark, d):
    counted = lifecycle.merge_counters(lifecycle.merge_actions(views.batch(spark, d), views.stored_notices(spark, d), views.tombstones(spark, d), as_of()))
    return counted.withColumn("status", lifecycle.run_status(*map(F.col, ("inserted", "updated", "skipped", "failed"))))


SNAPSHOT_SQL = f""", seen AS (SELECT DISTINCT portal, notice_id FROM actions WHERE action <> 'skip'),
written AS (SELECT *, row_number() OVER (PARTITION BY portal, notice_id ORDER BY ordinal DESC) AS nth FROM actions WHERE action IN ('insert', 'update'))
SELECT coalesce(w.portal, s.portal) AS portal, coalesce(w.notice_id, s.notice_id) AS notice_id, CAST(coalesce(w.value, s.value) AS VARCHAR) AS value, coalesce(w.content_hash, s.content_hash) AS content_hash,
  CASE WHEN k.portal IS NULL THEN 'run-0' ELSE 'run-1' END AS last_seen_run
FROM stored s FULL JOIN (SELECT * FROM written WHERE nth = 1) w ON s.portal = w.portal AND s.notice_id = w.notice_id
LEFT JOIN seen k ON k.portal = coalesce(w.portal, s.portal) AND k.notice_id = coalesce(w.notice_id, s.notice_id)"""


@query(MERGE_SQL + SNAPSHOT_SQL)
def merge_snapshot(spark, d):
    new, _ = lifecycle.merge_snapshot(views.batch(spark, d), views.stored_notices(spark, d), views.tombstones(spark, d), as_of(), "run-1")
    return new.select("portal", "notice_id", F.col("value").cast("string").alias("value"), "content_hash", "last_seen_run")


@query(MERGE_SQL + SNAPSHOT_SQL)
def replayed_batch(spark, d):
    """The same batch merged twice: the second time changes nothing."""
    once, _ = lifecycle.merge_snapshot(views.batch(spark, d).where("ordinal = 1").unionByName(views.batch(spark, d).where("ordinal = 2")), views.stored_notices(spark, d), views.tombstones(spark, d), as_of(), "run-1")
    last = views.batch(spark, d).groupBy("portal", "notice_id").agg(F.max("ordinal").alias("ordinal"))
    again = views.batch(spark, d).join(last, ["portal", "notice_id", "ordinal"], "left_semi")
    twice, _ = lifecycle.merge_snapshot(again, once, views.tombstones(spark, d), as_of(), "run-1")
    return twice.select("portal", "notice_id", F.col("value").cast("string").alias("value"), "content_hash", "last_seen_run")


@query(O_SQL + f"SELECT portal, notice_id FROM orders_n WHERE closing IS NULL OR closing >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS")
def expire_survivors(spark, d):
    return lifecycle.expire(views.orders(spark, d), views.tombstones(spark, d), as_of(), 30)[0].select("portal", "notice_id")


@query(O_SQL + f"""SELECT portal, notice_id, {STAMP.format('closing')} AS closed_at FROM orders_n
    WHERE closing < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS OR (category = '5-LOW' AND status = 'F')""")
def expire_tombstones(spark, d):
    return lifecycle.expire(views.orders(spark, d), views.tombstones(spark, d), as_of(), 30)[1].select("portal", "notice_id", stamp("closed_at").alias("closed_at"))


@query(O_SQL + f"""SELECT portal, notice_id, 'kept' AS state FROM orders_n WHERE organisation NOT LIKE '%7'
    UNION ALL SELECT portal, notice_id, 'tombstone' FROM orders_n WHERE organisation LIKE '%7' OR (category = '5-LOW' AND status = 'F')""")
def suppress_ids(spark, d):
    notices = views.orders(spark, d)
    kept, gone = lifecycle.suppress(notices, views.tombstones(spark, d), notices.where("organisation like '%7'"), as_of())
    return kept.select("portal", "notice_id", F.lit("kept").alias("state")).unionByName(gone.select("portal", "notice_id", F.lit("tombstone").alias("state")))


@query("""SELECT c_custkey, CASE WHEN n.last IS NULL THEN c_mktsegment ELSE n.last END AS segment FROM customer
    LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY ALL) n ON c_custkey = o_custkey""")
def settings_upsert(spark, d):
    current = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("segment"), F.col("o_orderkey").alias("ordinal"))
    return lifecycle.upsert_by_key(current, changes, ["c_custkey"])


@query(O_SQL + "SELECT organisation, category, count(*) AS n FROM orders_n GROUP BY ALL HAVING count(*) > 1")
def key_violations(spark, d):
    return lifecycle.key_violations(views.orders(spark, d), ["organisation", "category"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_children(spark, d):
    return lifecycle.orphans(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'")
def cascade_delete(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return lifecycle.cascade(table(spark, d, "orders"), customers.where("c_mktsegment = 'MACHINERY'"), "o_custkey").join(customers, "o_custkey", "left_semi").select("o_orderkey")


@query(O_SQL + """SELECT lower(regexp_replace(portal, '[^a-zA-Z0-9]+', '', 'g')) AS portal, notice_id, title FROM orders_n WHERE status <> 'F'
    UNION ALL SELECT lower(regexp_replace(portal, '[^a-zA-Z0-9]+', '', 'g')), notice_id, 'legacy' FROM orders_n WHERE status = 'F'""")
def legacy_import(spark, d):
    notices = views.orders(spark, d)
    current = notices.where("status <> 'F'").select(text.slug(F.col("portal")).alias("portal"), "notice_id", "title")
    legacy = notices.select(F.col("portal").alias("name"), "notice_id", F.lit("legacy").alias("title"))
    return store.legacy_import(current, legacy, "name", None, ["portal", "notice_id"])


KNOWN_SQL = "known AS (SELECT unnest([" + ", ".join(f"{{'i': {i}, 'name': '{n}', 'key': '{k}'}}" for i, (n, k) in enumerate(text.KNOWN_PORTALS.items())) + "], recursive := true))"


def _named_portals(spark, d):
    """Customers with the name of a known portal, or of one that nobody knows."""
    names = F.array(*map(F.lit, text.KNOWN_PORTALS))
    name = F.try_element_at(names, (F.col("c_nationkey") + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("notice_id"), F.coalesce(name, F.concat(F.lit("New Portal "), "c_nationkey")).alias("name"), F.col("c_acctbal").alias("balance"))


@query(f"""WITH {KNOWN_SQL}, rows AS (SELECT CAST(c_custkey AS VARCHAR) AS notice_id, coalesce(key, 'newportal' || c_nationkey) AS portal, c_acctbal FROM customer LEFT JOIN known ON i = c_nationkey)
    SELECT portal, notice_id, CASE WHEN c_acctbal > 0 THEN 'stored' ELSE 'legacy' END AS title FROM rows""")
def legacy_known_names(spark, d):
    """An import under known keys; rows that are stored under these keep their title."""
    rows = _named_portals(spark, d)
    current = rows.where("balance > 0").select(text.slug(F.col("name"), text.KNOWN_PORTALS).alias("portal"), "notice_id", F.lit("stored").alias("title"))
    return store.legacy_import(current, rows.select("name", "notice_id", F.lit("legacy").alias("title")), "name", text.KNOWN_PORTALS, ["portal", "notice_id"])


@query(f"""WITH {KNOWN_SQL} SELECT CAST(c_custkey AS VARCHAR) AS notice_id, name AS portal_name, CASE WHEN key IS NULL THEN 'unknown' WHEN key = 'ireps' THEN 'disabled' ELSE 'enabled' END AS state FROM customer LEFT JOIN known ON i = c_nationkey""")
def registry_by_key(spark, d):
    rows = _named_portals(spark, d).select("notice_id", text.slug(F.col("name"), text.KNOWN_PORTALS).alias("portal"))
    state = F.when(F.col("enabled"), "enabled").when(~F.col("enabled"), "disabled").otherwise("unknown")
    return store.registered(rows, "portal", store.registry(spark)).select("notice_id", "portal_name", state.alias("state"))


@query(O_SQL + f""", latest AS (SELECT n_name AS portal, max(CAST(o_orderdate AS TIMESTAMP)) AS run_started FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY ALL)
    SELECT portal, notice_id FROM orders_n JOIN latest USING (portal) WHERE closing < run_started""")
def staleness(spark, d):
    rows = views.orders(spark, d)
    full = rows.where("status = 'F'").select("portal", F.col("closing").alias("run_started"))
    return lifecycle.staleness(rows.withColumn("last_seen_at", F.col("closing")), full).select("portal", "notice_id")


# Search

OPEN_SQL = f"(closing IS NULL OR closing >= TIMESTAMP '{AS_OF}')"
WORDS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ASKED_SQL = rf"""asked AS (SELECT item_id AS query_id, array_to_string({WORDS_SQL.format("arg_min(s, (len(" + WORDS_SQL.format('s') + "), i))")}, ' ') AS q
  FROM (SELECT item_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[.,\n]+') AS l FROM benchmark)) WHERE len({WORDS_SQL.format('s')}) > 1 GROUP BY item_id)"""
STOPS_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
V_SQL = "'[aeiou]|[^aeiou]y'"
LESS_SQL = "substring({0}, 1, length({0}) - {1})"


def stems_sql(words: str) -> str:
    """Rows of ``words`` with their token, step by step in lateral aliases."""
    a2, a3, s_b = LESS_SQL.format("s_a", 2), LESS_SQL.format("s_a", 3), "s_b"
    return rf"""(SELECT *, regexp_full_match(word, '[a-z]{{3,}}') AS s_ok,
      CASE WHEN NOT s_ok OR suffix(word, 'ss') OR NOT suffix(word, 's') THEN word WHEN suffix(word, 'sses') OR suffix(word, 'ies') THEN {LESS_SQL.format('word', 2)} ELSE {LESS_SQL.format('word', 1)} END AS s_a,
      CASE WHEN NOT s_ok OR suffix(s_a, 'eed') THEN NULL WHEN suffix(s_a, 'ed') AND regexp_matches({a2}, {V_SQL}) THEN {a2} WHEN suffix(s_a, 'ing') AND regexp_matches({a3}, {V_SQL}) THEN {a3} END AS s_b,
      CASE WHEN s_b IS NULL AND s_ok AND suffix(s_a, 'eed') AND regexp_matches({a3}, '[aeiouy][^aeiouy]') THEN {LESS_SQL.format('s_a', 1)} WHEN s_b IS NULL THEN s_a
        WHEN regexp_matches(s_b, '(at|bl|iz)$') OR regexp_matches(s_b, '^[^aeiou]*[aeiouy][^aeiouwxy]$') THEN s_b || 'e' WHEN regexp_matches(s_b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {LESS_SQL.format(s_b, 1)} ELSE s_b END AS s_c,
      CASE WHEN s_ok AND suffix(s_c, 'y') AND regexp_matches({LESS_SQL.format('s_c', 1)}, {V_SQL}) THEN {LESS_SQL.format('s_c', 1)} || 'i' ELSE s_c END AS token FROM ({words}) WHERE word NOT IN {STOPS_SQL})"""


def asked(spark, d):
    """A query for each benchmark text: its shortest phrase of two words or more, the first of equal ones."""
    phrases = F.transform(F.split("text", r"[.,\n]+"), lambda s, i: F.struct(F.size(search.words_of(s)).alias("n"), i.alias("at"), search.words_of(s).alias("words")))
    least = F.array_min(F.filter(phrases, lambda p: p["n"] > 1))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(least["words"], " ").alias("q")).where("q is not null")


@query(O_SQL + f"""SELECT portal, notice_id, (SELECT count(*) FROM orders_n WHERE {OPEN_SQL}) AS total_count, CAST(ceil((SELECT count(*) FROM orders_n WHERE {OPEN_SQL}) / 20.0) AS BIGINT) AS pages
    FROM orders_n WHERE {OPEN_SQL} ORDER BY closing DESC NULLS LAST, portal, notice_id LIMIT 20 OFFSET 20""")
def browse_page(spark, d):
    found = search.filtered(views.orders(spark, d), as_of()).withColumn("published", F.col("closing"))
    return search.browse(found, page=2).select("portal", "notice_id", "total_count", "pages")


@query(O_SQL + """, ranked AS (SELECT portal, notice_id, count(*) OVER () AS total_count, row_number() OVER (ORDER BY closing DESC NULLS LAST, portal, notice_id) - 1 AS place FROM orders_n),
    asked AS (SELECT unnest(['first', 'middle', 'last']) AS depth, unnest([0, t // 40, (t - 1) // 20]) AS page FROM (SELECT count(*) AS t FROM orders_n))
    SELECT depth, portal, notice_id, total_count FROM ranked JOIN asked ON place // 20 = page""")
def deep_pages(spark, d):
    """The first, a middle and the last page of a stored order of all orders."""
    rows = views.orders(spark, d).withColumn("published", F.col("closing"))
    stored = pages.store_order(rows, f"{views.shared_folder(spark)}/order-{uuid.uuid4().hex}", each=1000)
    depths = {"first": 1, "middle": stored.total // 40 + 1, "last": (stored.total - 1) // 20 + 1}
    return reduce(DataFrame.unionAll, [stored.page(p).select(F.lit(depth).alias("depth"), "portal", "notice_id", "total_count") for depth, p in depths.items()])


@query(O_SQL + f"""SELECT portal, notice_id, {STAMP.format('closing')} AS closing FROM orders_n
    WHERE {OPEN_SQL} AND portal IN ('NATION_1', 'NATION_2', 'NATION_3') AND status = 'O' AND closing BETWEEN TIMESTAMP '1998-07-01' AND TIMESTAMP '1999-07-01'""")
def filtered_rows(spark, d):
    found = search.filtered(views.orders(spark, d), as_of(), portals=["NATION_1", "NATION_2", "NATION_3"], portal="NATION_9", status="O", closing_from=as_of("1998-07-01"), closing_to=as_of("1999-07-01"))
    return found.select("portal", "notice_id", stamp("closing").alias("closing"))


@query(N_SQL + f""", asked AS (SELECT page_id AS query_id, 'd' || page_id AS q FROM pages)
    SELECT query_id, portal, notice_id, CAST(sum(points) AS DOUBLE) AS score FROM (
      SELECT query_id, portal, notice_id, (CASE WHEN lower(notice_id) = q THEN 10000 ELSE 0 END) + (CASE WHEN contains(lower(notice_id), q) THEN 8000 ELSE 0 END)
        + (CASE WHEN contains(lower(title), q) THEN 6000 ELSE 0 END) + (CASE WHEN contains(lower(description), q) THEN 4000 ELSE 0 END) AS points
      FROM documents_n, asked WHERE contains(lower(notice_id), q) OR contains(lower(title), q) OR contains(lower(description), q)) GROUP BY ALL""")
def reference_search(spark, d):
    queries = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.concat(F.lit("d"), F.col("page_id")).alias("q"))
    return search.reference_search(views.documents(spark, d), queries).select("query_id", "portal", "notice_id", "score")


@query(N_SQL + r""", asked AS (SELECT item_id AS query_id, lower(trim(substring(text, 11, 14))) AS q FROM benchmark UNION ALL SELECT -1 - r_regionkey, ['//', '%', ' - ', ',', '. t'][r_regionkey + 1] FROM region)
    SELECT query_id, portal, notice_id, CAST(sum(points) AS DOUBLE) AS score FROM (
      SELECT query_id, portal, notice_id, (CASE WHEN lower(notice_id) = trim(q) THEN 10000 ELSE 0 END) + (CASE WHEN contains(lower(notice_id), trim(q)) THEN 8000 ELSE 0 END)
        + (CASE WHEN contains(lower(title), trim(q)) THEN 6000 ELSE 0 END) + (CASE WHEN contains(lower(description), trim(q)) THEN 4000 ELSE 0 END) AS points
      FROM documents_n, asked WHERE trim(q) <> '') WHERE points > 0 GROUP BY ALL""")
def substring_search(spark, d):
    """Passages of benchmark texts, cut anywhere, and signs, by the stored grams of the documents."""
    notices, grams = views.substrings_of_documents(spark, d)
    passages = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.substring("text", 11, 14).alias("q"))
    signs = F.array(*map(F.lit, ("//", "%", " - ", ",", ". t")))
    asked = passages.unionByName(table(spark, d, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("query_id"), F.try_element_at(signs, (F.col("r_regionkey") + 1).cast("int")).alias("q")))
    return search.reference_search(notices, asked, grams).select("query_id", "portal", "notice_id", "score")


def index_sql(documents: str = "documents_n", asked: str = ASKED_SQL, match: str = "n = need") -> str:
    return f"""{DOCUMENTS_SQL}, {asked},
fields AS (SELECT portal, notice_id, 1.0 AS weight, {WORDS_SQL.format('title')} AS words, 1 AS f FROM {documents}
  UNION ALL SELECT portal, notice_id, 0.2, {WORDS_SQL.format('description')}, 2 FROM {documents} UNION ALL SELECT portal, notice_id, 0.2, {WORDS_SQL.format('category')}, 3 FROM {documents}),
tf AS (SELECT portal, notice_id, weight, f, token, count(*) AS tf FROM {stems_sql('SELECT portal, notice_id, weight, f, unnest(words) AS word FROM fields')} GROUP BY ALL),
ranks AS (SELECT portal, notice_id, token, sum(CAST(weight AS DOUBLE) * tf / (tf + 1)) AS rank FROM tf GROUP BY ALL),
terms AS (SELECT DISTINCT query_id, q, token FROM {stems_sql(f"SELECT query_id, q, unnest({WORDS_SQL.format('q')}) AS word FROM asked")}),
need AS (SELECT query_id, count(*) AS need FROM terms GROUP BY ALL),
hits AS (SELECT query_id, portal, notice_id, count(*) AS n, sum(rank) AS rank FROM ranks JOIN terms USING (token) GROUP BY ALL),
matched AS (SELECT query_id, portal, notice_id, rank / need AS text_rank FROM hits JOIN need USING (query_id) WHERE {match}),
found AS (SELECT m.query_id, m.portal, m.notice_id, (CASE WHEN lower(m.notice_id) = q THEN 1000 ELSE 0 END) + (CASE WHEN lower(title) = q THEN 500 ELSE 0 END) + (CASE WHEN starts_with(lower(m.notice_id), q) THEN 200 ELSE 0 END)
  + round(100 * coalesce(text_rank, 0), 6) AS score
  FROM (SELECT query_id, portal, notice_id, text_rank FROM matched UNION ALL
    SELECT query_id, portal, notice_id, NULL FROM {documents} JOIN asked ON starts_with(lower(notice_id), q) WHERE (query_id, portal, notice_id) NOT IN (SELECT query_id, portal, notice_id FROM matched)) m
  JOIN asked USING (query_id) JOIN documents_n n ON n.portal = m.portal AND n.notice_id = m.notice_id),
rest AS (SELECT * FROM asked WHERE query_id NOT IN (SELECT query_id FROM found) AND q <> ''),
tg AS (SELECT title, {GRAMS_SQL.format(WORDS_SQL.format('title'))} AS g FROM (SELECT DISTINCT title FROM {documents})), qg AS (SELECT query_id, q, {GRAMS_SQL.format(WORDS_SQL.format('q'))} AS g FROM rest),
near AS (SELECT query_id, q, title, len(list_intersect(tg.g, qg.g)) AS c, len(tg.g) AS n, len(qg.g) AS m FROM tg, qg),
tiers AS (SELECT query_id, portal, notice_id, 'text' AS tier, CAST(round(score, 3) AS DOUBLE) AS score FROM found
  UNION ALL SELECT query_id, d.portal, d.notice_id, 'fuzzy', CAST(round((CASE WHEN lower(near.title) = q THEN 500 ELSE 0 END) + round(10 * c / (n + m - c), 6), 3) AS DOUBLE) FROM near JOIN {documents} d ON d.title = near.title WHERE c / (n + m - c) > 0.2)"""


GRAMS_SQL = """list_distinct(flatten(list_transform({}, lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""
INDEX_SQL = index_sql()


def _scores(rows):
    return rows.select("query_id", "portal", "notice_id", F.round("score", 3).alias("score"))


FOUND_SQL = "SELECT query_id, portal, notice_id, CAST(round(score, 3) AS DOUBLE) AS score FROM found"


@query(f"WITH {INDEX_SQL} {FOUND_SQL}")
def fulltext_search(spark, d):
    notices, index = views.indexed_documents(spark, d)
    return _scores(search.fulltext_search(notices, asked(spark, d), index))


@query(f"WITH {INDEX_SQL} {FOUND_SQL}")
def fulltext_scan(spark, d):
    """The same without an index."""
    return _scores(search.fulltext_search(views.documents(spark, d), asked(spark, d)))


@query(f"""WITH {index_sql("(SELECT * FROM documents_n WHERE portal <> (SELECT min(source) FROM documents))")} {FOUND_SQL}""")
def index_updates(spark, d):
    """An index of other texts, after two batches: inserts and updates bring the documents' own, and a source expires."""
    now = views.documents(spark, d)
    kind = F.pmod(F.xxhash64("notice_id"), F.lit(3))
    root = f"{views.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = text_index.build(spark, root, now.where(kind > 0).withColumn("description", F.when(kind == 1, F.reverse("description")).otherwise(F.col("description"))))
    index.update(0, now.where(kind < 2))
    gone = now.join(now.agg(F.min("portal").alias("least")), F.col("portal") == F.col("least")).select("portal", "notice_id")
    index.update(1, now.where("false"), gone)
    return _scores(search.fulltext_search(now.join(gone, ["portal", "notice_id"], "left_anti"), asked(spark, d), index))


@query(f"""WITH {index_sql(match="true")} SELECT query_id, portal, notice_id, rank FROM (SELECT f.*, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, published DESC NULLS LAST, f.portal, f.notice_id) AS INTEGER) AS rank
    FROM found f JOIN documents_n n ON n.portal = f.portal AND n.notice_id = f.notice_id) WHERE rank <= 10""")
def search_any(spark, d):
    """The ten best notices with any word of a query; shards that cannot hold one of them are not read."""
    notices, index = views.indexed_documents(spark, d)
    found = search.fulltext_search(notices, asked(spark, d), index, match="any", best=10)
    return alerts.top_per_group(found, ["query_id"], [F.desc("score"), F.desc_nulls_last("published"), F.col("portal"), F.col("notice_id")], 10).select("query_id", "portal", "notice_id", "rank")


@query(f"""WITH {INDEX_SQL}, ranked AS (SELECT f.query_id, f.portal, f.notice_id, count(*) OVER (PARTITION BY f.query_id) AS total_count,
    row_number() OVER (PARTITION BY f.query_id ORDER BY round(score, 3) DESC, published DESC NULLS LAST, f.portal, f.notice_id) AS rank FROM found f JOIN documents_n n ON n.portal = f.portal AND n.notice_id = f.notice_id)
    SELECT query_id, portal, notice_id, CAST(rank AS INTEGER) AS rank, total_count, CAST(ceil(total_count / 5.0) AS BIGINT) AS pages FROM ranked WHERE rank BETWEEN 6 AND 10""")
def ranked_page(spark, d):
    notices, index = views.indexed_documents(spark, d)
    found = search.fulltext_search(notices, asked(spark, d), index).withColumn("score", F.round("score", 3))
    return search.ranked_page(found, page=2, limit=5).select("query_id", "portal", "notice_id", "rank", "total_count", "pages")


ACRONYMS_SQL = "names AS (SELECT unnest([" + ", ".join(f"{{'k': '{k}', 'v': '{v[0]}', 'i': {i}}}" for i, (k, v) in enumerate(text.ALIASES.items())) + "], recursive := true))"


@query(rf"""WITH {ASKED_SQL}, {ACRONYMS_SQL}, every AS (SELECT query_id, 0 AS alternative, q AS text FROM asked UNION ALL SELECT -1 - n_nationkey, 0, k FROM nation JOIN names ON n_nationkey % 8 = i UNION ALL SELECT -1 - n_nationkey, 1, v FROM nation JOIN names ON n_nationkey % 8 = i)
    SELECT DISTINCT query_id, alternative, token FROM {stems_sql(f"SELECT query_id, alternative, unnest({WORDS_SQL.format('text')}) AS word FROM every")}""")
def alias_terms(spark, d):
    """Terms of each alternative of a query; acronyms, one for each nation, have a second one."""
    names = F.array(*map(F.lit, text.ALIASES))
    acronyms = table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("query_id"), F.element_at(names, (F.col("n_nationkey") % 8 + 1).cast("int")).alias("q"))
    return search.alternatives(asked(spark, d).unionByName(acronyms)).select("query_id", "alternative", "token")


@query(f"SELECT p_partkey, array_to_string(list_sort({GRAMS_SQL.format(WORDS_SQL.format('p_name'))}), '|') AS grams FROM part")
def trigram_sets(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(search.trigrams(F.col("p_name"))), "|").alias("grams"))


SIMILAR_SQL = f"""names AS (SELECT DISTINCT p_name AS title FROM part), brands AS (SELECT DISTINCT p_name AS q, min(p_partkey) AS query_id FROM part GROUP BY ALL),
a AS (SELECT title, {GRAMS_SQL.format(WORDS_SQL.format('title'))} AS g FROM names), b AS (SELECT query_id, {GRAMS_SQL.format(WORDS_SQL.format('q'))} AS g FROM brands),
pairs AS (SELECT query_id, title, len(list_intersect(a.g, b.g)) AS c, len(a.g) AS n, len(b.g) AS m FROM a, b)"""


@query(f"""WITH {SIMILAR_SQL} SELECT query_id, p_partkey AS notice_id, CAST(round(c / (n + m - c), 6) AS DOUBLE) AS similarity FROM pairs JOIN part ON p_name = title WHERE c / (n + m - c) > 0.2""")
def similar_titles(spark, d):
    """Every distinct part name as a query against all part names."""
    part = table(spark, d, "part")
    notices = part.select(F.col("p_brand").alias("portal"), F.col("p_partkey").alias("notice_id"), F.col("p_name").alias("title"))
    queries = part.groupBy(F.col("p_name").alias("q")).agg(F.min("p_partkey").alias("query_id"))
    return search.similar_titles(notices, queries).select("query_id", "notice_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {INDEX_SQL}, qa AS (SELECT query_id, q, {GRAMS_SQL.format(WORDS_SQL.format('q'))} AS g FROM asked WHERE q <> ''),
    close AS (SELECT query_id, q, title, len(list_intersect(tg.g, qa.g)) AS c, len(tg.g) AS n, len(qa.g) AS m FROM tg, qa),
    sims AS (SELECT query_id, portal, notice_id, CASE WHEN lower(d.title) = q THEN 500 ELSE 0 END AS tier, round(10 * c / (n + m - c), 6) AS part FROM close JOIN documents_n d USING (title) WHERE c / (n + m - c) > 0.2)
    SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.portal, s.portal) AS portal, coalesce(f.notice_id, s.notice_id) AS notice_id, CAST(round(coalesce(score, tier) + coalesce(part, 0), 3) AS DOUBLE) AS score
    FROM found f FULL JOIN sims s ON f.query_id = s.query_id AND f.portal = s.portal AND f.notice_id = s.notice_id""")
def fuzzy_search(spark, d):
    notices, index = views.indexed_documents(spark, d)
    return _scores(search.fuzzy_search(notices, asked(spark, d), index))


@query(f"WITH {INDEX_SQL} SELECT query_id, portal, notice_id, tier, score FROM tiers")
def tiered_search(spark, d):
    notices, index = views.indexed_documents(spark, d)
    return search.tiered_search(notices, asked(spark, d), index=index).select("query_id", "portal", "notice_id", "tier", F.round("score", 3).alias("score"))


@query(r"""WITH n AS (SELECT page_id, url AS q, trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}\s/_\-.]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM pages
      UNION ALL SELECT -1 - item_id, text, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s/_\-.]', ' ', 'g'), '\s+', ' ', 'g')) FROM benchmark)
    SELECT page_id AS query_id, normal, CASE WHEN trim(q) = '' THEN 'browse' WHEN length(trim(q)) >= 3 AND (regexp_full_match(trim(q), '[0-9]+') OR regexp_matches(trim(q), '[/_.:&,-]')) THEN 'raw_reference'
      WHEN length(normal) >= 6 AND regexp_matches(normal, '[a-zA-Z]') AND regexp_matches(normal, '[0-9]') AND regexp_matches(normal, '[/_.-]') THEN 'structured_reference' ELSE 'text' END AS mode FROM n""")
def query_modes(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("q")).union(table(spark, d, "benchmark").select(-1 - F.col("item_id"), "text"))
    rows = rows.withColumn("normal", text.normalize_query(F.col("q")))
    return rows.select("query_id", "normal", search.query_mode(F.col("q"), F.col("normal"), F.array("q"), F.lit(True)).alias("mode"))


PAGED_SQL = "count(*) OVER (PARTITION BY query_id) AS total_count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, published DESC NULLS LAST, portal, notice_id) AS INTEGER) AS rank"


@query(O_SQL + f""", met AS (SELECT n_nationkey AS query_id, portal, notice_id, 0.0 AS score, closing AS published FROM orders_n JOIN nation ON portal = n_name WHERE {OPEN_SQL} AND status = 'O' AND closing <= TIMESTAMP '1999-07-01' + to_days(CAST(n_nationkey AS INTEGER))
      UNION ALL SELECT -1, portal, notice_id, 0.0, closing FROM orders_n WHERE {OPEN_SQL})
    SELECT query_id, portal, notice_id, rank, total_count, mode FROM (SELECT *, {PAGED_SQL}, 'browse' AS mode FROM met) WHERE rank <= 20""")
def search_browse(spark, d):
    """A browse query for each nation with conditions of its own, and one without any."""
    to = F.lit("1999-07-01").cast("timestamp") + F.make_dt_interval(F.col("n_nationkey"))
    queries = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("query_id"), F.lit("").alias("q"), F.array("n_name").alias("portals"), F.lit("O").alias("status"), to.alias("closing_to"))
    every = queries.limit(1).select(F.lit(-1).alias("query_id"), F.lit(" ").alias("q"))
    found = search.search(views.orders(spark, d).withColumn("published", F.col("closing")), queries.unionByName(every, allowMissingColumns=True), as_of())
    return found.select("query_id", "portal", "notice_id", "rank", "total_count", "mode")


@query(O_SQL + f""", asked AS (SELECT DISTINCT o_orderpriority AS query_id, lower(o_orderpriority) || ' customer' AS q FROM orders),
    met AS (SELECT query_id, portal, notice_id, 6000.0 AS score, closing AS published FROM orders_n JOIN asked ON contains(lower(title), q) WHERE {OPEN_SQL} AND status = 'O')
    SELECT query_id, portal, notice_id, rank, total_count, mode FROM (SELECT *, {PAGED_SQL}, 'structured_reference' AS mode FROM met) WHERE rank <= 20""")
def search_keywords(spark, d):
    """Keywords that together have the shape of a reference."""
    queries = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id")).distinct().select("query_id", F.lit(None).cast("string").alias("q"), F.array("query_id", F.lit("Customer")).alias("keywords"), F.lit("O").alias("status"))
    found = search.search(views.orders(spark, d).withColumn("published", F.col("closing")), queries, as_of())
    return found.select("query_id", "portal", "notice_id", "rank", "total_count", "mode")


CHOSEN_SQL = "chosen AS (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 2)"


@query(f"""WITH {CHOSEN_SQL}, {index_sql("(SELECT * FROM documents_n WHERE portal IN (SELECT source FROM chosen))")},
    met AS (SELECT t.query_id, t.portal, t.notice_id, tier AS mode, score, published FROM tiers t JOIN documents_n n ON n.portal = t.portal AND n.notice_id = t.notice_id)
    SELECT query_id, portal, notice_id, total_count, mode FROM (SELECT *, {PAGED_SQL} FROM met) WHERE rank <= 100""")
def search_text(spark, d):
    """Text queries that are narrowed to two portals each."""
    portals = [r[0] for r in table(spark, d, "documents").select("source").distinct().orderBy("source").limit(2).collect()]
    queries = asked(spark, d).withColumn("portals", F.array(*map(F.lit, portals)))
    notices, index = views.indexed_documents(spark, d)
    found = search.search(notices, queries, as_of(), limit=100, index=index)
    return found.select("query_id", "portal", "notice_id", "total_count", "mode")


# Labels and reports

LABEL_SQL = (
    rf"""CASE WHEN regexp_matches(coalesce(title, '') || ' ' || coalesce(category, ''), '(?i)(^|[^A-Za-z0-9_])({text.COMPONENT_WORDS})($|[^A-Za-z0-9_])') THEN 'irrelevant' """
    rf"""WHEN regexp_matches(coalesce(organisation, '') || ' ' || coalesce(department, ''), '(?i)(^|[^A-Za-z0-9_])({text.DEFENCE_WORDS})($|[^A-Za-z0-9_])') THEN 'relevant' """
    rf"""WHEN regexp_matches(coalesce(organisation, '') || ' ' || coalesce(department, ''), '(?i)(^|[^A-Za-z0-9_])({text.CIVIL_WORDS})($|[^A-Za-z0-9_])') THEN 'irrelevant' ELSE 'unclassified' END"""
)
LABELLED_SQL = "labelled AS (SELECT p_partkey, p_type AS title, p_name AS category, p_brand AS organisation, CASE WHEN p_size < 10 THEN 'Air  Force' WHEN p_size > 40 THEN 'City Hospital' ELSE p_name END AS department FROM part)"


def _labelled(spark, d):
    department = F.when(F.col("p_size") < 10, "Air  Force").when(F.col("p_size") > 40, "City Hospital").otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("title"), F.col("p_name").alias("category"), F.col("p_brand").alias("organisation"), department.alias("department"))
    return rows.withColumn("relevance", text.relevance(*map(F.col, ("title", "category", "organisation", "department"))))


@query(f"WITH {LABELLED_SQL} SELECT p_partkey, {LABEL_SQL} AS relevance FROM labelled")
def relevance_labels(spark, d):
    return _labelled(spark, d).select("p_partkey", "relevance")


@query(f"WITH {LABELLED_SQL} SELECT {LABEL_SQL} AS relevance, count(*) AS n FROM labelled GROUP BY ALL")
def relevance_counts(spark, d):
    return reports.relevance_counts(_labelled(spark, d))


@query("SELECT source AS portal, count(*) AS n FROM documents GROUP BY ALL")
def portal_counts(spark, d):
    return reports.portal_counts(views.documents(spark, d))


@query(O_SQL + f"""SELECT count(*) AS total, count(*) FILTER (closing BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 7 DAYS) AS closing_soon, count(*) FILTER (closing >= TIMESTAMP '1998-06-01') AS created_today,
    count(*) FILTER ({OPEN_SQL} AND (contains(lower(title), 'urgent') OR contains(lower(title), '5-low'))) AS phrase_matches FROM orders_n""")
def dashboard_stats(spark, d):
    return reports.dashboard_stats(views.orders(spark, d).withColumn("created", F.col("closing")), as_of(), ["Urgent", "5-LOW"], F.col("title"))


@query(R_SQL + "SELECT portal, arg_max(stated_total, (started, run_id)) FILTER (stated_total IS NOT NULL) AS stated_total FROM runs GROUP BY ALL HAVING count(stated_total) > 0")
def stated_totals(spark, d):
    return reports.stated_totals(views.runs(spark, d))


@query(R_SQL + """, s AS (SELECT portal, arg_max(stated_total, (started, run_id)) FILTER (stated_total IS NOT NULL) AS stated_total FROM runs GROUP BY ALL), c AS (SELECT portal, count(DISTINCT user_id) AS n FROM runs WHERE status = 'failed' GROUP BY ALL)
    SELECT coalesce(s.portal, c.portal) AS portal, coalesce(n, 0) AS n_stored, stated_total, greatest(0, stated_total - coalesce(n, 0)) AS gap FROM s FULL JOIN c ON s.portal = c.portal""")
def coverage_gap(spark, d):
    runs = views.runs(spark, d)
    return reports.coverage(runs.where("status = 'failed'").groupBy("portal").agg(F.count_distinct("user_id").alias("n")), reports.stated_totals(runs))


@query(R_SQL + f"SELECT {STAMP.format('max(finished)')} AS last_finished FROM runs WHERE status IN ('success', 'partial')")
def last_finished(spark, d):
    return reports.last_finished(views.runs(spark, d)).select(stamp("last_finished").alias("last_finished"))


SUMMARY_SQL = f"""registry AS (SELECT DISTINCT event_type AS portal FROM events UNION SELECT n_name FROM nation),
last AS (SELECT portal, arg_max(status, (started, run_id)) AS last_status, max(started) AS last_started, max(started) FILTER (status = 'success') AS last_success FROM runs GROUP BY ALL),
notices AS (SELECT n_name AS portal, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _summary(spark, d):
    registry = table(spark, d, "events").select(F.col("event_type").alias("portal")).union(table(spark, d, "nation").select("n_name")).distinct()
    return reports.portal_summary(registry, views.runs(spark, d), reports.portal_counts(views.orders(spark, d)))


@query(R_SQL + f", {SUMMARY_SQL} SELECT r.portal, last_status, {STAMP.format('last_started')} AS last_started, {STAMP.format('last_success')} AS last_success, coalesce(n, 0) AS n FROM registry r LEFT JOIN last USING (portal) LEFT JOIN notices USING (portal)")
def portal_summary(spark, d):
    return _summary(spark, d).select("portal", "last_status", stamp("last_started").alias("last_started"), stamp("last_success").alias("last_success"), "n")


@query(R_SQL + f", {SUMMARY_SQL} SELECT r.portal, CASE WHEN r.portal LIKE '%_1%' THEN 'disabled' WHEN last_status = 'running' THEN 'running' WHEN last_status IS NULL THEN 'never run' WHEN last_status = 'success' THEN 'ok' WHEN last_status = 'failed' THEN 'failed' ELSE last_status END AS health FROM registry r LEFT JOIN last USING (portal)")
def portal_health(spark, d):
    return _summary(spark, d).select("portal", reports.portal_health(~F.col("portal").like("%_1%"), F.lit(False), F.col("last_status")).alias("health"))


@query(R_SQL + "SELECT portal, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY portal ORDER BY started DESC, run_id DESC) <= 10")
def recent_runs(spark, d):
    return reports.recent_runs(views.runs(spark, d)).select("portal", "run_id", "status")


@query(R_SQL + "SELECT run_id, portal, status FROM runs WHERE portal = 'click' AND status = 'failed' ORDER BY started DESC, run_id DESC LIMIT 50")
def run_filter(spark, d):
    return reports.run_report(views.runs(spark, d), "click", "failed", 50).select("run_id", "portal", "status")


@query(R_SQL + "SELECT portal, status, count(*) AS n FROM runs GROUP BY ALL")
def run_status_counts(spark, d):
    return reports.run_status_counts(views.runs(spark, d))


@query(R_SQL + f"SELECT run_id, greatest(0, CAST(floor((epoch_us(coalesce(finished, TIMESTAMP '{RUN_AS_OF}')) - epoch_us(started)) / 1000000) AS BIGINT)) AS seconds FROM runs")
def run_durations(spark, d):
    return views.runs(spark, d).select("run_id", reports.run_duration(F.col("started"), F.col("finished"), as_of(RUN_AS_OF)).alias("seconds"))


@query(R_SQL + f"SELECT run_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, {STAMP.format(f'''coalesce(finished, TIMESTAMP '{RUN_AS_OF}')''')} AS finished, CASE WHEN status = 'running' THEN 'interrupted' END AS message FROM runs")
def orphan_runs(spark, d):
    return lifecycle.close_orphan_runs(views.runs(spark, d), as_of(RUN_AS_OF)).select("run_id", "status", stamp("finished").alias("finished"), "message")


@query("""SELECT c_custkey AS user_id, coalesce(s.n, 0) AS n_sessions, coalesce(a.n, 0) AS n_alerts, CASE WHEN c_nationkey % 3 > 0 THEN c_acctbal > 0 END AS active, CASE WHEN c_nationkey % 3 > 0 THEN c_mktsegment || ';' || c_nationkey END AS keywords FROM customer
    LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) s ON s.user_id = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) a ON a.o_custkey = c_custkey""")
def user_report(spark, d):
    """Users with their subscription; some have none."""
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "user_id")
    subscriptions = customers.where("c_nationkey % 3 > 0").select("user_id", (F.col("c_acctbal") > 0).alias("active"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("keywords"))
    found = reports.user_report(customers.select("user_id"), table(spark, d, "events"), table(spark, d, "orders").withColumnRenamed("o_custkey", "user_id"), subscriptions)
    return found.select("user_id", "n_sessions", "n_alerts", "active", F.array_join("keywords", ";").alias("keywords"))


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type <> 'error' AND CAST(ts AS TIMESTAMP) + INTERVAL 14 DAYS > TIMESTAMP '2024-01-30'")
def session_report(spark, d):
    sessions = table(spark, d, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("active"), (F.col("ts").cast("timestamp") + F.expr("interval 14 days")).alias("expires"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return reports.live_sessions(sessions, users, as_of("2024-01-30")).select("event_id", "c_name")


@query(O_SQL + f"""SELECT notice_id, CASE WHEN closing < TIMESTAMP '{AS_OF}' THEN 'closed' WHEN closing <= TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY THEN 'urgent' WHEN closing <= TIMESTAMP '{AS_OF}' + INTERVAL 3 DAYS THEN 'soon' ELSE 'normal' END AS urgency FROM orders_n""")
def closing_urgency(spark, d):
    return views.orders(spark, d).select("notice_id", reports.closing_urgency(F.col("closing"), as_of()).alias("urgency"))


@query("""SELECT CAST(sum(n) AS BIGINT) AS stated_total, count(DISTINCT day) AS n_distinct FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)""")
def calendar_totals(spark, d):
    listed = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return reports.stated_sum(listed, "day", "n")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, d):
    return store.union_sources([table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES])


# Backfills and totals


@query(f"WITH {LABELLED_SQL} SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE {LABEL_SQL} END AS relevance FROM labelled")
def relevance_backfill(spark, d):
    old = _labelled(spark, d).withColumn("relevance", F.when(F.col("p_partkey") % 3 == 0, "kept"))
    return lifecycle.backfill_relevance(old).select("p_partkey", "relevance")


@query(f"""WITH {LABELLED_SQL} SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept' WHEN regexp_matches(concat_ws(' ', title, category), '(?i)({text.LEGACY_COMPONENTS})') THEN 'irrelevant' WHEN regexp_matches(concat_ws(' ', organisation, department), '(?i)({text.LEGACY_DEFENCE})') THEN 'relevant'
    WHEN regexp_matches(concat_ws(' ', organisation, department), '(?i)({text.CIVIL_WORDS})') THEN 'irrelevant' ELSE 'unclassified' END AS relevance FROM labelled""")
def legacy_relevance_backfill(spark, d):
    old = _labelled(spark, d).withColumn("relevance", F.when(F.col("p_partkey") % 3 == 0, "kept"))
    return lifecycle.backfill_relevance(old, legacy=True).select("p_partkey", "relevance")


@query(R_SQL + """, s AS (SELECT portal, arg_max(stated_total, (started, run_id)) FILTER (stated_total IS NOT NULL) AS stated_total FROM runs GROUP BY ALL HAVING count(stated_total) > 0)
    SELECT CAST(coalesce(sum(stated_total), 0) AS BIGINT) AS total_reported, count(*) AS portals_reporting, CAST(coalesce(sum(stated_total) FILTER (portal = 'click'), 0) AS BIGINT) AS named_total FROM s""")
def stated_summary(spark, d):
    return reports.stated_summary(reports.stated_totals(views.runs(spark, d)), "click")


@query(R_SQL + f""", m AS (SELECT run_id, CAST(floor((epoch_us(TIMESTAMP '{RUN_AS_OF}') - epoch_us(started)) / 60000000) AS BIGINT) AS n FROM runs)
    SELECT run_id, CASE WHEN n < 1 THEN 'just now' WHEN n < 60 THEN n || 'm ago' WHEN n < 1440 THEN (n // 60) || 'h ago' ELSE (n // 1440) || 'd ago' END AS age FROM m""")
def run_ages(spark, d):
    return views.runs(spark, d).select("run_id", reports.age(F.col("started"), as_of(RUN_AS_OF)).alias("age"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment || ';' || c_name END AS keywords FROM customer""")
def keyword_lists(spark, d):
    listed = F.array(F.concat(F.lit(" "), "c_mktsegment"), F.concat("c_name", F.lit(" ")), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.slice(text.keyword_list(listed), 1, 2), ";").alias("keywords"))


# Alerts

WIDE = "\uff12"  # a full-width digit that compatibility normalisation makes a 2
NAMED_SQL = f"""named AS (SELECT p_brand AS portal, 'P/' || p_partkey AS notice_id, p_name AS title, p_partkey AS published, CASE p_partkey % 4 WHEN 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY WHEN 1 THEN NULL ELSE TIMESTAMP '{AS_OF}' + to_days(CAST(p_partkey % 50 AS INTEGER)) END AS closing FROM part),
subs AS (SELECT c_custkey AS user_id, [['red', 'blue', 'Widget', 'bolt', 'ring'][CAST(c_nationkey % 5 + 1 AS INTEGER)], ['small ring', 'gear', 'plate', 'green'][CAST(c_nationkey % 4 + 1 AS INTEGER)], ['p/1', 'P/{WIDE}', 'P/3', 'P/40', 'P/77'][CAST(c_nationkey % 5 + 1 AS INTEGER)]] AS keywords, c_acctbal > 0 AS active FROM customer)"""


def _subscriptions(spark, d):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("c_nationkey") % len(words) + 1).cast("int"))
    c = table(spark, d, "customer")
    keywords = F.array(pick(["red", "blue", "Widget", "bolt", "ring"]), pick(["small ring", "gear", "plate", "green"]), pick(["p/1", f"P/{WIDE}", "P/3", "P/40", "P/77"]))
    return c.select(F.col("c_custkey").alias("user_id"), keywords.alias("keywords"), (F.col("c_acctbal") > 0).alias("active"), F.lit(None).cast("string").alias("delivery_email"))


def _named(spark, d):
    """Part names as notices, some closed and some undated, with their index."""
    p = table(spark, d, "part")
    closing = F.when(F.col("p_partkey") % 4 == 0, as_of() - F.expr("interval 1 day")).when(F.col("p_partkey") % 4 > 1, as_of() + F.make_dt_interval((F.col("p_partkey") % 50).cast("int")))
    rows = p.select(F.col("p_brand").alias("portal"), F.concat(F.lit("P/"), "p_partkey").alias("notice_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("published"), closing.alias("closing"), F.concat(F.lit("https://example.org/"), F.col("p_partkey")).alias("url"))
    return views.indexed(spark, d, "named", rows)


@query(f"WITH {NAMED_SQL} SELECT DISTINCT user_id, unnest(keywords) AS keyword FROM subs WHERE active")
def live_subscriptions(spark, d):
    return alerts.keyword_rows(_subscriptions(spark, d))


MATCH_SQL = f"""WITH {NAMED_SQL}, kw AS (SELECT keyword, replace(lower(keyword), '{WIDE}', '2') AS q FROM (SELECT DISTINCT unnest(keywords) AS keyword FROM subs WHERE active)),
live AS (SELECT * FROM named WHERE closing IS NULL OR closing >= TIMESTAMP '{AS_OF}'),
refs AS (SELECT keyword, portal, notice_id, CASE WHEN lower(notice_id) = q THEN 18000.0 ELSE 8000.0 END AS score, published FROM kw JOIN live ON contains(lower(notice_id), q) WHERE contains(q, '/')),
plain AS (SELECT * FROM kw WHERE keyword NOT IN (SELECT keyword FROM refs)),
terms AS (SELECT keyword, unnest(string_split(q, ' ')) AS token FROM plain), need AS (SELECT keyword, count(*) AS need FROM terms GROUP BY ALL),
words AS (SELECT portal, notice_id, unnest(string_split(title, ' ')) AS token FROM live), tf AS (SELECT portal, notice_id, token, count(*) AS tf FROM words GROUP BY ALL),
hits AS (SELECT keyword, portal, notice_id, count(*) AS n, sum(CAST(tf AS DOUBLE) / (tf + 1)) AS rank FROM tf JOIN terms USING (token) GROUP BY ALL),
scored AS (SELECT keyword, h.portal, h.notice_id, (CASE WHEN lower(title) = q THEN 500 ELSE 0 END) + round(100 * rank / need, 6) AS score, published FROM hits h JOIN need USING (keyword) JOIN kw USING (keyword) JOIN live m ON m.portal = h.portal AND m.notice_id = h.notice_id WHERE n = need),
grams AS (SELECT DISTINCT title, {GRAMS_SQL.format(WORDS_SQL.format('title'))} AS g FROM live),
fuzzy AS (SELECT keyword, title, len(list_intersect(a.g, b.g)) AS c, len(a.g) AS x, len(b.g) AS y FROM grams a, (SELECT keyword, {GRAMS_SQL.format(WORDS_SQL.format('q'))} AS g FROM plain WHERE keyword NOT IN (SELECT keyword FROM scored)) b),
every AS (SELECT * FROM refs UNION ALL SELECT keyword, portal, notice_id, score, published FROM scored UNION ALL SELECT keyword, portal, notice_id, round(10 * c / (x + y - c), 6), published FROM fuzzy JOIN live USING (title) WHERE c / (x + y - c) > 0.2),
matches AS (SELECT keyword, portal, notice_id FROM every QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY score DESC, published DESC NULLS LAST, portal, notice_id) <= 20),
users AS (SELECT DISTINCT user_id, portal, notice_id FROM (SELECT user_id, unnest(keywords) AS keyword FROM subs WHERE active) JOIN matches USING (keyword)),
sent AS (SELECT o_custkey AS user_id, p_brand AS portal, 'P/' || p_partkey AS notice_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
"""


@query(MATCH_SQL + "SELECT * FROM matches")
def alert_matches(spark, d):
    notices, index = _named(spark, d)
    return alerts.keyword_matches(notices, alerts.keyword_rows(_subscriptions(spark, d)), as_of(), index=index).select("keyword", "portal", "notice_id")


def _fresh(spark, d):
    subs, (named, index) = _subscriptions(spark, d), _named(spark, d)
    sent = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sent = sent.select(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("portal"), F.concat(F.lit("P/"), "p_partkey").alias("notice_id"))
    return alerts.unsent(alerts.user_matches(subs, alerts.keyword_matches(named, alerts.keyword_rows(subs), as_of(), index=index)), sent)


@query(MATCH_SQL + "SELECT user_id, portal, notice_id FROM users WHERE (user_id, portal, notice_id) NOT IN (SELECT user_id, portal, notice_id FROM sent)")
def alert_unsent(spark, d):
    return _fresh(spark, d)


@query(MATCH_SQL + "SELECT count(DISTINCT user_id) AS users_notified, count(*) AS notices_sent FROM users WHERE (user_id, portal, notice_id) NOT IN (SELECT user_id, portal, notice_id FROM sent)")
def alert_totals(spark, d):
    return alerts.cycle_totals(_fresh(spark, d))


@query(MATCH_SQL + """, fresh AS (SELECT * FROM users WHERE (user_id, portal, notice_id) NOT IN (SELECT user_id, portal, notice_id FROM sent))
    SELECT user_id, CAST(count(*) AS INTEGER) AS n_notices, count(*) || ' new notice' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' matching your alerts' AS subject,
      string_agg('- [' || portal || '] ' || title || ' (closes ' || coalesce(strftime(closing, '%Y-%m-%d'), 'unknown') || ') - https://example.org/' || substring(notice_id, 3), chr(10) ORDER BY portal, notice_id) AS body, c_name AS address
    FROM fresh JOIN named USING (portal, notice_id) JOIN customer ON c_custkey = user_id GROUP BY user_id, c_name""")
def alert_digest(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"), F.lit(None).cast("string").alias("delivery_email"))
    return alerts.digests(_fresh(spark, d), users, _named(spark, d)[0]).select("user_id", "n_notices", "subject", "body", "address")


@query(f"""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, event_id) <= 100""")
def alert_history(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("event_type").alias("portal"), F.col("event_id").alias("notice_id"), F.col("ts").alias("sent_at"))
    return alerts.alert_history(log).select("user_id", F.col("notice_id").alias("event_id"))


# Pages and raw feeds


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) AS href FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href ELSE NULL END AS url FROM a""")
def page_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("base"), F.explode(html.links(F.col("html"))).alias("a"))
    return rows.select("page_id", text.absolute_url(F.col("base"), F.col("a.href")).alias("url"))


@query(r"""SELECT page_id, CASE WHEN contains(lower(html), 'captcha') THEN 'captcha' WHEN contains(lower(html), 'please login') OR contains(lower(html), 'session expired') THEN 'login-required' ELSE 'ok' END AS gate,
    length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) < 1000 AS shell FROM pages""")
def page_gate(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_gate(F.col("html")).alias("gate"), text.is_script_shell(F.col("html"), 1000).alias("shell"))


@query("SELECT min(page_id) AS page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages GROUP BY ALL")
def first_seen_dedupe(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    return json_feeds.first_per_key(rows, ["host"], "page_id")


@query("""SELECT event_id AS notice_id, event_type || ' ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS title, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    return rows.select(F.col("event_id").alias("notice_id"), F.concat_ws(" ", "event_type", F.col("p.k")).alias("title"), F.col("p.k").alias("k"))


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS heading FROM conversations""")
def heading_fill(spark, d):
    rows = table(spark, d, "conversations").withColumn("mark", F.when(F.col("role") == "user", F.col("turn")))
    return html_feeds.forward_fill(rows, ["conv_id"], "turn", "mark", "heading").select("conv_id", "turn", F.coalesce("heading", F.lit(-1)).alias("heading"))


FORMATS = {"dash_seconds": ("dd-MM-yyyy HH:mm:ss", "%d-%m-%Y %H:%M:%S"), "dash_minutes": ("dd-MM-yyyy HH:mm", "%d-%m-%Y %H:%M"), "dash_half_day": ("dd-MM-yyyy hh:mm a", "%d-%m-%Y %I:%M %p"), "slash_half_day": ("dd/MM/yyyy hh:mm a", "%d/%m/%Y %I:%M %p"), "slash_minutes": ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"), "month_name": ("dd-MMM-yyyy hh:mm a", "%d-%b-%Y %I:%M %p"), "iso": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S")}


@query("SELECT o_orderkey, " + ", ".join(f"{STAMP.format('o_orderdate')} AS {n}" for n in FORMATS) + f", {STAMP.format('o_orderdate')} AS epoch FROM orders")
def date_formats(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    parsed = [stamp(getattr(dates, n)(F.date_format("t", p))).alias(n) for n, (p, _) in FORMATS.items()]
    return o.select("o_orderkey", *parsed, stamp(dates.epoch_millis(F.unix_millis("t"))).alias("epoch"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE lower(replace(c_name, '#', '.')) || '@example.org;info@example.org' END AS addresses FROM customer""")
def recipient_lists(spark, d):
    name = F.replace("c_name", F.lit("#"), F.lit("."))
    listed = F.concat(name, F.lit("@Example.org; INFO@example.org\n,"), name, F.lit("@example.org"), F.when(F.col("c_acctbal") < 0, ", not an address").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.recipients(listed), ";").alias("addresses"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("SELECT o_orderkey, o_orderstatus AS organisation, o_orderpriority AS department, split_part(o_orderpriority, '-', 1) AS number, split_part(o_orderpriority, '-', 2) AS label FROM orders")
def chain_split(spark, d):
    one = text.organisation_of(text.chain_parts(F.concat_ws(" || ", "o_orderstatus", "o_orderpriority")))
    two = text.organisation_of(text.chain_parts(F.col("o_orderpriority"), "-"), True)
    return table(spark, d, "orders").select("o_orderkey", one["organisation"].alias("organisation"), one["department"].alias("department"), two["organisation"].alias("number"), two["department"].alias("label"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS notice_id, o_orderpriority AS reference, 'T/' || o_orderkey AS labelled FROM orders")
def bracket_ids(spark, d):
    o = table(spark, d, "orders").withColumn("cell", F.format_string("[work] [%s] [ %s ]", F.col("o_orderpriority"), F.col("o_orderkey").cast("string")))
    marks = text.bracket_values(F.col("cell"))
    return o.select("o_orderkey", F.try_element_at(marks, F.lit(-1)).alias("notice_id"), F.try_element_at(marks, F.lit(-2)).alias("reference"), text.reference_id(F.concat(F.lit(" Tender No: T/"), F.col("o_orderkey"))).alias("labelled"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN o_orderkey ELSE -1 END AS total FROM orders")
def stated_total_text(spark, d):
    shown = F.concat(F.lit("Showing 1 to 10 of "), F.format_number("o_orderkey", 0), F.lit(" entries"))
    found = text.stated_total(F.when(F.col("o_orderstatus") == "F", shown).otherwise(F.concat(F.format_number("o_orderkey", 0), F.lit(" records found"))))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(found, F.lit(-1)).alias("total"))


@query(O_SQL + f"SELECT portal, notice_id, title, {STAMP.format('closing')} AS closing, {views.HASH_SQL} AS content_hash FROM orders_n")
def normalised_records(spark, d):
    rows = json_feeds.notices(views.orders(spark, d), **{c: F.col(c) for c in ("portal", "notice_id", "title", "organisation", "department", "category", "value", "closing", "status")})
    return lifecycle.with_hash(rows, views.HASHED).select("portal", "notice_id", "title", stamp("closing").alias("closing"), "content_hash")


STORED_SQL = f"labelled AS (SELECT *, {LABEL_SQL} AS relevance FROM (SELECT 'p' || p_size AS portal, CAST(p_partkey AS VARCHAR) AS notice_id, p_type AS title, p_name AS category, p_brand AS organisation, CASE WHEN p_size < 10 THEN 'Air  Force' WHEN p_size > 40 THEN 'City Hospital' ELSE p_name END AS department FROM part))"


@query(f"WITH {STORED_SQL} SELECT portal, notice_id, relevance, sha256('category=' || category || '|organisation=' || organisation || '|relevance=' || relevance || '|title=' || title) AS content_hash FROM labelled")
def stored_records(spark, d):
    """Records as a merge gets them: the label is there before the hash, which takes it in."""
    department = F.when(F.col("p_size") < 10, "Air  Force").when(F.col("p_size") > 40, "City Hospital").otherwise(F.col("p_name"))
    columns = {"portal": F.concat(F.lit("p"), "p_size"), "notice_id": F.col("p_partkey").cast("string"), "title": F.col("p_type"), "category": F.col("p_name"), "organisation": F.col("p_brand"), "department": department}
    rows = json_feeds.normalised(json_feeds.notices(table(spark, d, "part"), **columns), ["title", "category", "organisation", "relevance"])
    return rows.select("portal", "notice_id", "relevance", "content_hash")


@query("SELECT n_nationkey, n_name AS short, 'GeM' AS fixed FROM nation")
def short_names(spark, d):
    name = F.concat(F.col("n_name"), F.lit(" e-Procurement System (beta)"))
    return table(spark, d, "nation").select("n_nationkey", text.short_name(F.col("n_name"), name).alias("short"), text.short_name(F.lit("gem"), name).alias("fixed"))


@query("SELECT o_orderkey, o_orderpriority AS title, o_orderstatus AS department FROM orders")
def division_split(spark, d):
    work = text.division_split(F.concat("o_orderpriority", F.lit("  in  Division No: "), "o_orderstatus", F.lit(".")))
    return table(spark, d, "orders").select("o_orderkey", work["title"].alias("title"), work["department"].alias("department"))


@query("""SELECT event_id, 'https://example.org/' || CASE WHEN user_id % 7 = 5 THEN 'showdirectradocumentPdf' WHEN user_id % 7 = 2 THEN CASE WHEN value > 40 THEN 'list-ra-schedules' ELSE 'showradocumentPdf' END ELSE 'showbidDocument' END || '/' || event_id AS url FROM events""")
def rule_links(spark, d):
    link = text.document_link("https://example.org", F.col("event_id"), F.col("user_id") % 7, (F.col("value") > 40).cast("int"))
    return table(spark, d, "events").select("event_id", link.alias("url"))


@query(N_SQL + "SELECT notice_id FROM documents_n WHERE contains(lower(description), 'idiot') OR contains(lower(description), 'the and')")
def phrase_any(spark, d):
    return views.documents(spark, d).where(search.any_phrase(F.col("description"), ["Idiot", "THE AND"])).select("notice_id")


@query("SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def first_n_sources(spark, d):
    return store.first_sources(table(spark, d, "nation"), [F.col("n_nationkey")], 5).select("n_name")


@query(O_SQL + f", {DOCUMENTS_SQL} SELECT portal, notice_id, title, status FROM orders_n UNION ALL SELECT portal, notice_id, title, NULL FROM documents_n")
def union_feed(spark, d):
    return store.union_sources([views.orders(spark, d).select("portal", "notice_id", "title", "status"), views.documents(spark, d).select("portal", "notice_id", "title")])


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY ALL")
def distinct_lists(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def scan_filtered(spark, d):
    return store.scan(spark, f"{d}/lineitem.parquet", (F.col("l_quantity") > 45) & (F.col("l_discount") < 0.02), ["l_orderkey", "l_extendedprice"])


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def registry_lookup(spark, d):
    registry = store.enabled_portals(table(spark, d, "nation").withColumn("enabled", F.col("n_regionkey") != 2))
    return table(spark, d, "customer").join(registry, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def multi_source_scan(spark, d):
    return store.union_sources([table(spark, d, t).select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation")) for t, p in (("customer", "c"), ("supplier", "s"))])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges a batch into the store and searches the result for the categories' words."""
    new, _ = lifecycle.merge_snapshot(views.batch(spark, sf_dir), views.stored_notices(spark, sf_dir), views.tombstones(spark, sf_dir), as_of(), "run-1")
    notices = new.withColumn("published", F.col("closing"))
    asked = notices.select(F.lower("category").alias("q")).distinct().withColumn("query_id", F.col("q"))
    return search.ranked_page(search.fulltext_search(notices, asked), 1, 20)


from . import feeds  # noqa: E402, F401 (its queries register themselves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
