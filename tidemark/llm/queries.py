"""Registered queries of the corpus operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod("doc_id", 4) != 2, tokenizer_file("piece_bpe_32k.model"))
    found = predict(docs.select("doc_id", "text"), model, keep_cols=["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import as_text, find_spans

    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = ("email", "ip", "card", "phone")
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(as_text(F.filter("pii", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans"))


def op5_exact_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mih import sign_codes, top_k

    found = top_k(sign_codes(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


#: Brute force over all pairs of a query and a row.
OP5_SQL = """
WITH sums AS (
  SELECT vec_id, list_transform(range(0, 64), lambda i: coalesce(list_sum(list_transform(range(i, len(embedding), 64), lambda j: embedding[j + 1]::DOUBLE)), 0)) AS s
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
), codes AS (
  SELECT vec_id,
    list_sum(list_transform(range(0, 32), lambda i: CASE WHEN s[i + 1] >= 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT AS low,
    list_sum(list_transform(range(0, 32), lambda i: CASE WHEN s[i + 33] >= 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT AS high
  FROM sums
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, (bit_count(xor(q.low, c.low)) + bit_count(xor(q.high, c.high)))::INTEGER AS distance
  FROM codes q JOIN codes c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance
FROM pairs QUALIFY rank <= 10
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096, kind="word")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_corpus, write_corpus

    manifest = write_corpus(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, kind="byte")
    return read_corpus(manifest, with_ids=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    # [1, 2, 3] without brackets and commas: no object for each id.
    ids_text = F.btrim(F.replace(F.col("ids").cast("string"), F.lit(","), F.lit("")), F.lit("[]"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    found = score(docs.select("doc_id", "text"), model, keep_cols=["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def op10_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Each document's failures as five letters, counted by part; 120 orders meet these counts.
OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
      || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
      || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), profiles AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substring(filter_order, step, 1) AS f, substring(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
acted AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS only_this,
    before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM profiles, steps
), done AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (only_this), 0) AS unique_fails,
    coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
  FROM acted GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM done
"""


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, least=(80, 100))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_language_id, op3_html_extraction, op4_pii, op5_exact_hamming_topk, op6_best_fit_packing, op7_token_files, op8_byte_bpe, op9_toxicity, op10_multiprobe_ann, op11_filter_audit, op12_minhash_near_dedup, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_hamming_topk": OP5_SQL, "op11_filter_audit": OP11_SQL}
