"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so that Euclidean nearness, which Gaussian (2-stable)
projections keep, orders like the cosine. Each of ``tables`` hash tables concatenates
``projections`` values ``floor((a.v + b) / width)``. A query visits, besides its own
bucket, the perturbed buckets in the order of their estimated success: the
sum of squared distances of its projections to the crossed bucket borders (Lv et al. 2007).
Candidates of all tables are merged and ranked by the exact cosine of the
original vectors.

Equal vectors are one index row that stands for its ids, of which a search can never
need more than k + 1. The number of projections of a table grows with the logarithm of
the number of vectors, so that buckets keep their size. How many buckets that takes is
measured: a sample of queries is answered by brute force, and the visits double until the tables
find the wanted share of those answers; where that takes too many, buckets get wider.
A bucket is ranked against the queries that visit it as one matrix product, in blocks of a
bounded number of vectors and of queries, and only k + 1 rows of each query leave a block:
candidate pairs never become rows, and a bucket that holds a third of all vectors is
spread over as many tasks as it needs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SEED = 20_240_501
#: The most vectors, and visiting queries, that one task compares at once.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 8192
#: The recall that a sample of so many queries has to reach, and the most visits a table before it loses a projection.
RECALL, SAMPLE, MOST_VISITS = 0.95, 100, 2048


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; components that are not floats become doubles.

    Rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite
    components take no part.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.col("id").isNotNull() & good & F.exists("vec", lambda x: x != 0.0))


class Hasher:
    """The projections of all tables, drawn from a fixed seed; cheap to draw again in each task."""

    def __init__(self, dims: int, tables: int, projections: int, width: float):
        rng = np.random.default_rng(SEED)
        self.tables, self.projections = tables, projections
        self.width = width
        self.a = rng.standard_normal((tables * projections, dims))
        self.b = rng.uniform(0.0, 1.0, tables * projections)
        self.mix = rng.integers(1, 1 << 62, tables * projections, dtype=np.int64) | 1

    def places(self, rows: np.ndarray) -> np.ndarray:
        """(n, tables, projections) positions in units of the bucket width."""
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        return ((unit @ self.a.T) / self.width + self.b).reshape(len(rows), self.tables, self.projections)

    def keys(self, buckets: np.ndarray) -> np.ndarray:
        """(n, tables) one 64-bit number for each bucket; tables never share their multipliers."""
        with np.errstate(over="ignore"):
            return (buckets.astype(np.int64) * self.mix.reshape(self.tables, self.projections)).sum(axis=2)

    def probes(self, place: np.ndarray, count: int) -> np.ndarray:
        """(tables, count, projections) buckets of one query, its own first, then by estimated success."""
        base = np.floor(place)
        count = min(count, 3**self.projections)  # each projection stays or crosses one of its two borders
        out = np.repeat(base[:, None, :], count, axis=1)
        for t in range(self.tables):
            x = place[t] - base[t]
            if not self.projections:
                break
            moves = sorted([(float(d) ** 2, i, -1) for i, d in enumerate(x)] + [(float(1 - d) ** 2, i, 1) for i, d in enumerate(x)])
            heap, n = [(moves[0][0], (0,))], 1
            while heap and n < count:
                cost, chosen = heapq.heappop(heap)
                if len({moves[j][1] for j in chosen}) == len(chosen):  # not both ways along one projection
                    for j in chosen:
                        out[t, n, moves[j][1]] += moves[j][2]
                    n += 1
                last = chosen[-1] + 1
                if last < len(moves):
                    heapq.heappush(heap, (cost - moves[last - 1][0] + moves[last][0], (*chosen[:-1], last)))
                    heapq.heappush(heap, (cost + moves[last][0], (*chosen, last)))
        return out


def _matrix(column: pa.ChunkedArray | pa.ListArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def best_rows(q: np.ndarray, v: np.ndarray, first: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, cosine) of the ``count`` best vectors of each query, ties to the smaller ``first``."""
    nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    rough = np.round((q @ v.T) / nq[:, None] / nv, 13)
    by_id = np.argsort(first, kind="stable")
    order = by_id[np.argsort(-rough[:, by_id], axis=1, kind="stable")[:, :count]]
    rows = np.repeat(np.arange(len(q)), order.shape[1])
    cols = order.ravel()
    return rows, cols, (q[rows] * v[cols]).sum(axis=1) / (nq[rows] * nv[cols])


def settled(dims: int, tables: int, m: int, width: float, visits: int, queries: np.ndarray, answers: list[np.ndarray]) -> tuple[int, int, int]:
    """(tables, projections, visits) at which the tables find ``RECALL`` of each query's ``answers``, its nearest vectors.

    Without projections a table is one bucket of all vectors, which always does.
    """
    total = sum(map(len, answers))
    for projections in range(m, 0, -1):
        hasher = Hasher(dims, tables, projections, width)
        places, goals = hasher.places(queries), [hasher.keys(np.floor(hasher.places(a))) for a in answers]
        count, most = visits, min(MOST_VISITS, 3**projections)
        while True:
            found = 0
            for place, goal in zip(places, goals, strict=True):
                keys = hasher.keys(hasher.probes(place, count).swapaxes(0, 1))
                found += sum(any((keys[:, t] == g[t]).any() for t in range(tables)) for g in goal)
            if found >= RECALL * total:
                return tables, projections, count
            if count >= most:
                break
            count = min(2 * count, most)
    return 1, 0, 1


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = 8,
    probes: int = 6,
    rows_per_bucket: int = 40,
    width: float = 1.6,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest candidates that the tables find for each query.

    ``is_query`` is a condition on ``id``. Every row but the query's own is a candidate, so equal vectors
    find each other. Rows that repeat an id are one row if their vectors are equal, and otherwise
    all candidates; of a query's different vectors the best score of each candidate counts. Ties go to the
    smaller id. Vectors of different lengths are searched apart, each length among its own.
    No rows give no rows. ``probes`` counts the buckets visited in a table for each of its projections at
    least; ``settled`` raises them to what the measured recall needs. A query for which the tables find fewer than k rows, though
    there are more, is compared with all vectors of its length.
    """
    good = clean_vectors(vectors, id_col, vec_col)
    lengths = [r[0] for r in good.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    found = [_nearest(good.where(F.size("vec") == n), is_query, k, n, tables, probes, rows_per_bucket, width) for n in lengths]
    if not found:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best_of(reduce(DataFrame.unionAll, found), k) if len(found) > 1 else found[0]


def best_of(each: DataFrame, k: int) -> DataFrame:
    """The k best (vec_id, score) of each query, ranked."""
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(good: DataFrame, is_query: Column, k: int, dims: int, tables: int, probes: int, rows_per_bucket: int, width: float) -> DataFrame:
    """``nearest`` among vectors of one length."""
    ids = good.select("vec", "id").distinct()
    # Equal vectors become one row with their least ids: each task ranks its own before they meet.
    least = Window.partitionBy("vec").orderBy("id")
    few = ids.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    index = stored(few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-index")  # k + 1 at most
    asked = stored(ids.where(is_query).select(F.col("id").alias("query_id"), "vec"), "ann-queries")
    m = max(2, min(24, round(log(max(index.count() / rows_per_bucket, 2)) / log(4))))
    vec_type = dict(good.dtypes)["vec"]
    some = asked.orderBy(F.xxhash64("query_id"), "query_id", F.xxhash64("vec")).limit(SAMPLE).toArrow()
    sample = _matrix(some.column("vec"), dims)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows, cols, score = best_rows(sample, _matrix(part.column("vec"), dims), np.arange(part.num_rows), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(rows), part.column("vec").take(pa.array(cols)), pa.array(score)], ["row", "vec", "score"])

    visits = probes * m
    if len(sample):
        top = Window.partitionBy("row").orderBy(F.desc("score"))
        near = index.select("vec").mapInArrow(exact, f"row long, vec {vec_type}, score double")
        # The best is the query's own vector, which its own bucket always finds.
        near = near.withColumn("rank", F.row_number().over(top)).where((F.col("rank") > 1) & (F.col("rank") <= k + 1)).select("row", "vec").toArrow()
        row, vecs = near.column("row").to_numpy(), _matrix(near.column("vec"), dims)
        tables, m, visits = settled(dims, tables, m, width, visits, sample, [vecs[row == i] for i in range(len(sample))])
    found = stored(best_of(_scored(index, asked, k, dims, Hasher(dims, tables, m, width), visits), k), "ann-found")
    enough = min(k, max(ids.select("id").distinct().count() - 1, 0))
    short = asked.select("query_id").distinct().join(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough), "query_id", "left_anti")
    short = stored(short, "ann-short")
    if not enough or short.isEmpty():
        return found
    # Without projections a table is one bucket of all vectors, dealt in blocks.
    rest = best_of(_scored(index, asked.join(short, "query_id", "left_semi"), k, dims, Hasher(dims, 1, 0, width), 1), k)
    return found.join(short, "query_id", "left_anti").unionByName(rest)


def _scored(index: DataFrame, asked: DataFrame, k: int, dims: int, shape: Hasher, visits_each: int) -> DataFrame:
    """(query_id, vec_id, score) of the best vectors of each query in each block of the buckets that it visits."""
    tables, m, width, vec_type = shape.tables, shape.projections, shape.width, dict(index.dtypes)["vec"]

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dims, tables, m, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = hasher.keys(np.floor(hasher.places(_matrix(part.column("vec"), dims))))
                row = pa.array(np.repeat(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *part.take(row).columns], ["key", "vec", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dims, tables, m, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                places = hasher.places(_matrix(part.column("vec"), dims))
                found = np.array([hasher.keys(hasher.probes(p, visits_each).swapaxes(0, 1)) for p in places])
                row = pa.array(np.repeat(np.arange(part.num_rows), found[0].size))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *part.take(row).columns], ["key", "query_id", "vec"])

    buckets = index.select("vec", "ids").mapInArrow(bucket, f"key long, vec {vec_type}, ids array<long>")
    visits = asked.mapInArrow(probe, f"key long, query_id long, vec {vec_type}")
    # How many blocks the vectors and the visits of a bucket are dealt into: more than one only for crowded buckets.
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n"), F.lit(0).alias("q")).union(visits.groupBy("key").agg(F.lit(0).alias("n"), F.count("*").alias("q")))
    crowded = crowded.groupBy("key").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).where(f"n > 0 and q > 0 and (n > {BLOCK_VECTORS} or q > {BLOCK_QUERIES})")
    crowded = stored(crowded.select("key", F.expr(f"int(ceil(n / {BLOCK_VECTORS}))").alias("vs"), F.expr(f"int(ceil(q / {BLOCK_QUERIES}))").alias("qs")), "ann-crowded")
    blocks = crowded.count()

    def dealt(rows: DataFrame, own: str, other: str, by: str) -> DataFrame:
        if not blocks:
            return rows.withColumns({own: F.lit(0), other: F.lit(0)})
        both = rows.join(crowded.withColumnsRenamed({"vs": "nvs", "qs": "nqs"}), "key", "left")
        mine = F.coalesce(F.pmod(F.xxhash64(by), F.col(f"n{own}")), F.lit(0)).cast("int").alias(own)
        return both.select(*rows.columns, mine, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"n{other}"), F.lit(1)) - 1)).alias(other))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        v, lists = _matrix(right.column("vec"), dims), right.column("ids").combine_chunks()
        first = lists.flatten().to_numpy()[np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()]
        out = []
        for at in range(0, left.num_rows, 256):
            part = left.slice(at, 256)
            rows, cols, score = best_rows(_matrix(part.column("vec"), dims), v, first, k + 3)
            out.append(pa.table({"query_id": part.column("query_id").combine_chunks().take(pa.array(rows)), "ids": lists.take(pa.array(cols)), "score": pa.array(score)}))
        return pa.concat_tables(out)

    asks = dealt(visits, "qs", "vs", "query_id").groupBy("key", "vs", "qs")
    has = dealt(buckets, "vs", "qs", "ids").groupBy("key", "vs", "qs")
    scored = asks.cogroup(has).applyInArrow(rank, "query_id long, ids array<long>, score double")
    return scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
