"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and every distinct code is indexed under each of them.
Round r looks up, for every open query and every segment, the values that differ from the query's in
exactly r bits, and verifies what it finds by the full distance. After round r every code within distance
segments (r + 1) - 1 has been seen: a code farther than r in all of them is at least segments (r + 1) away. So a
query closes once its k-th verified distance is covered. The k-th distance so far bounds what later rounds return,
inside the join condition.

Segments are about as wide as the logarithm of the number of codes, so that a looked-up value holds few of them. Wide segments have too
many values at large radii; queries that are still open there go on with narrower ones, down to four of 16 bits, which have no limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored

#: (most distinct codes, segments, largest radius): the first level whose number is reached, and those after it.
LEVELS = ((1 << 26, 2, 5), (1 << 19, 3, 4), (0, 4, 16))


def segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``count`` segments of 64 bits, as equal as can be."""
    bounds = [64 * i // count for i in range(count + 1)]
    return [(a, z - a) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, code long): bit i is set if the sum of the components i, i + 64, i + 128, ... is zero or more (of none: zero).

    Rows with a null id, and vectors that are null, empty or hold a null or NaN take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x))")
    sums = "transform(sequence(0, 63), i -> if(i >= size(v), 0D, aggregate(sequence(i, greatest(i, size(v) - 1), 64), 0D, (a, j) -> a + v[j])))"
    return rows.select("id", F.expr(f"aggregate(transform({sums}, (x, i) -> if(x >= 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)").alias("code"))


def masks_of(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``radius`` are set."""
    if width > 22:
        return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
    every = np.arange(1 << width, dtype=np.int64)
    return every[np.bitwise_count(every) == radius]


def probes(queries: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(cell, query_id, q, bound): the values at exactly ``radius`` bits from each query's, in each segment."""
    masks = {width: masks_of(width, radius) for _, width in parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("q").to_numpy().view(np.uint64)
            for s, (low, width) in enumerate(parts):
                own = (code >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
                for first in range(0, len(masks[width]), 50_000):
                    some = masks[width][first : first + 50_000]
                    step = max(1, 50_000 // len(some))
                    for at in range(0, batch.num_rows, step):
                        part = batch.slice(at, step)
                        cell = s << 40 | own[at : at + step, None] ^ some[None, :]
                        row = pa.array(np.repeat(np.arange(part.num_rows), len(some)))
                        yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), *part.take(row).columns], ["cell", "query_id", "q", "bound"])

    return queries.select("query_id", "q", "bound").mapInArrow(run, "cell long, query_id long, q long, bound int")


def top_k(codes: DataFrame, is_query: Column, k: int = 10, levels: tuple[tuple[int, int, int], ...] = LEVELS) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest codes of every query, ties to the smaller id.

    ``codes`` has (id, code); ``is_query`` is a condition on its columns. Every row but those of the query's own id is a
    candidate; repeated rows count once, and of an id with several codes each (id, code) is a candidate with its own distance.
    Equal codes are one index row with their k + 1 least ids, since a search can need no more of them. Fewer candidates
    than k give all of them. An empty table gives no rows.
    """
    rows = codes.where("id is not null and code is not null").select("id", "code").distinct()
    least = Window.partitionBy("code").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    index = stored(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "mih-index")  # k + 1 at most
    enough = min(k, max(rows.select("id").distinct().count() - 1, 0))
    open_queries = cut(rows.where(is_query).select(F.col("id").alias("query_id"), F.col("code").alias("q"), F.lit(64).alias("bound"), F.lit(0).alias("found")))
    if enough == 0:
        return open_queries.where("false").select("query_id", F.lit(0).alias("rank"), F.col("q").alias("id"), F.lit(0).alias("distance"))
    size = index.count()
    result = best = None
    for _, count, most in [level for level in levels if size >= level[0]]:
        parts, last = segments(count), count == levels[-1][1]
        cell = [F.lit(s << 40).bitwiseOR(F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << width) - 1))) for s, (low, width) in enumerate(parts)]
        cells = stored(index.select("code", "ids", F.explode(F.array(*cell)).alias("cell")), "mih-cells")
        for radius in range(most + 1):
            asked = probes(open_queries, parts, radius)
            # The bound keeps all but promising candidates from leaving the join.
            seen = asked.join(cells, (asked["cell"] == cells["cell"]) & (F.bit_count(F.col("q").bitwiseXOR(F.col("code"))) <= F.col("bound")))
            seen = seen.select("query_id", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"), F.explode("ids").alias("id")).where("id <> query_id")
            if best is not None:
                seen = seen.union(best.select("query_id", "distance", "id"))
            order = Window.partitionBy("query_id").orderBy("distance", "id")
            best = cut(seen.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            held = best.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("found"))
            state = open_queries.select("query_id", "q").join(held, "query_id", "left")
            state = state.select("query_id", "q", F.when(F.col("found") >= k, F.col("far")).otherwise(64).cast("int").alias("bound"), F.coalesce("found", F.lit(0)).cast("int").alias("found"))
            # With fewer than k candidates in all, having found them is enough.
            done = (F.col("found") >= enough) & ((F.col("bound") <= count * (radius + 1) - 1) | (F.lit(enough) < k))
            over = last and radius == most
            closed = (state if over else state.where(done)).select("query_id").distinct()
            finished = best.join(closed, "query_id", "left_semi")
            result = finished if result is None else result.union(finished)
            open_queries = cut(state.where("false" if over else ~done))
            if open_queries.isEmpty():
                return result.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.col("distance").cast("int").alias("distance"))
            best = best.join(open_queries.select("query_id").distinct(), "query_id", "left_semi")
    raise AssertionError("the last level leaves no query open")
