"""Recall of the multiprobe search where a fixed number of visits falls short."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


@pytest.mark.parametrize("width", [0.8, 0.01])
def test_visits_follow_the_measured_recall(spark, width):
    v = np.random.default_rng(8).standard_normal((4000, 64)).astype("f4")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("id") % 50 == 0, rows_per_bucket=4, width=width).toPandas()
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = n[q] @ n.T
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.9 * 400
    assert ann.nearest(df, F.lit(False)).count() == 0
    assert ann.nearest(df.where("vec_id = 50"), F.col("id") == 50).count() == 0
