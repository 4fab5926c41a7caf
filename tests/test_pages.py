"""Pages of a stored order against slices of a sorted list."""

import random

import pytest

from tidemark.operators import pages, search

SCHEMA = "portal string, notice_id string, published int, more string"


def by_hand(rows):
    return sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0], r[1]))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(rng.choice("pqr"), f"N{i}", rng.choice([None, 1, 2, 7, 7, 7]), f"m{i}") for i in range(700)]
    n = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, n, pages.store_order(n, str(tmp_path_factory.mktemp("o") / "order"), each=50)


def test_pages_of_all_depths(made):
    rows, n, stored = made
    expected = by_hand(rows)
    assert stored.total == 700 and len(stored.starts) > 8
    for page, limit in [(1, 20), (2, 20), (18, 20), (35, 20), (36, 20), (10_000, 20), (0, 20), (4, 100), (7, 500), (233, 3), (234, 3)]:
        got = [tuple(r) for r in stored.page(page, limit).collect()]
        at, size = search.clamp_page(page, limit)
        assert got == [(*r, 700, -(-700 // size)) for r in expected[(at - 1) * size : at * size]], (page, limit)
    assert stored.page(2).select(n.columns).collect() == search.browse(n, 2).select(n.columns).orderBy(*pages.order()).collect()


def test_only_the_page_s_ranges_are_read(made):
    _, _, stored = made
    for page in (1, 17, 35):
        files = stored.page(page).inputFiles()
        plan = stored.page(page)._jdf.queryExecution().executedPlan().toString()
        assert files and "PartitionFilters: [" in plan and pages.RANGE in plan.split("PartitionFilters: [")[1].split("]")[0]
        at = (page - 1) * 20
        wanted = [r for r in range(len(stored.starts) - 1) if stored.starts[r] < at + 20 and stored.starts[r + 1] > at]
        assert 1 <= len(wanted) <= 4
        assert max(stored.starts[r + 1] - stored.starts[r] for r in wanted) < 200


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [("p", "a", 3, "x")] * 30 + [("p", "b", None, None), ("p", None, 3, "y")]
    stored = pages.store_order(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "r"), each=8)
    assert [r.notice_id for p in (1, 2, 3, 4) for r in stored.page(p, 10).collect()] == [None] + ["a"] * 30 + ["b"]
    none = pages.store_order(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert none.total == 0 and none.page(1).collect() == [] == none.page(9).collect()
