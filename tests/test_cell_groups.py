"""A query goes once to each group of cells, and not once to each cell or ring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import nearest


def vectors(spark, matrix, name="id"):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<float>")


@pytest.fixture
def meetings(monkeypatch):
    """Rows that queries were sent out as, in each meeting."""
    sent, meet = [], nearest._meet

    def counted(asked, *others, **more):
        sent.append(asked.count())
        return meet(asked, *others, **more)

    monkeypatch.setattr(nearest, "_meet", counted)
    return sent


@pytest.mark.parametrize("form", ["cells", "pruned"])
def test_queries_are_sent_by_group(spark, meetings, form):
    draw = np.random.default_rng(9)
    index = draw.normal(size=(600, 6)).astype(np.float32)
    queries = draw.normal(size=(100, 6)).astype(np.float32)
    given = vectors(spark, queries, "query_id"), vectors(spark, index)
    found = nearest.nearest_cells(*given, 4, cells=60) if form == "cells" else nearest.nearest_pruned(*given, 4, cells=60).hits
    distance = ((queries[:, None, :].astype(np.float64) - index[None, :, :]) ** 2).sum(axis=2)
    expected = {(q, i) for q in range(100) for i in np.lexsort((np.arange(600), distance[q]))[:4].tolist()}
    assert {(r.query_id, r.id) for r in found.collect()} == expected
    # 600 rows are in a few groups; most of 60 cells, and of 240 rings, are met.
    assert max(meetings) <= 8 * 100


def test_shares_name_whole_groups_by_null(spark):
    groups = nearest._Groups(spark, {0: 5, 2: 4, 5: 3}, np.array([[0.0], [1.0], [9.0]]), 1)
    groups.of, groups.sizes = np.array([0, -1, 0, -1, -1, 1]), np.array([2, 1])
    df = spark.createDataFrame([(1, [2, 0]), (2, [5, 2, 1]), (3, []), (4, [7])], "id int, cells array<int>")
    rows = df.select("id", F.explode(groups.shares()("cells")).alias("s")).collect()
    assert {(r.id, r.s["_group"], None if r.s["_cells"] is None else tuple(r.s["_cells"])) for r in rows} == {
        (1, 0, None), (2, 0, (2,)), (2, 1, None),
    }
