"""Rounds of hubs and authorities send no table of nodes through the driver."""

import pytest
from lodestone.operators import graph
from lodestone.storage import cut


def test_rounds_broadcast_one_row_only(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 2.0), (4, 3, 1.0)], "src long, dst long, weight double")
    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    got = {r.node: (r.hub, r.authority) for r in graph.hits(cut(edges), 30, cut=watched).collect()}
    assert len(plans) == 60 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    assert sum(h for h, _ in got.values()) == pytest.approx(1) and sum(a for _, a in got.values()) == pytest.approx(1)
    assert got[3][0] == 0 and got[3][1] > got[2][1]
