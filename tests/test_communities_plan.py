"""Communities send no table through the driver."""

from quillspark.operators import graph as G


def test_sweeps_broadcast_nothing(spark):
    edges = spark.createDataFrame([(a, b) for k in range(0, 40, 4) for a in range(k, k + 4) for b in range(a + 1, k + 5)], "a string, b string").selectExpr("a", "b", "1L as w")
    both = edges.union(edges.select("b", "a", "w"))
    label = both.groupBy("a").agg({"w": "sum"}).selectExpr("a", "`sum(w)` as k", "a as c")
    moves = G._moves(both, label, 2 * edges.count())
    for df in (moves, G._moved(label, moves), G._apart(moves)):
        assert df.collect()
    for df in (moves, G._moved(label, moves)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
