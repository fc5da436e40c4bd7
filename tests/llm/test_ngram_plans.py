"""Bit sketches are merged with the rows that need them: broadcast, they would grow in the driver with the documents."""

from tallyloom.llm import ngram_join
from tallyloom.llm.common import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_are_never_broadcast(spark):
    nodes = cut(spark.createDataFrame([(k, 4, bytearray(8)) for k in range(3)], "node long, n long, sketch binary"))
    rows = cut(spark.createDataFrame([(7, k) for k in range(3)], "key long, node long"))
    pairs = cut(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    near = ngram_join._within(pairs, nodes, 75)
    assert "Broadcast" not in plan(near) and {tuple(r) for r in near.collect()} == {(0, 1), (1, 2)}
    some, every = (ngram_join._sketched(rows, nodes, everything) for everything in (False, True))
    assert "Broadcast" not in plan(some) + plan(every)
    assert some.count() == 3 and [r["keys"] for r in every.collect()] == [[7]] * 3
