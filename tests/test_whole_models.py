"""Models without SQL twins work on every division."""

from tallyloom.operators import models as operators
from tallyloom.plans import models
from tallyloom.sources.matches import matches

DATA = "/root/testdata/sf0.001"


def test_every_division_is_scored(spark):
    _, test = operators.split(models.frame(spark, DATA))
    want = {r[0] for r in test.select("match_id").collect()}
    got = models.batch_scoring(spark, DATA).select("match_id")
    assert {r[0] for r in got.collect()} == want
    assert got.join(matches(spark, DATA), "match_id").select("div").distinct().count() == test.select("div").distinct().count() > 4
    assert models.track_record(spark, DATA).first()["n"] == len(want)


def test_four_folds(spark):
    rows = models.time_fold_search(spark, DATA).collect()
    assert len(rows) == 2 and all(r["folds"] == 4 for r in rows)
