"""The fold search prepares a fold once and gives what whole pipelines give."""

import datetime as dt

import pytest

from tallyloom.operators import form, models


def test_a_fold_is_prepared_once_and_fitted_as_by_whole_pipelines(spark, monkeypatch):
    days = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=k // 3), float(k * k % 3), float(k * 7 % 11), float(k % 5) if k % 4 else None) for k in range(47)]
    rows = spark.createDataFrame(days, "match_id long, date date, label double, x double, y double")
    calls, prepared = [], models.prepared
    monkeypatch.setattr(models, "prepared", lambda *a, **k: calls.append(a) or prepared(*a, **k))
    got = {(r["penalty"], r["fold"]): r["logloss"] for r in models.tuned(rows, ["x", "y"], [0.001, 0.1], k=2).collect()}
    assert len(calls) == 2 and len(got) == 4
    folds = form.expanding_folds(rows.select("match_id", "date"), 2).join(rows, "match_id")
    train, test = (folds.where(f"fold = 1 and role = '{r}'") for r in ("train", "test"))
    want = models.evaluated(models.three(models.logistic(["x", "y"], penalty=0.1).fit(train).transform(test)), "").first()["logloss"]
    assert got[0.1, 1] == pytest.approx(want, abs=1e-9)
