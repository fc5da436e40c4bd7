"""An engine's frame is made from matches read once and holds what its pipeline reads."""

import pytest

from tallyloom.operators import models
from tallyloom.plans import ingest
from tallyloom.plans import models as plans


def test_an_engine_reads_its_matches_once_and_only_its_columns(spark, monkeypatch):
    class Asked(Exception):
        pass

    def frame(spark, d, m=None, cols=None):
        raise Asked(m is not None and set(cols) == {"match_id", "date", "label", *models.BASE})

    monkeypatch.setattr(plans, "frame", frame)
    with pytest.raises(Asked) as asked:
        ingest.saved_engine(spark, "/root/testdata/sf0.001")
    assert asked.value.args == (True,)
