"""Ranking pages, slates and discovery."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import readers

ROW = '<tr><td class="r">{rank}</td><td><a href="/{cc}">c</a>{link}<span class="{cls}"> {name} </span></td><td class="r">\n {elo} </td></tr>'


def pages(spark):
    rows = [ROW.format(rank=100 + k, cc="ENG", link=f'<a href="/Club{k}">', cls="Ast" if k % 2 else "min641", name=f"FC Town {k}", elo=1500 + k) for k in range(12)]
    rows += [ROW.format(rank=1, cc="FRA", link="", cls="Ast", name="Étoile-Sud SK", elo=999), "<tr><td>no rating</td></tr>", ROW.format(rank=5, cc="ENG", link="", cls="other", name="unnamed", elo=1500)]
    return spark.createDataFrame([(1, "\n".join(rows)), (2, "<html></html>"), (3, None)], "page_id int, html string")


def test_ranking_rows_and_keys(spark):
    clubs = readers.ranking_clubs(pages(spark))
    got = {r["name"]: (r["api"], r["country"], r["rating"]) for r in clubs.collect()}
    assert len(got) == 13 and got["FC Town 3"] == ("Club3", "ENG", 1503) and got["Étoile-Sud SK"] == (None, "FRA", 999)
    keys = {(r["key"], r["kind"]) for r in readers.club_keys(clubs.where("country = 'FRA'")).collect()}
    assert keys == {("etoilesudsk", "exact"), ("etoilesud", "loose"), ("etoileskssud", "loose")} or keys == {("etoilesudsk", "exact"), ("etoilesud", "loose"), ("etoilesksud", "loose")}


def test_the_gate_stops_a_parse_of_too_few_names(spark):
    clubs = readers.ranking_clubs(pages(spark))
    assert readers.enough(clubs, least=13).count() == 13
    with pytest.raises(ValueError, match="13 names"):
        readers.enough(clubs.union(clubs), least=14)
    with pytest.raises(ValueError):
        readers.enough(clubs.limit(0))


def test_discovery_counts_before_the_limit(spark):
    names = spark.createDataFrame([("Real Town", "club"), ("TOWN B", "club"), ("Townland", "international"), ("Other", "club")], "name string, kind string")
    assert [tuple(r) for r in readers.discovered(names, "tOWN", "club", 1).collect()] == [("Real Town", "club", 2)]
    assert readers.discovered(names, "town", "all", 9).count() == 3 and readers.discovered(names, "nothing").count() == 0


def test_slates_keep_unrated_matches_apart(spark, tmp_path):
    rows = [(1, "2020-01-01", 1, 2, "a", True, True), (2, "2020-01-01", 3, 4, "b", False, True), (3, "2020-01-01", 5, 6, "c", True, False), (4, "2020-01-02", 5, 6, "c", False, False)]
    m = spark.createDataFrame(rows, "match_id long, date string, home long, away long, stage string, anchored boolean, rated boolean").withColumn("date", F.to_date("date"))
    readers.sink_slate(m, str(tmp_path / "slate"))
    got = {str(r["date"]): r for r in spark.read.schema(readers.SLATE).json(str(tmp_path / "slate")).collect()}
    first = got["2020-01-01"]
    assert (first["n"], first["unrated"], first["n_anchored"], first["competitions"]) == (2, 1, 1, ["a", "b"])
    assert [x["match_id"] for x in first["matches"]] == [1, 2] and [x["match_id"] for x in first["unrated_list"]] == [3]
    assert got["2020-01-02"]["n"] == 0 and got["2020-01-02"]["matches"] == []
