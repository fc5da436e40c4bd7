"""Small exact values: of the published rules, and of cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import calendar, names, odds
from tallyloom.operators import grid, ratings, resolve


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_season_codes(spark):
    rows = spark.createDataFrame([("2026-09-13", "2627"), ("2026-06-30", "2526"), ("2026-07-01", "2627"), ("1999-08-01", "9900")], "d string, want string")
    assert all(r[0] == r[1] for r in rows.select(calendar.season_code(F.col("d").cast("date")), "want").collect())


def test_stale_weights(spark):
    got = [r[0] for r in spark.createDataFrame([(None,), (0,), (150,), (151,), (700,)], "d int").select(odds.stale_weight(F.col("d"))).collect()]
    assert got[:3] == [1.0, 1.0, 1.0] and got[3] < 1 and got[4] == pytest.approx(0.5)


def test_tiers(spark):
    cases = [(0.85, 1.0, "high"), (0.80, 1.0, "high"), (0.85, 0.95, "high"), (0.85, 0.89, "medium"), (0.85, 0.02, "medium"), (0.75, 1.0, "medium"), (0.70, 1.0, "medium"), (0.75, 0.02, "medium"), (0.65, 1.0, "low")]
    rows = spark.createDataFrame(cases, "p double, w double, want string").select(odds.tier(F.col("p"), F.col("w")), "want").collect()
    assert all(a == b for a, b in rows)


def test_folding(spark):
    cases = [("Nordsjælland", "Nordsjaelland"), ("Lillestrøm", "Lillestrom"), ("Białystok", "Bialystok"), ("Fenerbahçe", "Fenerbahce"), ("Mönchengladbach", "Monchengladbach")]
    rows = spark.createDataFrame(cases, "a string, want string").select(names.ascii_fold(F.col("a")), "want").collect()
    assert all(a == b for a, b in rows)


def test_ensemble_and_pool(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    assert list(one(spark, *odds.ensemble(lit(0.5, 0.3, 0.2), lit(0.3, 0.3, 0.4)))) == pytest.approx([0.46, 0.30, 0.24])
    market = odds.implied(*lit(2.10, 3.40, 3.60))
    assert list(one(spark, *market)) == pytest.approx([0.4543429844, 0.2806236080, 0.2650334076])
    assert list(one(spark, *odds.pooled(market, lit(0.5, 0.3, 0.2), 0.95))) == pytest.approx([0.4567910873, 0.2817270468, 0.2614818659])


def test_expected_scores_and_margins(spark):
    assert one(spark, ratings.expected_score(F.lit(0.0), 68.0))[0] == pytest.approx(0.5966291733)
    got = [one(spark, ratings.margin_multiplier(F.lit(k)))[0] for k in range(6)]
    assert got == pytest.approx([1, 1, 0.8239592165, 1.0397207708, 1.2070784343, 1.3438196019])


def test_replay_of_one_match(spark):
    m = spark.createDataFrame([(1, "2000-01-01", 1, 2, 1, 0)], "match_id long, date string, home long, away long, hg int, ag int")
    r = ratings.replay(m, 22 * ratings.margin_multiplier(F.abs(F.col("hg") - F.col("ag")))).first()
    assert (r["elo_h_post"], r["elo_a_post"]) == pytest.approx((1508.8741581873, 1491.1258418127))


def test_score_grid(spark):
    g = grid.cells(F.lit(1.4), F.lit(1.1), F.lit(-0.05))
    assert list(one(spark, *grid.outcome(g).values())) == pytest.approx([0.4317139531, 0.2789911656, 0.2892948813])
    assert one(spark, grid.over(g))[0] == pytest.approx(0.4561767060)
    p = grid.projected(g, {"h": F.lit(0.5), "d": F.lit(0.3), "a": F.lit(0.2)})
    assert one(spark, grid.over(p))[0] == pytest.approx(0.4508709193)
    top = one(spark, F.get(grid.top_scores(p, 1), 0))[0]
    assert (top["i"], top["j"]) == (1, 1) and top["p"] == pytest.approx(0.1427291721)
    assert list(one(spark, *grid.outcome(p).values())) == pytest.approx([0.5, 0.3, 0.2])


def test_over_lines_and_external_model(spark):
    assert [one(spark, grid.over_line(F.lit(4.25), x))[0] for x in (3.5, 4.5, 5.5)] == pytest.approx([0.6137884376, 0.4198816863, 0.2550609476])
    assert list(one(spark, *grid.from_gap(F.lit(100.0)))) == pytest.approx([1.9730263158, 1.1046052632])
    e = ratings.expected_score(F.lit(100.0), 65.0)
    assert list(one(spark, *odds.three_way(e, F.lit(100.0), 0.3067, 488.9))) == pytest.approx([0.5408324138, 0.2499670890, 0.2092004972])


def test_synthetic_prices(spark):
    assert list(one(spark, *odds.priced(F.lit(1500.0), F.lit(1500.0)))) == [2.71, 3.38, 3.83]
    assert list(one(spark, *odds.priced(F.lit(1900.0), F.lit(1500.0)))) == [1.41, 6.0, 19.92]


def test_refuses_rather_than_guesses(spark):
    known = spark.createDataFrame([("Man City",), ("Man United",)], "known_name string")
    asked = spark.createDataFrame([("Manchester",), ("Nowhere Rovers",), ("MAN-CITY",)], "name string")
    got = {r["name"]: r["known_name"] for r in resolve.unique_or_refuse(asked, known).collect()}
    assert got == {"Manchester": None, "Nowhere Rovers": None, "MAN-CITY": "Man City"}


def test_rho_is_found(spark):
    m = spark.createDataFrame([(0, 0, 1.2, 1.0)] * 60 + [(1, 1, 1.2, 1.0)] * 60 + [(0, 1, 1.2, 1.0)] * 30 + [(1, 0, 1.2, 1.0)] * 30, "hg int, ag int, lam double, mu double")
    rho = grid.fit_rho(m)
    nll = lambda r: -(60 * math.log(1 - 1.2 * r) + 60 * math.log(1 - r) + 30 * math.log(1 + 1.2 * r) + 30 * math.log(1 + r))
    assert nll(rho) <= min(nll(-0.2 + k / 100) for k in range(41)) + 1e-6


@pytest.mark.parametrize("raw, plain", [("București", "Bucuresti"), ("Botoșani", "Botosani"), ("Ġzira", "Gzira"), ("Jelgava Ņ", "Jelgava N"), ("Ķekava Ļ Ģ į", "Kekava L G i"), ("ﬁn", "fin"), ("日本 x", " x"), ("é", "e"), ("", "")])
def test_folding_by_decomposition(spark, raw, plain):
    assert one(spark, names.ascii_fold(F.lit(raw)))[0] == plain


CLUBS = ["Nott'm Forest", "Leeds", "Hull", "Man City", "Man United", "Brighton", "Burnley"]


@pytest.mark.parametrize("clubs, spellings, want", [
    (CLUBS, ["Nottingham Forest", "Nottm Forest"], ("Nott'm Forest", 1)), (CLUBS, ["Leeds United", "Leeds"], ("Leeds", 2)), (CLUBS, ["Hull City"], ("Hull", 3)), (CLUBS, ["Hull City", "Hull"], ("Hull", 2)),
    (CLUBS, ["Manchester City", "Man City"], ("Man City", 2)), (CLUBS, ["Brighton & Hove Albion"], ("Brighton", 4)), (["Man City", "Man United"], ["Manchester"], (None, None)),
    (CLUBS, ["Nowhere Rovers"], (None, None)), (["Real Sociedad", "Sociedad B"], ["Sociedad"], (None, None)), (CLUBS, [None, ""], (None, None))])
def test_unique_or_refuse(spark, clubs, spellings, want):
    asked = spark.createDataFrame([("x", spellings)], "name string, spellings array<string>")
    alias = spark.createDataFrame([("Nottingham Forest", "Nott'm Forest")], "alias string, known_name string")
    got = resolve.unique_or_refuse(asked, spark.createDataFrame([(c,) for c in clubs], "known_name string"), alias).first()
    assert (got["known_name"], got["stage"]) == want


@pytest.mark.parametrize("name, alias, want", [
    ("Sporting Gijon", None, ["SportingGijon", "Sporting Gijon", "Gijon"]), ("F.C. København", None, ["FCKobenhavn", "FC Kobenhavn", "Kobenhavn"]), ("Ajax", None, ["Ajax"]),
    ("FC Basel SK", None, ["FCBaselSK", "FC Basel SK", "FCBasel", "FC Basel"]), ("PSG", "Paris SG", ["ParisSG", "Paris SG", "PSG"]), ("", None, [])])
def test_candidates(spark, name, alias, want):
    assert one(spark, names.candidates(F.lit(name), None if alias is None else F.lit(alias)))[0] == want


def test_not_alike_with_short_and_null_keys(spark):
    schema = "date string, home_key string, away_key string"
    f = spark.createDataFrame([("d", "leedsunited", "hull"), ("d", "leeds", "york"), ("e", "leeds", "hull"), ("d", "a", "hull"), ("d", "bath", "b"), ("d", None, "hull")], schema)
    have = spark.createDataFrame([("d", "leeds", "hullcity"), ("d", "ajax", "hull"), ("d", "b", "brest")], schema)
    got = {tuple(r) for r in resolve.not_alike(f, have).select("f.date", "f.home_key", "f.away_key").collect()}
    assert got == {("d", "leeds", "york"), ("e", "leeds", "hull"), ("d", None, "hull")}


def test_region_settles_and_loose_keys_follow(spark):
    rows = [(1, "Liverpool", "ENG"), (2, "Liverpool", "URU"), (3, "PS Kalamata", "GRE"), (4, "NFC Volos", "GRE"), (5, "Nacional", "POR"), (6, "Nacional", "ESP")]
    known = spark.createDataFrame(rows, "known_id int, club string, region string").select("known_id", "region", names.squash(F.col("club")).alias("key"), names.loose_keys(F.col("club")).alias("loose"))
    asked = spark.createDataFrame([(x,) for x in ("Liverpool", "Kalamata", "Volos NFC", "Nacional", "Nowhere Rovers")], "name string")
    got = dict(map(tuple, resolve.by_region(asked, known, ["ENG", "GRE", "POR", "ESP"]).collect()))
    assert got == {"Liverpool": 1, "Kalamata": 3, "Volos NFC": 4, "Nacional": None, "Nowhere Rovers": None}


def test_top_scores_and_rounded_chances_of_many_distributions(spark):
    """Against plain arithmetic and Spark's own rounding."""
    rows = spark.range(7_000).select("id", (F.lit(0.5) + F.col("id") % 7 * 0.5).alias("lam"), (F.lit(0.5) + F.col("id") % 5 * 0.5).alias("mu"))
    rows = rows.withColumn("grid", grid.cells(F.col("lam"), F.col("mu"), F.lit(-0.05)))
    top = rows.withColumn("top", grid.likeliest(6, 12)).select("lam", "mu", "top").distinct().collect()
    cells_ = grid.score_rows(rows.where("id < 35"), "lam", "mu").select("*", grid.rounded_chance(F.col("p")).alias("q"), F.round("p", 6).alias("want")).collect()
    assert all(r["q"] == r["want"] for r in cells_) and len(cells_) == 35 * 81
    for r in top:
        of = sorted((-round(c["p"], 12), c["i"], c["j"]) for c in cells_ if (c["lam"], c["mu"]) == (r["lam"], r["mu"]))[:6]
        assert [(t["i"], t["j"]) for t in r["top"]] == [(i, j) for _, i, j in of]
    halves = spark.createDataFrame([(x,) for x in (0.0000005, 0.0000015, 0.1234565, 0.9999995, 0.1234564999, float("nan"), None, 1.0, 0.0)], "p double")
    assert not halves.where(~grid.rounded_chance(F.col("p")).eqNullSafe(F.round("p", 6))).count()
