"""Queries E1-E19: windows, sequential ratings, folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import form, ratings
from ..sources.matches import matches, team_matches
from .registry import M_SQL, query, r6_sql, rounded, table

TOP_DIVISIONS = (0, 3, 6, 9, 12)


def k_of_division():
    return F.when(F.col("div").isin(*TOP_DIVISIONS), 22).otherwise(20)


def weight(k):
    return k * ratings.margin_multiplier(F.abs(F.col("hg") - F.col("ag")))


OWN = "OVER (PARTITION BY team ORDER BY date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def mean_sql(x: str, n: int, prior: str) -> str:
    return r6_sql(f"coalesce(avg({x}) {OWN.format(n=n)}, {prior})")


@query("e1_rolling_form", M_SQL + f"""
SELECT team, match_id, {mean_sql('gf', 5, '1.3')} AS gf5, {mean_sql('gf', 10, '1.3')} AS gf10, {mean_sql('ga', 5, '1.3')} AS ga5,
       {mean_sql('ga', 10, '1.3')} AS ga10, {mean_sql('pts / 3.0::DOUBLE', 5, '0.5')} AS form5 FROM tm""")
def rolling_form(spark, d):
    return rounded(form.rolling_form(team_matches(matches(spark, d))))


@query("e2_rest_days", M_SQL + """
SELECT team, match_id, least(coalesce(date - lag(date) OVER (PARTITION BY team ORDER BY date, match_id), 7), 60)::INTEGER AS rest FROM tm""")
def rest_days(spark, d):
    return form.rest_days(team_matches(matches(spark, d)))


@query("e3_head_to_head", M_SQL + f"""
, pair AS (SELECT *, least(home, away) AS lo, greatest(home, away) AS hi,
  CASE WHEN hg = ag THEN 0.5::DOUBLE WHEN (hg > ag) = (home < away) THEN 1 ELSE 0 END AS score FROM m)
SELECT match_id, {r6_sql('coalesce(avg(score) OVER (PARTITION BY lo, hi ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5)')} AS h2h FROM pair""")
def head_to_head(spark, d):
    return rounded(form.head_to_head(matches(spark, d)))


@query("e4_shots_form", M_SQL + f"""
, s AS (SELECT team, match_id, date, coalesce(sf, gf) AS sf, coalesce(sa, ga) AS sa FROM tm)
SELECT team, match_id, {mean_sql('sf', 10, '4.4')} AS sot_for, {mean_sql('sa', 10, '4.4')} AS sot_against,
  {r6_sql(f"coalesce(avg(sf) {OWN.format(n=10)}, 4.4) - coalesce(avg(sa) {OWN.format(n=10)}, 4.4)")} AS dominance FROM s""")
def shots_form(spark, d):
    return rounded(form.shots_form(team_matches(matches(spark, d))))


@query("e5_wide_shots", M_SQL + f"""
, s AS (SELECT team, match_id, date, gf, coalesce(sf, gf) AS sf, coalesce(sa, ga) AS sa FROM tm)
SELECT team, match_id, {mean_sql('sf', 5, '4.4')} AS sf5, {mean_sql('sf', 10, '4.4')} AS sf10, {mean_sql('sa', 5, '4.4')} AS sa5, {mean_sql('sa', 10, '4.4')} AS sa10,
  {mean_sql('gf', 10, '1.3')} AS gf10, {r6_sql(f"coalesce(avg(gf) {OWN.format(n=10)}, 1.3) - 0.29::DOUBLE * coalesce(avg(sf) {OWN.format(n=10)}, 4.4)")} AS over FROM s""")
def wide_shots(spark, d):
    return rounded(form.wide_shots(team_matches(matches(spark, d))))


@query("e7_cards_form", M_SQL + f"""
SELECT team, match_id, {r6_sql('avg(cards) ' + OWN.format(n=5))} AS cards5, {r6_sql('avg(cards) ' + OWN.format(n=10))} AS cards10 FROM tm""")
def cards_form(spark, d):
    return rounded(form.cards_form(team_matches(matches(spark, d))))


@query("e8_referee_form", M_SQL + f"""
SELECT match_id, CASE WHEN referee IS NOT NULL THEN {r6_sql('avg(cards) OVER (w ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)')} END AS ref_avg,
  CASE WHEN referee IS NOT NULL THEN count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE 0 END AS ref_n
FROM m WINDOW w AS (PARTITION BY referee ORDER BY date, match_id)""")
def referee_form(spark, d):
    return rounded(form.referee_form(matches(spark, d)))


def replay_sql(step: str, edge: str = "68.0", base: str = "1500.0", order: str = "date, match_id", where: str = "true", keep: str = "x", seed: str = "") -> str:
    """All divisions in lock-step, a list of the twelve teams' ratings as state; `step` is K times the margin multiplier."""
    start = f"[{', '.join([f'{base}::DOUBLE'] * 12)}]" if not seed else f"list_transform(range(12), lambda i: ({seed})::DOUBLE)"
    return M_SQL + f"""
, seq AS (SELECT *, row_number() OVER (PARTITION BY div ORDER BY {order}) AS n, (home % 100)::INTEGER AS h, (away % 100)::INTEGER AS a,
          CASE WHEN hg > ag THEN 1.0::DOUBLE WHEN hg = ag THEN 0.5 ELSE 0 END AS s, ({step})::DOUBLE AS k, ({edge})::DOUBLE AS edge FROM m WHERE {where}),
run AS (
  SELECT DISTINCT div, 0::BIGINT AS n, {start} AS elo, NULL::BIGINT AS match_id, NULL::DOUBLE AS eh, NULL::DOUBLE AS ea, NULL::DOUBLE AS ex, NULL::DOUBLE AS nh, NULL::DOUBLE AS na FROM seq
  UNION ALL
  SELECT div, n, list_transform(elo, lambda x, i: CASE WHEN i - 1 = h THEN nh WHEN i - 1 = a THEN na ELSE x END), match_id, eh, ea, ex, nh, na
  FROM (SELECT *, {keep.replace('x', '(eh + k * (s - ex))')} AS nh, {keep.replace('x', '(ea - k * (s - ex))')} AS na
        FROM (SELECT r.div, q.n, r.elo, q.match_id, q.h, q.a, q.s, q.k, r.elo[q.h + 1] AS eh, r.elo[q.a + 1] AS ea,
                     1.0 / (1.0 + pow(10.0::DOUBLE, (r.elo[q.a + 1] - (r.elo[q.h + 1] + q.edge)) / 400.0)) AS ex
              FROM run r JOIN seq q ON q.div = r.div AND q.n = r.n + 1)))
, rated AS (SELECT * FROM run WHERE match_id IS NOT NULL)
"""


MARGIN = "CASE WHEN abs(hg - ag) <= 1 THEN 1.0::DOUBLE ELSE ln(abs(hg - ag) + 1) * 0.75 END"
K_DIV = f"(CASE WHEN div IN {TOP_DIVISIONS} THEN 22 ELSE 20 END)"
RATED = "SELECT match_id, " + ", ".join(f"{r6_sql(a)} AS {b}" for a, b in (("eh", "elo_h"), ("ea", "elo_a"), ("ex", "exp_h"), ("nh", "elo_h_post"), ("na", "elo_a_post"))) + " FROM rated"


def club_ratings(spark, d):
    return ratings.replay(matches(spark, d), weight(k_of_division()))


@query("e9_rating_replay", replay_sql(f"{K_DIV} * {MARGIN}") + RATED)
def rating_replay(spark, d):
    return rounded(club_ratings(spark, d))


@query("e10_seeded_replay", replay_sql(f"20 * {MARGIN}", edge="100.0", keep="floor(x * 10 + 0.5) / 10", seed="1400 + 10 * i") + RATED.replace(r6_sql("ex"), r6_sql("floor(ex * 10000 + 0.5) / 10000")))
def seeded_replay(spark, d):
    m = matches(spark, d)
    seeds = team_matches(m).select("team").distinct().select("team", (1400 + 10 * (F.col("team") % 100)).cast("double").alias("seed"))
    return rounded(ratings.replay(m, weight(F.lit(20)), base=1400.0, home_edge=100.0, seeds=seeds, digits=(1, 4)))


@query("e11_shot_rating", replay_sql("20 * CASE WHEN abs(hst - ast) / 2.2 <= 1 THEN 1.0::DOUBLE ELSE ln(abs(hst - ast) / 2.2 + 1) * 0.75 END", where="hst IS NOT NULL").replace("CASE WHEN hg > ag THEN 1.0::DOUBLE WHEN hg = ag THEN 0.5 ELSE 0 END AS s", "CASE WHEN hst > ast THEN 1.0::DOUBLE WHEN hst = ast THEN 0.5 ELSE 0 END AS s") + RATED)
def shot_rating(spark, d):
    m = matches(spark, d).where("hst is not null")
    score = F.when(F.col("hst") > F.col("ast"), 1.0).when(F.col("hst") == F.col("ast"), 0.5).otherwise(0.0)
    return rounded(ratings.replay(m, 20 * ratings.margin_multiplier(F.abs(F.col("hst") - F.col("ast")) / 2.2), score=score))


def team_ratings(spark, d):
    """(team, date, match_id, elo) after each match."""
    r = club_ratings(spark, d).join(matches(spark, d).select("match_id", "date", "home", "away"), "match_id")
    return r.select("match_id", "date", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("elo_h_post").alias("elo")), F.struct(F.col("away").alias("team"), F.col("elo_a_post").alias("elo")))).alias("x")).select("x.team", "date", "match_id", "x.elo")


@query("e6_rating_trend", replay_sql(f"{K_DIV} * {MARGIN}") + f"""
, t AS (SELECT home AS team, date, match_id, nh AS elo FROM rated JOIN m USING (match_id) UNION ALL SELECT away, date, match_id, na FROM rated JOIN m USING (match_id))
SELECT team, match_id, {r6_sql('coalesce(lag(elo, 1) OVER w - lag(elo, 10) OVER w, 0.0)')} AS trend10, {r6_sql('coalesce(lag(elo, 1) OVER w - lag(elo, 20) OVER w, 0.0)')} AS trend20
FROM t WINDOW w AS (PARTITION BY team ORDER BY date, match_id)""")
def rating_trend(spark, d):
    return rounded(team_ratings(spark, d).select("team", "match_id", form.trend(10).alias("trend10"), form.trend(20).alias("trend20")))


@query("e12_point_in_time_totals", f"""
WITH v AS (SELECT user_id AS member, event_type AS grp, value, ts, event_id AS id FROM events),
p AS (SELECT *, lag(grp) OVER w AS og, lag(value) OVER w AS ov FROM v WINDOW w AS (PARTITION BY member ORDER BY ts, id)),
deltas AS (SELECT grp, ts, id, 1 AS part, CASE WHEN og = grp THEN value - ov ELSE value END AS delta FROM p
      UNION ALL SELECT og, ts, id, 0, -ov FROM p WHERE og <> grp)
SELECT grp, ts, id, {r6_sql('sum(delta) OVER (PARTITION BY grp ORDER BY ts, id, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS total FROM deltas""")
def point_in_time_totals(spark, d):
    e = table(spark, d, "events")
    return rounded(form.group_totals(e.select(F.col("user_id").alias("member"), F.col("event_type").alias("grp"), "value", "ts", F.col("event_id").alias("id")), F.to_date("ts")))


@query("e13_holdout", M_SQL + "SELECT match_id, date, div FROM m ORDER BY date DESC, match_id DESC LIMIT 400")
def holdout(spark, d):
    return form.last_rows(matches(spark, d).select("match_id", "date", "div"), 400)


@query("e14_expanding_folds", M_SQL + """
, r AS (SELECT match_id, row_number() OVER (ORDER BY date, match_id) AS n, count(*) OVER () AS total FROM m)
SELECT fold::INTEGER AS fold, CASE WHEN n <= total - (5 - fold) * (total // 5) THEN 'train' ELSE 'test' END AS role, match_id
FROM r, range(1, 5) AS f(fold) WHERE n <= total - (4 - fold) * (total // 5)""")
def expanding_folds(spark, d):
    return form.expanding_folds(matches(spark, d).select("match_id", "date"), 4)


@query("e15_walk_forward", M_SQL + """
, r AS (SELECT match_id, row_number() OVER (ORDER BY date, match_id) AS n, count(*) OVER () AS total FROM m)
SELECT win::INTEGER AS win, CASE WHEN n > total - (win + 1) * 200 THEN 'test' ELSE 'train' END AS role, match_id
FROM r, range(0, 5) AS f(win) WHERE total - (win + 1) * 200 >= 500 AND n <= total - win * 200""")
def walk_forward(spark, d):
    return form.walk_forward(matches(spark, d).select("match_id", "date"), 5, 200, 500)


@query("e16_monthly_groups", M_SQL + """
, months AS (SELECT date_trunc('month', date)::DATE AS month, min(date) AS first, count(*) AS test_n FROM m GROUP BY 1), days AS (SELECT date, count(*) AS k FROM m GROUP BY 1)
SELECT month, first, test_n, coalesce((SELECT sum(k) FROM days WHERE date < first), 0)::BIGINT AS train_n FROM months""")
def monthly_groups(spark, d):
    """Refit groups by month: training is everything strictly before the month's first match."""
    m = matches(spark, d).select("date")
    months = m.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("first"), F.count("*").alias("test_n"))  # a row a month
    return months.select("month", "first", "test_n", F.coalesce(F.sum("test_n").over(W.orderBy("month").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("train_n"))


@query("e17_recency_weights", M_SQL + f"""
, c AS (SELECT max(date) AS latest FROM m)
SELECT div, {r6_sql('sum(exp(-ln(2) / 180 * (latest - date)))')} AS weight, {r6_sql('sum(exp(-ln(2) / 180 * (latest - date)) * (hg + ag)) / sum(exp(-ln(2) / 180 * (latest - date)))')} AS goals FROM m, c GROUP BY div""")
def recency_weights(spark, d):
    m = matches(spark, d)
    w = F.exp(-F.log(F.lit(2.0)) / 180 * F.datediff("latest", "date"))
    m = m.join(m.agg(F.max("date").alias("latest")), how="cross")  # one row
    return rounded(m.groupBy("div").agg(F.sum(w).alias("weight"), (F.sum(w * (F.col("hg") + F.col("ag"))) / F.sum(w)).alias("goals")))


@query("e18_latest_name", "SELECT user_id, arg_max(event_type, ts) AS latest FROM events GROUP BY user_id")
def latest_name(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
