"""Queries D: evaluation and aggregation; F and G: order and sets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import metrics, settle
from ..sources.matches import matches, team_matches
from .expressions import BETS_SQL, P_SQL, PICK_SQL, bets, probabilities, settled
from .registry import M_SQL, query, r6_sql, rounded, table
from .windows import K_DIV, MARGIN, club_ratings, replay_sql


def graded(spark, d):
    return settled(probabilities(matches(spark, d))).withColumn("own", F.exp(-F.col("logloss")))


GRADED_SQL = P_SQL + f"""
, gr AS (SELECT *, {PICK_SQL} AS pick, CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS result,
  greatest(CASE WHEN hg > ag THEN mh WHEN hg < ag THEN ma ELSE md END, 1e-9) AS own, greatest(CASE WHEN hg > ag THEN kh WHEN hg < ag THEN ka ELSE kd END, 1e-9) AS mkt FROM p)
"""


@query("d1_group_counts", M_SQL + "SELECT div, neutral, count(*) AS n FROM m GROUP BY 1, 2")
def group_counts(spark, d):
    return matches(spark, d).groupBy("div", "neutral").agg(F.count("*").alias("n"))


@query("d2_modal_score", M_SQL + f", c AS (SELECT div, hg, ag, count(*) AS n FROM m GROUP BY 1, 2, 3) SELECT div, hg, ag, {r6_sql('n::DOUBLE / t')} AS rate FROM (SELECT *, row_number() OVER (PARTITION BY div ORDER BY n DESC, hg, ag) AS rn, sum(n) OVER (PARTITION BY div) AS t FROM c) WHERE rn = 1")
def modal_score(spark, d):
    c = matches(spark, d).groupBy("div", "hg", "ag").agg(F.count("*").alias("n"))
    best = c.groupBy("div").agg(F.max_by(F.struct("hg", "ag", "n"), F.struct("n", -F.col("hg"), -F.col("ag"))).alias("x"), F.sum("n").alias("t"))
    return rounded(best.select("div", "x.hg", "x.ag", (F.col("x.n") / F.col("t")).alias("rate")))


@query("d3_accuracy", GRADED_SQL + f"SELECT div, {r6_sql('avg((pick = result)::INTEGER)')} AS accuracy, {r6_sql(chr(39).join(['avg((result = ', 'H', ')::INTEGER)']))} AS always_home FROM gr GROUP BY div")
def accuracy(spark, d):
    return rounded(graded(spark, d).groupBy("div").agg(F.avg("hit_1x2").alias("accuracy"), metrics.share(F.col("result") == "H").alias("always_home")))


@query("d4_log_loss", GRADED_SQL + f"SELECT div, {r6_sql('avg(-ln(own))')} AS model, {r6_sql('avg(-ln(mkt))')} AS market FROM gr GROUP BY div")
def log_loss(spark, d):
    g = graded(spark, d)
    mkt = F.when(F.col("result") == "H", F.col("kh")).when(F.col("result") == "D", F.col("kd")).otherwise(F.col("ka"))
    return rounded(g.groupBy("div").agg(F.avg("logloss").alias("model"), metrics.log_loss(mkt).alias("market")))


@query("d5_brier", P_SQL + f"SELECT div, {r6_sql('avg(pow(mh - (hg > ag)::INTEGER, 2))')} AS brier FROM p GROUP BY div")
def brier(spark, d):
    return rounded(probabilities(matches(spark, d)).groupBy("div").agg(metrics.brier(F.col("mh"), F.col("hg") > F.col("ag")).alias("brier")))


@query("d6_mae", M_SQL + f", c AS (SELECT avg(cards) AS mean FROM m) SELECT div, {r6_sql('avg(abs(cards - mean))')} AS mean_only, {r6_sql('avg(abs(cards - hg - 1))')} AS model FROM m, c GROUP BY div")
def mae(spark, d):
    m = matches(spark, d)
    m = m.join(m.agg(F.avg("cards").alias("mean")), how="cross")  # one row
    return rounded(m.groupBy("div").agg(F.avg(F.abs(F.col("cards") - F.col("mean"))).alias("mean_only"), F.avg(F.abs(F.col("cards") - F.col("hg") - 1)).alias("model")))


@query("d7_reliability", P_SQL + f"SELECT least(floor(mh * 10), 9)::BIGINT AS bin, count(*) AS n, {r6_sql('avg(mh)')} AS predicted, {r6_sql('avg((hg > ag)::INTEGER)')} AS observed FROM p GROUP BY 1")
def reliability(spark, d):
    return rounded(metrics.reliability(probabilities(matches(spark, d)), F.col("mh"), F.col("hg") > F.col("ag")))


@query("d8_draw_rule_sweep", GRADED_SQL + f", t AS (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3])::DOUBLE AS t) SELECT t, {r6_sql(chr(39).join(['avg((CASE WHEN md >= t THEN ', 'D', ' ELSE pick END = result)::INTEGER)']))} AS accuracy FROM gr, t GROUP BY t")
def draw_rule_sweep(spark, d):
    rule = F.when(F.col("md") >= F.col("t"), "D").otherwise(F.col("pick"))
    return rounded(metrics.sweep(graded(spark, d), [0.1, 0.15, 0.2, 0.25, 0.3], metrics.share(rule == F.col("result")).alias("accuracy")))


@query("d9_confidence_sweep", GRADED_SQL + f"""
, t AS (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS t)
SELECT t, count(*) FILTER (WHERE greatest(mh, md, ma) >= t) AS kept, {r6_sql('avg((pick = result)::INTEGER) FILTER (WHERE greatest(mh, md, ma) >= t)')} AS accuracy FROM gr, t GROUP BY t""")
def confidence_sweep(spark, d):
    sure = F.greatest("mh", "md", "ma") >= F.col("t")
    return rounded(metrics.sweep(graded(spark, d), [0.4, 0.5, 0.6, 0.7, 0.8], F.count_if(sure).alias("kept"), F.avg(F.when(sure, F.col("hit_1x2"))).alias("accuracy")))


@query("d10_double_chance_rollup", GRADED_SQL + f"""
, dc AS (SELECT *, CASE WHEN kh + kd >= kh + ka AND kh + kd >= ka + kd THEN '1X' WHEN kh + ka >= ka + kd THEN '12' ELSE 'X2' END AS kind, greatest(kh + kd, kh + ka, ka + kd) AS conf FROM gr)
SELECT coalesce(kind, 'all') AS kind, count(*) AS n, {r6_sql("avg(CASE WHEN (kind = '1X' AND result <> 'A') OR (kind = '12' AND result <> 'D') OR (kind = 'X2' AND result <> 'H') THEN 1.0::DOUBLE ELSE 0 END)")} AS accuracy, {r6_sql('avg(conf)')} AS confidence
FROM dc GROUP BY ROLLUP (kind)""")
def double_chance_rollup(spark, d):
    from ..functions.odds import first_max

    three = {"1X": F.col("kh") + F.col("kd"), "12": F.col("kh") + F.col("ka"), "X2": F.col("ka") + F.col("kd")}
    g = graded(spark, d).withColumns({"kind": first_max(three), "conf": F.greatest(*three.values())})
    miss = F.when(F.col("kind") == "1X", "A").when(F.col("kind") == "12", "D").otherwise("H")
    g = g.withColumn("hit", (F.col("result") != miss).cast("double"))
    return rounded(g.rollup("kind").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("confidence")).withColumn("kind", F.coalesce("kind", F.lit("all"))))


@query("d11_betting_record", BETS_SQL + f"SELECT div, count(*) AS bets, {r6_sql('avg(roi)')} AS roi, {r6_sql('avg((clv > 0)::INTEGER)')} AS beat_close, {r6_sql('avg(clv)')} AS clv FROM bets GROUP BY div")
def betting_record(spark, d):
    b = bets(probabilities(matches(spark, d)))
    return rounded(b.groupBy("div").agg(F.count("*").alias("bets"), F.avg("roi").alias("roi"), F.avg((F.col("clv") > 0).cast("int")).alias("beat_close"), F.avg("clv").alias("clv")))


@query("d12_division_means", replay_sql(f"{K_DIV} * {MARGIN}") + f"""
, t AS (SELECT home AS team, r.div, date, match_id, nh AS elo FROM rated r JOIN m USING (match_id) UNION ALL SELECT away, r.div, date, match_id, na FROM rated r JOIN m USING (match_id)),
l AS (SELECT team, div, elo FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) AS rn FROM t) WHERE rn = 1)
SELECT div, {r6_sql('avg(elo)')} AS mean_elo FROM l GROUP BY div""")
def division_means(spark, d):
    from .windows import team_ratings

    last = team_ratings(spark, d).groupBy("team").agg(F.max_by("elo", F.struct("date", "match_id")).alias("elo"))
    return rounded(last.groupBy(F.floor(F.col("team") / 100).cast("int").alias("div")).agg(F.avg("elo").alias("mean_elo")))


@query("d13_latest_division", M_SQL + "SELECT home AS team, div FROM (SELECT *, row_number() OVER (PARTITION BY home ORDER BY date DESC, match_id DESC) AS rn FROM m) WHERE rn = 1")
def latest_division(spark, d):
    return matches(spark, d).groupBy(F.col("home").alias("team")).agg(F.max_by("div", F.struct("date", "match_id")).alias("div"))


@query("d14_data_cutoff", M_SQL + "SELECT max(date) AS cutoff FROM m")
def data_cutoff(spark, d):
    return matches(spark, d).agg(F.max("date").alias("cutoff"))


@query("d15_paired_comparison", GRADED_SQL + f", x AS (SELECT -ln(own) + ln(mkt) AS diff FROM gr) SELECT count(*) AS n, {r6_sql('avg(diff)')} AS mean, {r6_sql('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))')} AS t FROM x")
def paired_comparison(spark, d):
    mkt = F.when(F.col("result") == "H", F.col("kh")).when(F.col("result") == "D", F.col("kd")).otherwise(F.col("ka"))
    return rounded(metrics.paired(graded(spark, d).withColumn("mloss", -F.log(F.greatest(mkt, F.lit(1e-9)))), "logloss", "mloss"))


@query("d15_bootstrap")
def bootstrap(spark, d):
    return rounded(metrics.bootstrap(graded(spark, d), "match_id", F.col("logloss")))


#: Upper edges of the Poisson(1) weights 0 to 7.
EDGES = [sum(math.exp(-1) / math.factorial(k) for k in range(n)) for n in range(1, 9)]


@query("d15_paired_bootstrap", GRADED_SQL + f"""
, x AS (SELECT match_id, -ln(own) + ln(greatest(mkt, 1e-9)) AS diff FROM gr),
u AS (SELECT rep, diff, CAST('0x' || substr(md5(match_id || ':' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM x, range(100) AS r(rep)),
w AS (SELECT rep, diff, {' + '.join(f'(u >= {e!r}::DOUBLE)::INTEGER' for e in EDGES)} AS w FROM u),
reps AS (SELECT rep, sum(diff * w) / sum(w) AS mean FROM w GROUP BY rep)
SELECT (SELECT count(*) FROM x) AS n, {r6_sql('(SELECT avg(diff) FROM x)')} AS mean, {r6_sql('quantile_cont(mean, 0.025)')} AS low, {r6_sql('quantile_cont(mean, 0.975)')} AS high, {r6_sql('avg((mean < 0)::INTEGER)')} AS p_better FROM reps""")
def paired_bootstrap(spark, d):
    """The model's log-loss less the market's: interval and chance that the model is better."""
    mkt = F.when(F.col("result") == "H", F.col("kh")).when(F.col("result") == "D", F.col("kd")).otherwise(F.col("ka"))
    return rounded(metrics.paired_bootstrap(graded(spark, d), "match_id", F.col("logloss"), -F.log(F.greatest(mkt, F.lit(1e-9)))))


@query("d16_gap_distribution", M_SQL + f", g AS (SELECT team, date - lag(date) OVER (PARTITION BY team ORDER BY date, match_id) AS gap FROM tm) SELECT count(gap) AS n, {r6_sql('quantile_cont(gap, 0.99)')} AS p99, max(gap)::INTEGER AS longest, count(*) FILTER (WHERE gap > 60) AS returns FROM g")
def gap_distribution(spark, d):
    return rounded(metrics.gaps(team_matches(matches(spark, d))).agg(F.count("gap").alias("n"), F.percentile("gap", 0.99).alias("p99"), F.max("gap").alias("longest"), F.count_if(F.col("gap") > 60).alias("returns")))


@query("d17_draw_curve", P_SQL + f"""
, b AS (SELECT floor(abs(gap) / 40) AS bin, count(*) AS n, avg((hg = ag)::INTEGER) AS rate FROM p GROUP BY 1 HAVING avg((hg = ag)::INTEGER) > 0),
s AS (SELECT sum(n) AS n, sum(n * (bin + 0.5) * 40)::DOUBLE AS x, sum(n * ln(rate)) AS y, sum(n * pow((bin + 0.5) * 40, 2)) AS xx, sum(n * (bin + 0.5) * 40 * ln(rate)) AS xy FROM b),
l AS (SELECT *, (n * xy - x * y) / (n * xx - x * x) AS slope FROM s)
SELECT {r6_sql('exp((y - slope * x) / n)')} AS a, round(-1 / slope, 2) AS c FROM l""")
def draw_curve(spark, d):
    gap = (F.col("home") % 100 - F.col("away") % 100) * 40.0
    return rounded(metrics.draw_curve(matches(spark, d), gap, F.col("hg") == F.col("ag")).withColumn("c", F.round("c", 2)))


@query("d18_medians", M_SQL + f"SELECT div, {r6_sql('median(ch)')} AS med FROM m GROUP BY div")
def medians(spark, d):
    return rounded(matches(spark, d).groupBy("div").agg(F.median("ch").alias("med")))


@query("d19_keep_first_last", M_SQL + "SELECT home, away, min(match_id) FILTER (WHERE f = 1) AS first_id, min(match_id) FILTER (WHERE l = 1) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY date, match_id) AS f, row_number() OVER (PARTITION BY home, away ORDER BY date DESC, match_id DESC) AS l FROM m) GROUP BY 1, 2")
def keep_first_last(spark, d):
    when = F.struct("date", "match_id")
    return matches(spark, d).groupBy("home", "away").agg(F.min_by("match_id", when).alias("first_id"), F.max_by("match_id", when).alias("last_id"))


@query("d20_entity_sets", M_SQL + "SELECT div, count(DISTINCT team) AS teams FROM tm GROUP BY div")
def entity_sets(spark, d):
    m = matches(spark, d)
    return m.select("div", F.col("home").alias("team")).union(m.select("div", "away")).distinct().groupBy("div").agg(F.count("*").alias("teams"))


@query("d21_correlation", P_SQL + f"SELECT div, {r6_sql('corr(kh, mh)')} AS r FROM p GROUP BY div")
def correlation(spark, d):
    return rounded(probabilities(matches(spark, d)).groupBy("div").agg(F.corr("kh", "mh").alias("r")))


@query("d22_blend_sweep", GRADED_SQL + f"""
, w AS (SELECT k / 10.0::DOUBLE AS w FROM range(11) AS r(k)),
x AS (SELECT w, pow(mkt, w) * pow(own, 1 - w) / (pow(kh, w) * pow(mh, 1 - w) + pow(kd, w) * pow(md, 1 - w) + pow(ka, w) * pow(ma, 1 - w)) AS p FROM gr, w),
s AS (SELECT w, round(avg(-ln(p)), 6) AS loss FROM x GROUP BY w)
SELECT w, loss + 0.0 AS loss, w = (SELECT arg_min(w, (loss, w)) FROM s) AS best FROM s""")
def blend_sweep(spark, d):
    w = F.col("w")
    mkt = F.when(F.col("result") == "H", F.col("kh")).when(F.col("result") == "D", F.col("kd")).otherwise(F.col("ka"))
    mix = lambda k, m: F.pow(k, w) * F.pow(m, 1 - w)
    total = sum((mix(F.col(f"k{o}"), F.col(f"m{o}")) for o in "da"), mix(F.col("kh"), F.col("mh")))
    s = rounded(metrics.sweep(graded(spark, d), [k / 10 for k in range(11)], F.avg(-F.log(mix(F.greatest(mkt, F.lit(1e-9)), F.col("own")) / total)).alias("loss"), name="w"))
    return s.withColumn("best", F.col("w") == F.min_by("w", F.struct("loss", "w")).over(W.partitionBy()))  # a row a weight


@query("d23_coverage_shares", M_SQL + f"SELECT div, {r6_sql('avg((ch IS NOT NULL)::INTEGER)')} AS with_close, {r6_sql('avg((referee IS NOT NULL)::INTEGER)')} AS with_referee, {r6_sql('avg((hst IS NOT NULL)::INTEGER)')} AS with_shots FROM m GROUP BY div")
def coverage_shares(spark, d):
    return rounded(matches(spark, d).groupBy("div").agg(*[metrics.share(F.col(c).isNotNull()).alias(n) for c, n in (("ch", "with_close"), ("referee", "with_referee"), ("hst", "with_shots"))]))


@query("d24_feature_summary", M_SQL + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6_sql(f'avg({c})')} AS mean, {r6_sql(f'stddev_samp({c})')} AS std, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, count(*) - count({c}) AS nulls FROM m" for c in ("oh", "ch", "hst", "cards")))
def feature_summary(spark, d):
    cols = ("oh", "ch", "hst", "cards")
    rows = matches(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    return rounded(rows.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), (F.count("*") - F.count("v")).alias("nulls")))


LAST_SQL = replay_sql(f"{K_DIV} * {MARGIN}") + """
, t AS (SELECT home AS team, date, match_id, nh AS elo FROM rated JOIN m USING (match_id) UNION ALL SELECT away, date, match_id, na FROM rated JOIN m USING (match_id)),
l AS (SELECT team, round(elo, 6) + 0.0 AS elo FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) AS rn FROM t) WHERE rn = 1)
"""


def last_ratings(spark, d):
    from .windows import team_ratings

    return rounded(team_ratings(spark, d).groupBy("team").agg(F.max_by("elo", F.struct("date", "match_id")).alias("elo")))


@query("d25_ranking", LAST_SQL + "SELECT team, elo, rank() OVER (PARTITION BY team // 100 ORDER BY elo DESC)::INTEGER AS place FROM l")
def ranking(spark, d):
    return last_ratings(spark, d).withColumn("place", F.rank().over(W.partitionBy(F.floor(F.col("team") / 100)).orderBy(F.desc("elo"))))


@query("d26_by_day", M_SQL + "SELECT date, count(*) AS n, string_agg(match_id::VARCHAR, ',' ORDER BY match_id) AS ids FROM m GROUP BY date")
def by_day(spark, d):
    return matches(spark, d).groupBy("date").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("match_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("d27_live_rollup", GRADED_SQL + f"SELECT stage, count(*) AS n, {r6_sql('avg((pick = result)::INTEGER)')} AS accuracy, {r6_sql('avg(-ln(own))')} AS logloss, min(date) AS first, max(date) AS last FROM gr GROUP BY stage")
def live_rollup(spark, d):
    return rounded(graded(spark, d).groupBy("stage").agg(F.count("*").alias("n"), F.avg("hit_1x2").alias("accuracy"), F.avg("logloss").alias("logloss"), F.min("date").alias("first"), F.max("date").alias("last")))


@query("d28_subgroup_bias", P_SQL + f"""
, x AS (SELECT neutral, CASE WHEN hg > ag THEN 1 WHEN hg = ag THEN 0.5 ELSE 0 END - e AS diff FROM p)
SELECT neutral, count(*) AS n, {r6_sql('avg(diff)')} AS bias, {r6_sql('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))')} AS t FROM x GROUP BY neutral""")
def subgroup_bias(spark, d):
    from ..operators.ratings import expected_score

    gap = (F.col("home") % 100 - F.col("away") % 100) * 40.0
    diff = F.when(F.col("hg") > F.col("ag"), 1.0).when(F.col("hg") == F.col("ag"), 0.5).otherwise(0.0) - expected_score(gap, 68.0)
    return rounded(matches(spark, d).select("neutral", diff.alias("diff")).groupBy("neutral").agg(F.count("*").alias("n"), F.avg("diff").alias("bias"), (F.avg("diff") / (F.stddev_samp("diff") / F.sqrt(F.count("*")))).alias("t")))


# -- F and G ------------------------------------------------------------------------------------------------------------


@query("f1_chronological", M_SQL + "SELECT match_id, date, row_number() OVER (ORDER BY date, match_id) AS n FROM m")
def chronological(spark, d):
    from ..operators.form import numbered

    return numbered(matches(spark, d).select("match_id", "date")).select("match_id", "date", "n")


@query("f2_slate_order", M_SQL + """
, s AS (SELECT match_id, date, CASE WHEN match_id % 4 = 0 THEN '' ELSE lpad((12 + match_id % 9)::VARCHAR, 2, '0') || ':00' END AS kickoff, stage FROM m)
SELECT date, match_id, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN kickoff = '' THEN '99:99' ELSE kickoff END, stage, match_id)::INTEGER AS place FROM s""")
def slate_order(spark, d):
    m = matches(spark, d)
    kickoff = F.when(F.col("match_id") % 4 == 0, "").otherwise(F.concat(F.lpad((12 + F.col("match_id") % 9).cast("string"), 2, "0"), F.lit(":00")))
    order = W.partitionBy("date").orderBy(F.coalesce(F.nullif(kickoff, F.lit("")), F.lit("99:99")), "stage", "match_id")
    return m.select("date", "match_id", F.row_number().over(order).alias("place"))


@query("f3_top_ratings", LAST_SQL + "SELECT team, elo FROM l ORDER BY elo DESC, team LIMIT 20")
def top_ratings(spark, d):
    return last_ratings(spark, d).orderBy(F.desc("elo"), "team").limit(20)


SEARCH_SQL = "SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE lower(c_name) LIKE '%007%' AND c_mktsegment = (SELECT min(c_mktsegment) FROM customer) ORDER BY c_name, c_custkey LIMIT 15"


@query("f4_search_with_total", SEARCH_SQL)
def search_with_total(spark, d):
    """A case-insensitive search: the first names and how many there are."""
    c = table(spark, d, "customer")
    found = c.join(c.agg(F.min("c_mktsegment").alias("c_mktsegment")), "c_mktsegment").where(F.lower("c_name").contains("007"))
    return found.select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(15).join(found.agg(F.count("*").alias("total")), how="cross")  # one row


@query("g1_concat_frames", M_SQL + "SELECT match_id, div, hst, NULL::BIGINT AS referee FROM m WHERE match_id % 2 = 0 UNION ALL SELECT match_id, div, NULL, referee FROM m WHERE match_id % 2 = 1")
def concat_frames(spark, d):
    m = matches(spark, d)
    return m.where("match_id % 2 = 0").select("match_id", "div", "hst").unionByName(m.where("match_id % 2 = 1").select("match_id", "div", "referee"), allowMissingColumns=True)


@query("g2_team_union", M_SQL + "SELECT DISTINCT team FROM tm")
def team_union(spark, d):
    m = matches(spark, d)
    return m.select(F.col("home").alias("team")).union(m.select("away")).distinct()


@query("g3_missing_names", M_SQL + "SELECT DISTINCT away AS team FROM m WHERE match_id % 3 = 0 EXCEPT SELECT home FROM m WHERE match_id % 7 = 0")
def missing_names(spark, d):
    m = matches(spark, d)
    return m.where("match_id % 3 = 0").select(F.col("away").alias("team")).subtract(m.where("match_id % 7 = 0").select("home"))


@query("g4_key_membership", M_SQL + "SELECT away AS team FROM m WHERE match_id % 3 = 0 INTERSECT SELECT home FROM m WHERE match_id % 7 = 0")
def key_membership(spark, d):
    m = matches(spark, d)
    return m.where("match_id % 3 = 0").select(F.col("away").alias("team")).intersect(m.where("match_id % 7 = 0").select("home"))
