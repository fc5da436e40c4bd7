"""Queries A: sources and sinks.  Files are first written from the tables, in the messy forms that the readers take."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settle
from ..sources import readers
from ..sources.matches import matches
from ..sources.storage import stored
from ..streaming.flows import shared
from ..functions import odds
from .expressions import BETS_SQL, bets, probabilities
from .registry import M_SQL, query, r6_sql, rounded, table


@query("a1_dirty_csv", M_SQL + """
SELECT 'D' || div AS div, date, 'Té ' || home AS home, 'Té ' || away AS away, CASE WHEN match_id % 11 <> 0 THEN hg END AS hg, ag, hst, ast FROM m WHERE match_id % 13 <> 0""")
def dirty_csv(spark, d):
    m = matches(spark, d)
    div = F.concat(F.lit("D"), "div")
    date = F.when(F.col("match_id") % 2 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "dd/MM/yy"))
    path = f"{shared(spark)}/club"
    m.select(
        F.when(F.col("match_id") % 3 != 0, div).alias("Div"), F.when(F.col("match_id") % 3 == 0, div).alias("AltDiv"), F.when(F.col("match_id") % 13 != 0, date).otherwise("?").alias("Date"),
        F.concat(F.lit("Té "), "home").alias("HomeTeam"), F.concat(F.lit("Té "), "away").alias("AwayTeam"), F.when(F.col("match_id") % 11 == 0, "n/a").otherwise(F.col("hg").cast("string")).alias("FTHG"), "ag", "hst", "ast",
    ).withColumnsRenamed({"ag": "FTAG", "hst": "HST", "ast": "AST"}).write.csv(path, header=True, encoding="ISO-8859-1")
    return readers.club_matches(spark, path)


@query("a2_international_csv", M_SQL + "SELECT date, 'T' || home AS home_team, 'T' || away AS away_team, CASE WHEN match_id % 9 <> 0 THEN hg::DOUBLE END AS home_score, CASE WHEN match_id % 9 <> 0 THEN ag::DOUBLE END AS away_score, stage AS tournament, neutral FROM m")
def international_csv(spark, d):
    played = F.col("match_id") % 9 != 0
    path = f"{shared(spark)}/international"
    matches(spark, d).select("date", F.concat(F.lit("T"), "home").alias("home_team"), F.concat(F.lit("T"), "away").alias("away_team"), F.when(played, F.col("hg").cast("double")).alias("home_score"), F.when(played, F.col("ag").cast("double")).alias("away_score"), F.col("stage").alias("tournament"), "neutral").write.csv(path, header=True)
    return readers.international_matches(spark, path)


@query("a3_incremental_ingest", M_SQL + "SELECT match_id, div FROM m WHERE match_id % 2 = 0 UNION ALL SELECT match_id, div FROM m n WHERE match_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM m h WHERE h.match_id % 2 = 0 AND h.div = n.div AND h.home = n.home AND h.away = n.away AND h.date = n.date)")
def incremental_ingest(spark, d):
    m = matches(spark, d)
    have, landed = m.where("match_id % 2 = 0"), m.where("match_id % 2 = 1").drop("ch")
    new = settle.new_only(landed, have, ["div", "home", "away", "date"]).select("n.*")
    return have.unionByName(new, allowMissingColumns=True).select("match_id", "div")


@query("a4_fixtures_load", M_SQL + "SELECT div, count(*) AS n, min(date) AS first, max(date) AS last FROM m WHERE div IN (0, 1, 2, 3) AND date >= DATE '2000-01-01' GROUP BY div")
def fixtures_load(spark, d):
    return matches(spark, d).where("div in (0, 1, 2, 3) and date >= '2000-01-01'").groupBy("div").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("a5_scoreboard_json", M_SQL + "SELECT match_id::VARCHAR AS id, date, 'T' || home AS home, 'T' || away AS away, hg, ag, hst::DOUBLE AS hst, ast::DOUBLE AS ast FROM m WHERE match_id % 5 <> 0")
def scoreboard_json(spark, d):
    def side(which, team, goals, shots):
        return F.struct(F.lit(which).alias("homeAway"), F.col(goals).cast("string").alias("score"), F.struct(F.concat(F.lit("T"), team).alias("displayName")).alias("team"), F.array(F.struct(F.lit("fouls").alias("name"), F.lit("9").alias("displayValue")), F.struct(F.lit("shotsOnTarget").alias("name"), F.coalesce(F.col(shots).cast("string"), F.lit("-")).alias("displayValue"))).alias("statistics"))

    status = F.struct(F.struct((F.col("match_id") % 5 != 0).alias("completed")).alias("type")).alias("status")
    event = F.struct(F.col("match_id").cast("string").alias("id"), F.date_format("date", "yyyy-MM-dd'T'12:00'Z'").alias("date"), F.array(F.struct(status, F.array(side("away", "away", "ag", "ast"), side("home", "home", "hg", "hst")).alias("competitors"))).alias("competitions"))
    feed = matches(spark, d).groupBy("date").agg(F.collect_list(event).alias("events")).select(F.to_json(F.struct("events")).alias("body"))
    return readers.scoreboard_matches(feed)


@query("a6_day_feed", M_SQL + "SELECT match_id::VARCHAR AS id, 'T' || home AS home, 'T' || away AS away, CASE WHEN match_id % 4 <> 0 THEN hg END AS hg, ag, CASE WHEN match_id % 10 = 0 THEN 'postponed' WHEN match_id % 4 <> 0 THEN 'finished' ELSE 'fixture' END AS status FROM m")
def day_feed(spark, d):
    event = F.struct(F.col("match_id").cast("string").alias("idEvent"), F.concat(F.lit("T"), "home").alias("strHomeTeam"), F.concat(F.lit("T"), "away").alias("strAwayTeam"), F.when(F.col("match_id") % 4 != 0, F.col("hg").cast("string")).alias("intHomeScore"), F.col("ag").cast("string").alias("intAwayScore"), F.when(F.col("match_id") % 10 == 0, "yes").otherwise("no").alias("strPostponed"))
    return readers.day_feed(matches(spark, d).groupBy("date").agg(F.collect_list(event).alias("events")).select(F.to_json(F.struct("events")).alias("body")))


@query("a7_manual_keys", M_SQL + "SELECT match_id, 'm-' || date || '-T' || home || '-TeamB' || away AS id FROM m")
def manual_keys(spark, d):
    return matches(spark, d).select("match_id", readers.manual_key(F.col("date").cast("string"), F.concat(F.lit("T "), "home"), F.concat(F.lit("Team B "), "away")).alias("id"))


@query("a8_rating_periods", M_SQL + "SELECT DISTINCT 'T' || team AS club, 1400.0::DOUBLE + team % 100 AS elo, DATE '1995-01-01' + (team % 9)::INTEGER AS start, DATE '1999-01-01' AS finish FROM tm WHERE team % 5 <> 0")
def rating_periods(spark, d):
    teams = matches(spark, d).select(F.col("home").alias("team")).union(matches(spark, d).select("away")).distinct()
    path = f"{shared(spark)}/periods"
    elo = F.when(F.col("team") % 5 == 0, "None").otherwise((1400.0 + F.col("team") % 100).cast("string"))
    line = F.concat_ws(",", F.lit("1"), F.concat(F.lit("T"), "team"), F.lit("X"), F.lit("1"), elo, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("team") % 9).cast("int")), F.lit("1999-01-01"))
    header = spark.createDataFrame([("Rank,Club,Country,Level,Elo,From,To",), ("short,line",)], "line string")
    teams.select(line.alias("line")).union(header).write.text(path)
    return readers.rating_periods(spark, path)


@query("a9_ranking_pages", """
SELECT page_id, (i - 1)::INTEGER AS at_, regexp_extract(x, '<li><a href="/([^"]*)">([^<]*)</a></li>', 1) AS href, regexp_extract(x, '<li><a href="/([^"]*)">([^<]*)</a></li>', 2) AS label
FROM (SELECT page_id, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/[^"]*">[^<]*</a></li>') AS r FROM pages))""")
def ranking_pages(spark, d):
    return readers.ranking_rows(table(spark, d, "pages")).withColumnRenamed("at", "at_")


@query("a9_ranking_dimension", f"""
WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'FC ' ELSE '' END || c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN 'Club' || c_custkey END AS api, upper(n_name)[1:3] AS country, 1000 + c_custkey % 900 AS rating
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 17 <> 0),
k AS (SELECT *, regexp_replace(lower(c.name), '[^a-z0-9]', '', 'g') AS whole, regexp_replace(replace(lower(c.name), 'fc ', ''), '[^a-z0-9]', '', 'g') AS core FROM c),
i AS (SELECT unnest(list_distinct([whole, coalesce(lower(api), whole)])) AS key, 'exact' AS kind, name, api, country, rating FROM k
  UNION ALL SELECT unnest(list_distinct([core, CASE WHEN core = whole THEN whole ELSE core || 'fc' END])), 'loose', name, api, country, rating FROM k)
SELECT key, kind, name, api, country, rating::INTEGER AS rating FROM i""")
def ranking_dimension(spark, d):
    """Ranking tables written as pages of at most a hundred rows, some broken, and read into a dimension with its keys."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "FC ").otherwise(""), "c_name")
    link = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit('<a href="/Club'), "c_custkey", F.lit('">'))).otherwise("")
    cell = F.when(F.col("c_custkey") % 17 != 0, F.concat(F.lit('<td class="r"> '), (1000 + F.col("c_custkey") % 900).cast("string"), F.lit(" </td>"))).otherwise("<td>-</td>")
    row = F.concat(F.lit('<tr><td class="r">123</td>\n<td><a href="/'), F.upper(F.substring("n_name", 1, 3)), F.lit('">x</a>'), link, F.lit('<span class="Ast"> '), name, F.lit(" </span></td>"), cell, F.lit("</tr>"))
    row = F.when(F.col("c_custkey") % 17 != 0, row).otherwise(F.concat(F.lit("<tr><td>-</td><td>"), name, F.lit("</td></tr>")))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.expr("c_custkey div 100").alias("page_id"), "c_custkey", row.alias("row"))
    pages = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))), lambda x: x["row"]), "\n").alias("html"))
    return readers.club_keys(readers.enough(readers.ranking_clubs(pages), least=100))


@query("a10_weather_arrays", M_SQL + "SELECT div AS place, date, max(cards)::DOUBLE AS temp, min(hg)::DOUBLE AS wind FROM m GROUP BY div, date")
def weather_arrays(spark, d):
    day = matches(spark, d).groupBy(F.col("div").alias("place"), "date").agg(F.max("cards").cast("double").alias("temp"), F.min("hg").cast("double").alias("wind"))
    rows = day.groupBy("place").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("time"), "temp", "wind"))).alias("x"))
    return readers.daily(rows.select("place", F.to_json(F.struct(F.col("x.time").alias("time"), F.col("x.temp").alias("temp"), F.col("x.wind").alias("wind"))).alias("body")))


@query("a11_pruned_read", "SELECT l_returnflag, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1")
def pruned_read(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"))


PRICED = {3: (1.3, 5.5, 10.0), 2: (1.6, 4.0, 6.0), 1: (2.1, 3.4, 3.5)}


def priced_sql(k: int) -> str:
    """The k-th price that goes with a score."""
    won = " ".join(f"WHEN hg - ag {'>=' if by == 3 else '='} {by} THEN {t[k]}" for by, t in PRICED.items())
    lost = " ".join(f"WHEN ag - hg {'>=' if by == 3 else '='} {by} THEN {t[2 - k]}" for by, t in PRICED.items())
    return f"CASE {won} {lost} WHEN hg = 0 THEN {(2.8, 3.0, 2.8)[k]} ELSE {(2.5, 3.2, 2.9)[k]} END::DOUBLE"


@query("a12_labelled_rows", M_SQL + f"""
SELECT date, home, away, hg AS home_goals, ag AS away_goals, CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS result, (hg + ag > 2)::INTEGER AS over_2_5, hg + ag AS total_goals,
  {priced_sql(0)} AS odds_home, {priced_sql(1)} AS odds_draw, {priced_sql(2)} AS odds_away, stage AS tournament FROM m""")
def labelled_rows(spark, d):
    from ..functions.odds import priced_by_score, result

    hg, ag = F.col("hg"), F.col("ag")
    rows = matches(spark, d).withColumn("price", priced_by_score(hg, ag))
    return rows.select("date", "home", "away", hg.alias("home_goals"), ag.alias("away_goals"), result(hg, ag).alias("result"), (hg + ag > 2).cast("int").alias("over_2_5"), (hg + ag).alias("total_goals"),
                       F.col("price.h").alias("odds_home"), F.col("price.d").alias("odds_draw"), F.col("price.a").alias("odds_away"), F.col("stage").alias("tournament"))


@query("a13_first_write_wins", M_SQL + """
, n AS (SELECT div, home, away, date, match_id AS pid FROM m), l AS (SELECT DISTINCT div, home, away, date FROM m WHERE match_id % 4 = 0)
SELECT div, home, away, date, min(pid) AS pid FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.div = n.div AND l.home = n.home AND l.away = n.away AND l.date = n.date) GROUP BY ALL""")
def first_write_wins(spark, d):
    key = ["div", "home", "away", "date"]
    m = matches(spark, d)
    return readers.first_writes(m.where("match_id % 4 = 0").select(*key), m.select(*key, F.col("match_id").alias("pid")), key)


@query("a14_slate_json", M_SQL + """
SELECT date, count(*) FILTER (WHERE home % 7 <> 0 AND away % 7 <> 0) AS n, count(*) FILTER (WHERE home % 7 = 0 OR away % 7 = 0) AS unrated, count(*) FILTER (WHERE home % 7 <> 0 AND away % 7 <> 0 AND oh > 1.01) AS n_anchored,
  coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (WHERE home % 7 <> 0 AND away % 7 <> 0), '') AS competitions,
  coalesce(string_agg(match_id::VARCHAR, ',' ORDER BY match_id) FILTER (WHERE home % 7 <> 0 AND away % 7 <> 0), '') AS ids, coalesce(string_agg(match_id::VARCHAR, ',' ORDER BY match_id) FILTER (WHERE home % 7 = 0 OR away % 7 = 0), '') AS unrated_ids
FROM m GROUP BY date""")
def slate_json(spark, d):
    """The nested slate written as JSON and read back; every seventh team has no rating."""
    path = f"{shared(spark)}/slate"
    readers.sink_slate(matches(spark, d).withColumns({"anchored": F.col("oh") > 1.01, "rated": (F.col("home") % 7 != 0) & (F.col("away") % 7 != 0)}), path)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["match_id"].cast("string")), ",")
    return spark.read.schema(readers.SLATE).json(path).select("date", "n", "unrated", "n_anchored", F.array_join("competitions", ",").alias("competitions"), ids("matches").alias("ids"), ids("unrated_list").alias("unrated_ids"))


CONFIGS = {"rating": "m", "market": "k"}


def report_sql() -> str:
    rows = [("all", "matches", "count(*)::DOUBLE"), ("all", "always home", "avg((hg > ag)::INTEGER)"), ("all", "draws", "avg((hg = ag)::INTEGER)"), ("all", "over 2.5", "avg((hg + ag > 2)::INTEGER)"), ("all", "modal score", "(max(top) / count(*))::DOUBLE")]
    for name, p in CONFIGS.items():
        rows.append((name, "accuracy", f"avg((CASE WHEN {p}h >= {p}d AND {p}h >= {p}a THEN hg > ag WHEN {p}d >= {p}a THEN hg = ag ELSE hg < ag END)::INTEGER)"))
        rows.append((name, "logloss", f"avg(-ln(greatest(CASE WHEN hg > ag THEN {p}h WHEN hg = ag THEN {p}d ELSE {p}a END, 1e-9)))"))
    parts = [f"SELECT '{m}' AS metric, {r6_sql(v)} AS value, '{c}' AS config FROM p, t" for c, m, v in rows]
    parts += [f"SELECT '{m}', {r6_sql(v)}, 'bets' FROM bets" for m, v in (("bets", "count(*)::DOUBLE"), ("roi", "avg(roi)"), ("beat close", "avg((clv > 0)::INTEGER)"), ("clv", "avg(clv)"))]
    return ", t AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM p GROUP BY hg, ag)) " + " UNION ALL ".join(parts)


@query("a15_report", BETS_SQL + report_sql())
def report(spark, d):
    """The holdout and record report as (metric, value, config)."""
    p = probabilities(matches(spark, d))
    result, mean = odds.result(F.col("hg"), F.col("ag")), lambda c: F.avg(c.cast("int"))
    values = {("all", "matches"): F.count("*").cast("double"), ("all", "always home"): mean(result == "H"), ("all", "draws"): mean(result == "D"), ("all", "over 2.5"): mean(F.col("hg") + F.col("ag") > 2)}
    for name, s in CONFIGS.items():
        three = {o: F.col(f"{s}{o.lower()}") for o in "HDA"}
        own = F.when(result == "H", three["H"]).when(result == "D", three["D"]).otherwise(three["A"])
        values |= {(name, "accuracy"): mean(odds.first_max(three) == result), (name, "logloss"): F.avg(-F.log(F.greatest(own, F.lit(1e-9))))}
    modal = p.groupBy("hg", "ag").agg(F.count("*").alias("k")).agg(F.max("k").alias("top"), F.sum("k").alias("of")).select((F.col("top") / F.col("of")).alias("v"))
    staked = {("bets", "bets"): F.count("*").cast("double"), ("bets", "roi"): F.avg("roi"), ("bets", "beat close"): mean(F.col("clv") > 0), ("bets", "clv"): F.avg("clv")}

    def listed(one, keys):
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"v{k}").alias("value"), F.lit(c).alias("config")) for k, (c, m) in enumerate(keys)])
        return one.select(F.explode(rows).alias("x")).select("x.*")

    parts = [listed(p.agg(*[v.alias(f"v{k}") for k, v in enumerate(values.values())]), values), listed(modal.withColumnRenamed("v", "v0"), [("all", "modal score")]), listed(bets(p).agg(*[v.alias(f"v{k}") for k, v in enumerate(staked.values())]), staked)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("a16_engine_snapshot", M_SQL + "SELECT team, arg_max(div, date) AS div, max(date) AS last_date, count(*) AS n FROM tm GROUP BY team")
def engine_snapshot(spark, d):
    """Team state published with a fitted pipeline as one version, and read back."""
    return saved_engine(spark, d)[0].table("state")


def saved_engine(spark, d):
    """An engine's state and outcome pipeline, published together; the rows it scores and the pipeline that was saved."""
    from ..operators import models
    from ..operators.snapshot import Snapshots
    from ..sources.matches import team_matches
    from .models import frame

    m = stored(matches(spark, d))
    state = team_matches(m).groupBy("team").agg(F.max_by("div", F.struct("date", "match_id")).alias("div"), F.max("date").alias("last_date"), F.count("*").alias("n"))
    rows = frame(spark, d, m, ["match_id", "date", "label", *models.BASE])
    model = models.logistic(models.BASE).fit(models.split(rows)[0])
    snaps = Snapshots(spark, f"{shared(spark)}/engine")
    snaps.publish({"state": state}, {"outcome": model})
    return snaps, rows, model


@query("a16_reloaded_scores")
def reloaded_scores(spark, d):
    """Every match's probabilities by the pipeline that was saved and by the one that was loaded."""
    from ..operators import models

    snaps, rows, model = saved_engine(spark, d)
    scored = lambda m, p: models.three(m.transform(rows)).select("match_id", *[F.col(f"p{k}").alias(f"{p}{k}") for k in range(3)])
    return scored(model, "saved").join(scored(snaps.pipeline("outcome"), "loaded"), "match_id")


@query("a17_resumable_cache", M_SQL + "SELECT div, count(*) AS n FROM m GROUP BY div")
def resumable_cache(spark, d):
    """Divisions already in the cache are skipped; the missing ones are added as partitions of their own."""
    path = f"{shared(spark)}/cache"
    m = matches(spark, d).select("match_id", "div")
    m.where("div < 10").write.partitionBy("div").parquet(path)
    done = spark.read.parquet(path).select("div").distinct()
    m.join(done, "div", "left_anti").write.mode("append").partitionBy("div").parquet(path)
    return spark.read.parquet(path).groupBy("div").agg(F.count("*").alias("n"))


@query("a18_discovery", """
WITH n AS (SELECT c_name AS name, 'club' AS kind FROM customer UNION ALL SELECT n_name, 'international' FROM nation)
SELECT name, kind, (SELECT count(*) FROM n WHERE lower(name) LIKE '%r%') AS count FROM n WHERE lower(name) LIKE '%r%' ORDER BY name, kind LIMIT 20""")
def discovery(spark, d):
    """Clubs and national teams whose names hold a text, whatever their case; the first twenty, and how many there are."""
    every = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("club").alias("kind")).union(table(spark, d, "nation").select("n_name", F.lit("international")))
    return readers.discovered(every, "R", "all", 20)


@query("a18_discovery_of_kind", "SELECT n_name AS name, 'international' AS kind, (SELECT count(*) FROM nation WHERE lower(n_name) LIKE '%ion%') AS count FROM nation WHERE lower(n_name) LIKE '%ion%' ORDER BY name LIMIT 3")
def discovery_of_kind(spark, d):
    """The first three national teams that hold a text."""
    every = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("club").alias("kind")).union(table(spark, d, "nation").select("n_name", F.lit("international")))
    return readers.discovered(every, "ion", "international", 3)
