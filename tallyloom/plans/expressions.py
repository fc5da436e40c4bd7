"""Queries B, H and I: projections and predicates, scalar functions, score distributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import calendar, names, odds
from ..operators import grid
from ..operators.ratings import expected_score, margin_multiplier
from ..sources.matches import matches
from .registry import M_SQL, query, r6, r6_sql, rounded, table

PRICES = ("oh", "od", "oa")


def trio(df, parts, *keep):
    return rounded(df.select(*keep, *[p.alias(n) for n, p in zip(("ph", "pd", "pa"), parts)]))


def probabilities(m):
    """A model's and the market's three-way probabilities for each match, from its prices and goals."""
    gap = (F.col("home") % 100 - F.col("away") % 100) * 40.0
    model = odds.three_way(expected_score(gap, 68.0), gap, 0.27, 300.0)
    market = odds.implied(*[F.col(c) for c in PRICES])
    return m.select("*", *[p.alias(n) for n, p in zip(("mh", "md", "ma"), model)], *[p.alias(n) for n, p in zip(("kh", "kd", "ka"), market)])


#: The same in SQL: mh.. the model's, kh.. the market's.
P_SQL = M_SQL + """
, g AS (SELECT *, ((home % 100) - (away % 100)) * 40.0::DOUBLE AS gap FROM m),
g2 AS (SELECT *, 1 / (1 + pow(10.0::DOUBLE, -(gap + 68.0) / 400)) AS e, 0.27 * exp(-abs(gap) / 300.0) AS dr FROM g),
p AS (SELECT *, e * (1 - dr) AS mh, dr AS md, (1 - e) * (1 - dr) AS ma,
  1 / oh / (1 / oh + 1 / od + 1 / oa) AS kh, 1 / od / (1 / oh + 1 / od + 1 / oa) AS kd, 1 / oa / (1 / oh + 1 / od + 1 / oa) AS ka FROM g2)
"""


@query("b1_first_valid", M_SQL + "SELECT match_id, coalesce(CASE WHEN ch > 1.01 THEN ch END, CASE WHEN oh > 1.01 THEN oh END) AS price FROM m")
def first_valid(spark, d):
    m = matches(spark, d)
    return m.select("match_id", odds.first_valid(m, ["ch", "absent", "oh"]).alias("price"))


@query("b2_first_whole_triple", M_SQL + """
SELECT match_id, CASE WHEN ch > 1 AND cd > 1 AND ca > 1 THEN ch WHEN oh > 1 AND od > 1 AND oa > 1 THEN oh END AS h,
  CASE WHEN ch > 1 AND cd > 1 AND ca > 1 THEN cd WHEN oh > 1 AND od > 1 AND oa > 1 THEN od END AS d,
  CASE WHEN ch > 1 AND cd > 1 AND ca > 1 THEN ca WHEN oh > 1 AND od > 1 AND oa > 1 THEN oa END AS a FROM m""")
def first_whole_triple(spark, d):
    return matches(spark, d).select("match_id", odds.first_whole_triple([("ch", "cd", "ca"), PRICES]).alias("x")).select("match_id", "x.*")


@query("b3_implied", P_SQL + f"SELECT match_id, {r6_sql('kh')} AS ph, {r6_sql('kd')} AS pd, {r6_sql('ka')} AS pa FROM p")
def implied(spark, d):
    return trio(matches(spark, d), odds.implied(*[F.col(c) for c in PRICES]), "match_id")


def pool_sql(w: str) -> str:
    mix = [f"pow(k{o}, {w}) * pow(m{o}, 1 - {w})" for o in "hda"]
    return ", ".join(f"{r6_sql(f'{x} / ({' + '.join(mix)})')} AS p{o}" for o, x in zip("hda", mix))


@query("b4_log_pool", P_SQL + f"SELECT match_id, {pool_sql('0.95::DOUBLE')} FROM p")
def log_pool(spark, d):
    p = probabilities(matches(spark, d))
    return trio(p, odds.pooled([F.col(c) for c in ("kh", "kd", "ka")], [F.col(c) for c in ("mh", "md", "ma")], 0.95), "match_id")


@query("b5_ensemble", P_SQL + "SELECT match_id, " + ", ".join(f"{r6_sql(f'CASE WHEN ch IS NULL THEN m{o} ELSE 0.8 * m{o} + 0.2 * k{o} END')} AS p{o}" for o in "hda") + " FROM p")
def ensemble(spark, d):
    p = probabilities(matches(spark, d))
    return trio(p, odds.ensemble([F.col(c) for c in ("mh", "md", "ma")], [F.when(F.col("ch").isNotNull(), F.col(c)) for c in ("kh", "kd", "ka")]), "match_id")


@query("b6_result_labels", M_SQL + "SELECT match_id, CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS result, (hg + ag > 2.5)::INTEGER AS over25, hg + ag AS total FROM m")
def result_labels(spark, d):
    return matches(spark, d).select("match_id", odds.result(F.col("hg"), F.col("ag")).alias("result"), (F.col("hg") + F.col("ag") > 2.5).cast("int").alias("over25"), (F.col("hg") + F.col("ag")).alias("total"))


def competition():
    return F.element_at(F.array(*map(F.lit, ("World Cup", "World Cup qualification", "Euro qualifier", "UEFA Euro", "Nations League", "Friendly", "Other Cup"))), (F.col("match_id") % 7 + 1).cast("int"))
COMPETITION_SQL = "['World Cup', 'World Cup qualification', 'Euro qualifier', 'UEFA Euro', 'Nations League', 'Friendly', 'Other Cup'][match_id % 7 + 1]"


@query("b7_tournament_weight", M_SQL + f"SELECT match_id, {COMPETITION_SQL} AS competition, [55, 35, 35, 45, 45, 18, 30][match_id % 7 + 1] AS k FROM m")
def tournament_weight(spark, d):
    return matches(spark, d).select("match_id", competition().alias("competition")).withColumn("k", odds.tournament_k(F.col("competition")))


@query("b8_division_weight", M_SQL + "SELECT match_id, CASE WHEN div IN (0, 3, 6, 9, 12) THEN 22 ELSE 20 END AS k FROM m")
def division_weight(spark, d):
    from .windows import k_of_division

    return matches(spark, d).select("match_id", k_of_division().alias("k"))


def stage():
    return F.element_at(F.array(*map(F.lit, ("World Cup Final", "World Cup SF", "World Cup QF", "World Cup R16", "World Cup Group", "Cup"))), (F.col("match_id") % 6 + 1).cast("int"))


@query("b9_stage_weight", M_SQL + "SELECT match_id, [50, 45, 45, 40, 35, 20][match_id % 6 + 1] AS k FROM m")
def stage_weight(spark, d):
    return matches(spark, d).select("match_id", odds.stage_k(stage()).alias("k"))


@query("b10_margin_multiplier", M_SQL + f"SELECT match_id, {r6_sql('CASE WHEN abs(hg - ag) <= 1 THEN 1.0::DOUBLE ELSE ln(abs(hg - ag) + 1) * 0.75 END')} AS margin FROM m")
def margin(spark, d):
    return rounded(matches(spark, d).select("match_id", margin_multiplier(F.abs(F.col("hg") - F.col("ag"))).alias("margin")))


@query("b11_expected_score", P_SQL + f"SELECT match_id, {r6_sql('1 / (1 + pow(10.0::DOUBLE, -(gap + CASE WHEN neutral THEN 0 ELSE 65 END) / 400))')} AS expected FROM p")
def expected(spark, d):
    gap = (F.col("home") % 100 - F.col("away") % 100) * 40.0
    return rounded(matches(spark, d).select("match_id", expected_score(gap, F.when(F.col("neutral"), 0).otherwise(65)).alias("expected")))


@query("b12_three_way", P_SQL + f"SELECT match_id, {r6_sql('mh')} AS ph, {r6_sql('md')} AS pd, {r6_sql('ma')} AS pa FROM p")
def three_way(spark, d):
    return trio(probabilities(matches(spark, d)), [F.col(c) for c in ("mh", "md", "ma")], "match_id")


@query("b13_synthetic_prices", M_SQL + """
, r AS (SELECT match_id, 1400.0::DOUBLE + home % 100 * 40 AS eh, 1400.0::DOUBLE + away % 100 * 40 AS ea FROM m),
q AS (SELECT *, 1 / (1 + pow(10.0::DOUBLE, (ea - eh - 60) / 400)) AS e, greatest(0.18::DOUBLE, 0.32::DOUBLE - abs(eh - ea) / 1500) AS dr FROM r)
SELECT match_id, round(1.08::DOUBLE / greatest(e * (1 - dr), 0.02), 2) AS ph, round(1.08::DOUBLE / greatest(dr, 0.05), 2) AS pd, round(1.08::DOUBLE / greatest((1 - e) * (1 - dr), 0.02), 2) AS pa FROM q""")
def synthetic_prices(spark, d):
    e = lambda t: 1400.0 + F.col(t) % 100 * 40
    return matches(spark, d).select("match_id", *[p.alias(n) for n, p in zip(("ph", "pd", "pa"), odds.priced(e("home"), e("away")))])


@query("b14_score_prices", M_SQL + """
SELECT match_id, CASE WHEN hg - ag >= 3 THEN 1.3 WHEN hg - ag = 2 THEN 1.6 WHEN hg - ag = 1 THEN 2.1 WHEN ag - hg >= 3 THEN 10.0 WHEN ag - hg = 2 THEN 6.0 WHEN ag - hg = 1 THEN 3.5 WHEN hg = 0 THEN 2.8 ELSE 2.5 END::DOUBLE AS h,
  CASE WHEN abs(hg - ag) >= 3 THEN 5.5 WHEN abs(hg - ag) = 2 THEN 4.0 WHEN abs(hg - ag) = 1 THEN 3.4 WHEN hg = 0 THEN 3.0 ELSE 3.2 END::DOUBLE AS d,
  CASE WHEN ag - hg >= 3 THEN 1.3 WHEN ag - hg = 2 THEN 1.6 WHEN ag - hg = 1 THEN 2.1 WHEN hg - ag >= 3 THEN 10.0 WHEN hg - ag = 2 THEN 6.0 WHEN hg - ag = 1 THEN 3.5 WHEN hg = 0 THEN 2.8 ELSE 2.9 END::DOUBLE AS a FROM m""")
def score_prices(spark, d):
    return matches(spark, d).select("match_id", odds.priced_by_score(F.col("hg"), F.col("ag")).alias("x")).select("match_id", "x.*")


@query("b16_double_chance", P_SQL + f"""
SELECT match_id, CASE WHEN kh + kd >= kh + ka AND kh + kd >= ka + kd THEN '1X' WHEN kh + ka >= ka + kd THEN '12' ELSE 'X2' END AS pick,
  {r6_sql('greatest(kh + kd, kh + ka, ka + kd)')} AS chance FROM p""")
def double_chance(spark, d):
    p = probabilities(matches(spark, d))
    three = {"1X": F.col("kh") + F.col("kd"), "12": F.col("kh") + F.col("ka"), "X2": F.col("ka") + F.col("kd")}
    return rounded(p.select("match_id", odds.first_max(three).alias("pick"), F.greatest(*three.values()).alias("chance")))


@query("b17_confidence_tier", P_SQL + """
SELECT match_id, CASE WHEN c >= 0.8 AND w >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'medium' ELSE 'low' END AS tier
FROM (SELECT match_id, greatest(kh + kd, kh + ka, ka + kd) AS c, 1 - (match_id % 20) / 100.0::DOUBLE AS w FROM p)""")
def confidence_tier(spark, d):
    p = probabilities(matches(spark, d))
    return p.select("match_id", odds.tier(F.greatest(F.col("kh") + F.col("kd"), F.col("kh") + F.col("ka"), F.col("ka") + F.col("kd")), 1 - (F.col("match_id") % 20) / F.lit(100.0)).alias("tier"))


PICK_SQL = "CASE WHEN mh >= md AND mh >= ma THEN 'H' WHEN md >= ma THEN 'D' ELSE 'A' END"
SIDE_SQL = "CASE WHEN mh - kh >= md - kd AND mh - kh >= ma - ka THEN 'H' WHEN md - kd >= ma - ka THEN 'D' ELSE 'A' END"


@query("b18_picks", P_SQL + f"SELECT match_id, {PICK_SQL} AS pick, {SIDE_SQL} AS side FROM p")
def picks(spark, d):
    return with_picks(probabilities(matches(spark, d))).select("match_id", "pick", "side")


def with_picks(p):
    return p.withColumns({"pick": odds.first_max({"H": F.col("mh"), "D": F.col("md"), "A": F.col("ma")}), "side": odds.first_max({o: F.col(f"m{o.lower()}") - F.col(f"k{o.lower()}") for o in "HDA"})})


def bets(p):
    """Value bets: the side with the largest edge if it is over 0.03 at an opening price of 1.30 or more; with roi and clv."""
    side = lambda o, k, price, close: F.struct((F.col(f"m{k}") - F.col(f"k{k}")).alias("edge"), F.lit(-"HDA".index(o)).alias("first"), F.lit(o).alias("side"), F.col(price).alias("price"), F.col(close).alias("close"))
    kept = [c for c in p.columns if c not in {"mh", "md", "ma", "kh", "kd", "ka", *PRICES, "ch", "cd", "ca"}]
    # one struct a side, of which the largest is the bet: each probability is named once, and the filter reads a generated row
    three = F.array(*[side(o, o.lower(), price, close) for o, price, close in zip("HDA", PRICES, ("ch", "cd", "ca"))])
    best = F.filter(F.array(F.array_max(three)), lambda x: (x["edge"] > 0.03) & (x["price"] >= 1.3))
    p = p.select(*kept, F.explode(best).alias("bet")).select(*kept, "bet.side", "bet.edge", "bet.price", "bet.close").withColumn("result", odds.result(F.col("hg"), F.col("ag")))
    return p.withColumns({"roi": F.when(F.col("side") == F.col("result"), F.col("price") - 1).otherwise(-1.0), "clv": F.when(F.col("close") > 1.01, F.col("price") / F.col("close") - 1)})


BETS_SQL = P_SQL + f"""
, s AS (SELECT *, {SIDE_SQL} AS side, {PICK_SQL} AS pick, CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS result FROM p),
s2 AS (SELECT *, CASE side WHEN 'H' THEN mh - kh WHEN 'D' THEN md - kd ELSE ma - ka END AS edge, CASE side WHEN 'H' THEN oh WHEN 'D' THEN od ELSE oa END AS price,
  CASE side WHEN 'H' THEN ch WHEN 'D' THEN cd ELSE ca END AS close FROM s),
bets AS (SELECT *, CASE WHEN side = result THEN price - 1 ELSE -1 END AS roi, CASE WHEN close > 1.01 THEN price / close - 1 END AS clv FROM s2 WHERE edge > 0.03 AND price >= 1.3)
"""


@query("b19_value_bets", BETS_SQL + f"SELECT match_id, side, {r6_sql('edge')} AS edge, {r6_sql('roi')} AS roi, {r6_sql('clv')} AS clv FROM bets")
def value_bets(spark, d):
    return rounded(bets(probabilities(matches(spark, d))).select("match_id", "side", "edge", "roi", "clv"))


@query("b20_value_edges", P_SQL + f"SELECT match_id, outcome, {r6_sql('edge')} AS edge FROM (SELECT match_id, 'H' AS outcome, mh - kh AS edge FROM p UNION ALL SELECT match_id, 'D', md - kd FROM p UNION ALL SELECT match_id, 'A', ma - ka FROM p) WHERE edge > 0.03")
def value_edges(spark, d):
    p = probabilities(matches(spark, d))
    three = F.array(*[F.struct(F.lit(o.upper()).alias("outcome"), (F.col(f"m{o}") - F.col(f"k{o}")).alias("edge")) for o in "hda"])
    return rounded(p.select("match_id", F.explode(F.filter(three, lambda x: x["edge"] > 0.03)).alias("x")).select("match_id", "x.*"))


@query("b21_fair_price", P_SQL + f"SELECT match_id, {r6_sql('1 / mh')} AS fair_h, {r6_sql('1 / md')} AS fair_d, {r6_sql('1 / ma')} AS fair_a FROM p")
def fair_price(spark, d):
    return rounded(probabilities(matches(spark, d)).select("match_id", *[(1 / F.col(f"m{o}")).alias(f"fair_{o}") for o in "hda"]))


@query("b22_clipped", M_SQL + f"SELECT match_id, {r6_sql('greatest(least((hg + 0.1::DOUBLE) * 2.5::DOUBLE, 6.0::DOUBLE), 0.15::DOUBLE)')} AS lam, greatest(least(cards * 3, 12), 1) AS cards FROM m")
def clipped(spark, d):
    return rounded(matches(spark, d).select("match_id", F.greatest(F.least((F.col("hg") + 0.1) * 2.5, F.lit(6.0)), F.lit(0.15)).alias("lam"), F.greatest(F.least(F.col("cards") * 3, F.lit(12)), F.lit(1)).alias("cards")))


@query("b23_median_imputed", M_SQL + f", x AS (SELECT median(ch) AS med FROM m) SELECT match_id, {r6_sql('ln(1 + coalesce(ch, med)) - ln(1 + oa)')} AS diff FROM m, x")
def median_imputed(spark, d):
    m = matches(spark, d)
    m = m.join(m.agg(F.median("ch").alias("med")), how="cross")  # one row
    return rounded(m.select("match_id", (F.log1p(F.coalesce("ch", "med")) - F.log1p("oa")).alias("diff")))


@query("b26_status_window", M_SQL + "SELECT match_id, date, div FROM m WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND div IN (0, 1, 2)")
def status_window(spark, d):
    return matches(spark, d).where("date between date'1997-03-01' and date'1997-03-31' and div in (0, 1, 2)").select("match_id", "date", "div")


@query("b27_validated", M_SQL + """
SELECT match_id, CASE WHEN match_id % 13 = 0 THEN 'bad date' WHEN NOT (oh > 1 AND od > 1 AND oa > 1) THEN 'bad price' END AS reject_reason FROM m""")
def validated(spark, d):
    text = F.when(F.col("match_id") % 13 == 0, "13.31.1999").otherwise(F.col("date").cast("string"))
    m = matches(spark, d).withColumn("written", text)
    return m.select("match_id", F.when(F.try_to_date("written", "yyyy-MM-dd").isNull(), "bad date").when(~((F.col("oh") > 1) & (F.col("od") > 1) & (F.col("oa") > 1)), "bad price").alias("reject_reason"))


@query("b28_ordinal_codes", "SELECT n_name AS name, (row_number() OVER (ORDER BY n_name) - 1)::INTEGER AS code FROM (SELECT DISTINCT n_name FROM nation)")
def ordinal_codes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name")).distinct()
    return n.select("name", (F.dense_rank().over(W.orderBy("name")) - 1).alias("code"))  # a row a category


@query("b29_settlement", P_SQL + f"""
SELECT match_id, CASE WHEN hg > ag THEN 0 WHEN hg = ag THEN 1 ELSE 2 END AS outcome, ({PICK_SQL} = CASE WHEN hg > ag THEN 'H' WHEN hg = ag THEN 'D' ELSE 'A' END)::INTEGER AS hit_1x2,
  (hg = 1 AND ag = 1)::INTEGER AS hit_score, ((mh > 0.5) = (hg + ag > 2))::INTEGER AS hit_ou,
  {r6_sql('-ln(greatest(CASE WHEN hg > ag THEN mh WHEN hg = ag THEN md ELSE ma END, 1e-9))')} AS logloss FROM p""")
def settlement(spark, d):
    return rounded(settled(probabilities(matches(spark, d))).select("match_id", "outcome", "hit_1x2", "hit_score", "hit_ou", "logloss"))


def settled(p):
    p = with_picks(p).withColumn("result", odds.result(F.col("hg"), F.col("ag")))
    own = F.when(F.col("result") == "H", F.col("mh")).when(F.col("result") == "D", F.col("md")).otherwise(F.col("ma"))
    return p.withColumns({
        "outcome": F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2), "hit_1x2": (F.col("pick") == F.col("result")).cast("int"),
        "hit_score": ((F.col("hg") == 1) & (F.col("ag") == 1)).cast("int"), "hit_ou": ((F.col("mh") > 0.5) == (F.col("hg") + F.col("ag") > 2)).cast("int"),
        "logloss": -F.log(F.greatest(own, F.lit(1e-9)))})


# -- H ------------------------------------------------------------------------------------------------------------------


@query("h1_season_code", M_SQL + """
SELECT match_id, lpad((y % 100)::VARCHAR, 2, '0') || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS season
FROM (SELECT match_id, year(date) - (month(date) < 7)::INTEGER AS y FROM m)""")
def season_code(spark, d):
    return matches(spark, d).select("match_id", calendar.season_code(F.col("date")).alias("season"))


@query("h2_dual_dates", M_SQL + "SELECT match_id, CASE WHEN match_id % 3 = 2 THEN NULL ELSE date END AS date FROM m")
def dual_dates(spark, d):
    written = F.when(F.col("match_id") % 3 == 0, F.date_format("date", "dd/MM/yyyy")).when(F.col("match_id") % 3 == 1, F.date_format("date", "dd/MM/yy")).otherwise(F.date_format("date", "yyyy.dd.MM"))
    return matches(spark, d).select("match_id", calendar.day_month_year(written).alias("date"))


@query("h3_month_hour", "SELECT event_id, month(ts)::INTEGER AS month, CASE WHEN event_id % 5 <> 0 THEN hour(ts)::INTEGER END AS hour FROM events")
def month_hour(spark, d):
    written = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "HH:mm")).otherwise("TBC")
    return table(spark, d, "events").select("event_id", F.month("ts").alias("month"), calendar.kickoff_hour(written).alias("hour"))


@query("h4_ascii_fold", """
SELECT doc_id, regexp_replace(strip_accents(replace(replace(text, 'ß', 'ss'), 'ø', 'o')), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def ascii_fold(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", names.ascii_fold(F.col("text")).alias("folded"))


KEYS_SQL = """
WITH t AS (SELECT p_partkey, p_name, list_filter(list_transform(regexp_split_to_array(p_name, '[\\s\\-./]+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS tok FROM part),
c AS (SELECT *, list_filter(tok, lambda x: x NOT IN ('fc', 'ac', 'as', 'sc')) AS core0 FROM t)
"""


@query("h5_name_keys", KEYS_SQL + """
SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS squash, array_to_string(CASE WHEN len(core0) > 0 THEN core0 ELSE tok END, '') AS core, array_to_string(list_sort(tok), '') AS sorted FROM c""")
def name_keys(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_name")
    return p.select("p_partkey", names.squash(n).alias("squash"), names.core_key(n).alias("core"), names.sorted_key(n).alias("sorted"))


#: Names that sources write differently: each part takes one of the aliases or abbreviations before its own name.
ODD_NAMES = [*names.ALIASES, *[f"{short.title()} Utd of the" for short in names.EXPANSIONS]]
ODD_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in ODD_NAMES) + f"][p_partkey % {len(ODD_NAMES)} + 1]"


def odd_name():
    return F.element_at(F.array(*map(F.lit, ODD_NAMES)), (F.col("p_partkey") % len(ODD_NAMES) + 1).cast("int"))


def map_sql(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in entries.items()) + "}"


def token_set_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in names.STOP_WORDS)
    kept = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({stop}))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda t: coalesce({map_sql(names.EXPANSIONS)}[t], t))))"


@query("h6_token_set", f"SELECT p_partkey, array_to_string({token_set_sql(ODD_SQL + " || ' ' || p_name")}, ' ') AS tokens FROM part")
def token_set(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(names.token_set(F.concat_ws(" ", odd_name(), "p_name")), " ").alias("tokens"))


@query("h7_alias_lookup", f"""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE {ODD_SQL} END AS name FROM part)
SELECT p_partkey, name, coalesce({map_sql(names.ALIASES)}[name], name) AS full_name FROM n""")
def alias_lookup(spark, d):
    """Names by the alias table; a name that has no alias is its own."""
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(odd_name())
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("full_name", names.aliased(F.col("name")))


ROOT = "CASE WHEN {x} <= 9 OR {x} IN ({m}) THEN {x} ELSE list_sum(list_transform(string_split({x}::VARCHAR, ''), lambda c: c::BIGINT)) END"


def root_sql(x: str, masters: bool, rounds: int = 2) -> str:
    for _ in range(rounds):
        x = ROOT.format(x=f"({x})", m="11, 22, 33" if masters else "-1")
    return f"({x})::INTEGER"


@query("h8_letter_values", f"""
WITH n AS (SELECT s_name AS name, list_filter(string_split(regexp_replace(upper(s_name), '[^A-Z]', '', 'g'), ''), lambda x: x <> '') AS l FROM (SELECT DISTINCT s_name FROM supplier UNION SELECT n_name FROM nation)),
v AS (SELECT name, len(l) AS namelen, list_sum(list_transform(l, lambda x: (ascii(x) - 65) % 9 + 1)) AS py,
  list_sum(list_transform(l, lambda x: [1, 2, 3, 4, 5, 8, 3, 5, 1, 1, 2, 3, 4, 5, 7, 8, 1, 2, 3, 4, 6, 6, 6, 5, 1, 7][ascii(x) - 64])) AS ch,
  coalesce(list_sum(list_transform(list_filter(l, lambda x: x IN ('A', 'E', 'I', 'O', 'U')), lambda x: (ascii(x) - 65) % 9 + 1)), 0) AS so FROM n)
SELECT name, {root_sql('py', True)} AS pyth, {root_sql('ch', False)} AS chald, {root_sql('so', True)} AS soul, {root_sql('py', True)} AS express,
  ({root_sql('py', True)} IN (11, 22, 33))::INTEGER AS master, namelen::INTEGER AS namelen FROM v""")
def letter_values(spark, d):
    both = table(spark, d, "supplier").select(F.col("s_name").alias("name")).union(table(spark, d, "nation").select("n_name")).distinct()
    return both.select("name", *[c.cast("int").alias(k) for k, c in names.letter_values(F.col("name")).items()])


@query("h9_day_attributes", f"""
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
x AS (SELECT day, year(day) AS y, list_sum(list_transform(string_split(strftime(day, '%Y%m%d'), ''), lambda c: c::BIGINT)) AS n FROM d)
SELECT day, [1, 4, 2, 5, 3, 6, 0][isodow(day)]::INTEGER AS day_ruler,
  list_min([abs(day - make_date(y, 3, 20)), abs(day - make_date(y, 6, 21)), abs(day - make_date(y, 9, 22)), abs(day - make_date(y, 12, 21))])::INTEGER AS eq_sol_prox,
  {root_sql('n', True)} AS univ_day, ({root_sql('n', True)} IN (11, 22, 33))::INTEGER AS univ_master, ((y - 4) % 12)::INTEGER AS cn_animal, (((y - 4) % 10) // 2)::INTEGER AS cn_element FROM x""")
def day_attributes(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", *[c.cast("int").alias(k) for k, c in calendar.day_attributes(F.col("day")).items()])


@query("h10_pair_features", M_SQL + "SELECT match_id, (home % 100) - (away % 100) AS eso_diff, ((home % 9) = (away % 9))::INTEGER AS eso_match FROM m")
def pair_features(spark, d):
    return matches(spark, d).select("match_id", (F.col("home") % 100 - F.col("away") % 100).alias("eso_diff"), (F.col("home") % 9 == F.col("away") % 9).cast("int").alias("eso_match"))


LON_SQL = """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day, o_orderdate::DATE - DATE '1995-01-01' AS t FROM orders),
lon AS (SELECT day, body, ((base + t * speed + 4000 * (t % 97)) % 36000 / 100.0)::DOUBLE AS lon FROM d, (VALUES ('a', 100, 98), ('b', 9000, 55), ('c', 20000, 31)) AS b(body, base, speed)),
r AS (SELECT *, lag(lon) OVER (PARTITION BY body ORDER BY day) AS prev FROM lon)
"""


@query("h11_almanac", LON_SQL + """
, s AS (SELECT x.day, count(*) FILTER (WHERE list_min(list_transform([0, 60, 90, 120, 180], lambda a: abs(least(abs(x.lon - y.lon), 360 - abs(x.lon - y.lon)) - a))) <= 8) AS aspects FROM lon x JOIN lon y ON x.day = y.day AND x.body < y.body GROUP BY 1)
SELECT day, body, floor(lon / 30)::BIGINT AS sign, floor(lon / (360 / 27.0::DOUBLE))::BIGINT AS mansion, (prev IS NOT NULL AND ((lon - prev + 540) % 360) - 180 < 0)::INTEGER AS retro, aspects FROM r JOIN s USING (day)""")
def almanac(spark, d):
    """Signs, mansions, backward motion and aspects from a table of longitudes (here made from the order dates)."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("t", F.datediff("day", F.lit("1995-01-01").cast("date")))
    bodies = F.explode(F.array(*[F.struct(F.lit(b).alias("body"), F.lit(x).alias("base"), F.lit(v).alias("speed")) for b, x, v in (("a", 100, 98), ("b", 9000, 55), ("c", 20000, 31))]))
    lon = days.select("day", "t", bodies.alias("b")).select("day", "b.body", ((F.col("b.base") + F.col("t") * F.col("b.speed") + 4000 * (F.col("t") % 97)) % 36000 / F.lit(100.0)).alias("lon"))
    step = F.pmod(F.col("lon") - F.lag("lon").over(W.partitionBy("body").orderBy("day")) + 540, F.lit(360.0)) - 180
    own = lon.select("day", "body", F.floor(F.col("lon") / 30).alias("sign"), F.floor(F.col("lon") / (360 / 27)).alias("mansion"), F.coalesce((step < 0).cast("int"), F.lit(0)).alias("retro"))
    gap = F.abs(F.col("x.lon") - F.col("y.lon"))
    gap = F.least(gap, 360 - gap)
    near = F.array_min(F.transform(F.array(*[F.lit(float(a)) for a in (0, 60, 90, 120, 180)]), lambda a: F.abs(gap - a))) <= 8
    aspects = lon.alias("x").join(lon.alias("y"), (F.col("x.day") == F.col("y.day")) & (F.col("x.body") < F.col("y.body"))).groupBy(F.col("x.day").alias("day")).agg(F.count_if(near).alias("aspects"))
    return own.join(aspects, "day")


@query("h12_decay", P_SQL + f"SELECT match_id, {r6_sql('pow(0.5::DOUBLE, greatest(match_id % 900 - 150, 0) / 550.0)')} AS weight, {r6_sql('ln(1 + oh)')} AS l1, {r6_sql('exp(-oh)')} AS e FROM p")
def decay(spark, d):
    return rounded(matches(spark, d).select("match_id", odds.stale_weight(F.col("match_id") % 900).alias("weight"), F.log1p("oh").alias("l1"), F.exp(-F.col("oh")).alias("e")))


@query("h13_score_text", M_SQL + "SELECT match_id, hg::VARCHAR || '-' || ag::VARCHAR AS score, round(100.0 * hg / 4)::BIGINT::VARCHAR || '%' AS share FROM m")
def score_text(spark, d):
    return matches(spark, d).select("match_id", F.format_string("%d-%d", "hg", "ag").alias("score"), F.format_string("%d%%", F.round(100.0 * F.col("hg") / 4).cast("long")).alias("share"))


# -- I ------------------------------------------------------------------------------------------------------------------

#: Goal rates, and cells of the grid, of every match.
GRID_SQL = P_SQL + """
, rates AS (SELECT match_id, kh, kd, ka, mh, md, ma, gap, hg, ag, 0.6 + (home % 7) * 0.25::DOUBLE AS lam, 0.5 + (away % 5) * 0.3::DOUBLE AS mu FROM p),
raw AS (SELECT r.*, i, j, exp(-lam + i * ln(lam)) / factorial(i::INTEGER) * exp(-mu + j * ln(mu)) / factorial(j::INTEGER) AS q,
  CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * -0.05 WHEN i = 0 AND j = 1 THEN 1 + lam * -0.05 WHEN i = 1 AND j = 0 THEN 1 + mu * -0.05 WHEN i = 1 AND j = 1 THEN 1.05 ELSE 1 END::DOUBLE AS t
  FROM rates r, range(9) AS a(i), range(9) AS b(j)),
grid AS (SELECT *, q * t / sum(q * t) OVER (PARTITION BY match_id) AS p FROM raw),
sides AS (SELECT match_id, sum(p) FILTER (WHERE i > j) AS sh, sum(p) FILTER (WHERE i = j) AS sd, sum(p) FILTER (WHERE i < j) AS sa FROM grid GROUP BY match_id),
proj0 AS (SELECT g.*, g.p * CASE WHEN i > j THEN mh / sh WHEN i = j THEN md / sd ELSE ma / sa END AS pp0 FROM grid g JOIN sides USING (match_id)),
proj AS (SELECT *, pp0 / sum(pp0) OVER (PARTITION BY match_id) AS pp FROM proj0)
"""


def rated(spark, d):
    p = probabilities(matches(spark, d))
    return p.withColumns({"lam": 0.6 + (F.col("home") % 7) * 0.25, "mu": 0.5 + (F.col("away") % 5) * 0.3})


def gridded(spark, d):
    return rated(spark, d).withColumn("grid", grid.cells(F.col("lam"), F.col("mu"), F.lit(-0.05)))


def exploded(df):
    return grid.score_rows(df, "match_id").select("match_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), grid.rounded_chance(F.col("p")).alias("p"))


@query("i1_poisson_grid", GRID_SQL + f"SELECT match_id, i, j, {r6_sql('q / sum(q) OVER (PARTITION BY match_id)')} AS p FROM raw")
def poisson_grid(spark, d):
    return exploded(rated(spark, d).withColumn("grid", grid.cells(F.col("lam"), F.col("mu"))))


@query("i2_low_score_grid", GRID_SQL + f"SELECT match_id, i, j, {r6_sql('p')} AS p FROM grid")
def low_score_grid(spark, d):
    return exploded(gridded(spark, d))


@query("i3_region_sums", GRID_SQL + f"SELECT match_id, {r6_sql('sh')} AS h, {r6_sql('sd')} AS d, {r6_sql('sa')} AS a FROM sides")
def region_sums(spark, d):
    return rounded(gridded(spark, d).select("match_id", *[c.alias(k) for k, c in grid.outcome(F.col("grid")).items()]))


def projected(spark, d):
    return gridded(spark, d).withColumn("grid", grid.projected(F.col("grid"), {"h": F.col("mh"), "d": F.col("md"), "a": F.col("ma")}))


@query("i4_project_grid", GRID_SQL + f"SELECT match_id, i, j, {r6_sql('pp')} AS p FROM proj")
def project_grid(spark, d):
    return exploded(projected(spark, d))


@query("i5_over25", GRID_SQL + f"SELECT match_id, {r6_sql('sum(pp) FILTER (WHERE i + j > 2)')} AS over25 FROM proj GROUP BY match_id")
def over25(spark, d):
    return rounded(projected(spark, d).select("match_id", grid.over(F.col("grid")).alias("over25")))


@query("i6_modal_score", GRID_SQL + "SELECT match_id, i, j FROM (SELECT match_id, i, j, row_number() OVER (PARTITION BY match_id ORDER BY round(pp, 12) DESC, i, j) AS rn FROM proj) WHERE rn = 1")
def modal_score(spark, d):
    return projected(spark, d).select("match_id", F.get(grid.likeliest(1, 12), 0).alias("c")).select("match_id", F.col("c.i").cast("long").alias("i"), F.col("c.j").cast("long").alias("j"))


@query("e19_top_scores", GRID_SQL + f"SELECT match_id, rn::INTEGER AS rank, i, j, {r6_sql('pp')} AS p FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(pp, 12) DESC, i, j) AS rn FROM proj) WHERE rn <= 6")
def top_scores(spark, d):
    out = projected(spark, d).select("match_id", grid.likeliest(6, 12).alias("top")).select("match_id", "top", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("at"))
    out = out.select("match_id", "at", F.get("top", F.col("at")).alias("c"))
    return rounded(out.select("match_id", (F.col("at") + 1).alias("rank"), F.col("c.i").cast("long").alias("i"), F.col("c.j").cast("long").alias("j"), "c.p"))


@query("i7_over_lines", M_SQL + ", r AS (SELECT match_id, 1.0::DOUBLE + cards * 0.7 AS lam FROM m) SELECT match_id, " + ", ".join(f"{r6_sql(f'1 - list_sum(list_transform(range({k}), lambda k: exp(-lam + k * ln(lam)) / factorial(k::INTEGER)))')} AS over{k - 1}5" for k in (4, 5, 6)) + " FROM r")
def over_lines(spark, d):
    lam = 1.0 + F.col("cards") * 0.7
    return rounded(matches(spark, d).select("match_id", *[grid.over_line(lam, x).alias(f"over{int(x)}5") for x in (3.5, 4.5, 5.5)]))


@query("i8_rho_likelihood", P_SQL + f"""
, rates AS (SELECT hg, ag, 0.6 + (home % 7) * 0.25::DOUBLE AS lam, 0.5 + (away % 5) * 0.3::DOUBLE AS mu FROM p WHERE hg <= 1 AND ag <= 1),
x AS (SELECT *, (-20 + 2 * k) / 100.0::DOUBLE AS rho FROM rates, range(21) AS r(k))
SELECT rho, {r6_sql("sum(-ln(greatest(CASE WHEN hg = 0 AND ag = 0 THEN 1 - lam * mu * rho WHEN hg = 0 THEN 1 + lam * rho WHEN ag = 0 THEN 1 + mu * rho ELSE 1 - rho END, 1e-6)))")} AS nll FROM x GROUP BY rho""")
def rho_likelihood(spark, d):
    m = matches(spark, d).withColumns({"lam": 0.6 + (F.col("home") % 7) * 0.25, "mu": 0.5 + (F.col("away") % 5) * 0.3})
    return rounded(grid.rho_likelihood(m, "lam", "mu", [(-20 + 2 * k) / 100 for k in range(21)]))


@query("i9_supremacy_goals", P_SQL + f"""
, s AS (SELECT match_id, (gap + 65) / 190 AS sup FROM p), t AS (SELECT *, 2.6 + least(0.55 * abs(sup), 0.9) AS total FROM s)
SELECT match_id, {r6_sql('greatest(least((total + sup) / 2, 5.0), 0.2)')} AS lam, {r6_sql('greatest(least((total - sup) / 2, 5.0), 0.2)')} AS mu FROM t""")
def supremacy_goals(spark, d):
    lam, mu = grid.from_gap((F.col("home") % 100 - F.col("away") % 100) * 40.0)
    return rounded(matches(spark, d).select("match_id", lam.alias("lam"), mu.alias("mu")))


@query("i10_independent_grid", GRID_SQL + f"""
, big AS (SELECT match_id, i, j, exp(-lam + i * ln(lam)) / factorial(i::INTEGER) * exp(-mu + j * ln(mu)) / factorial(j::INTEGER) AS q FROM rates, range(11) AS a(i), range(11) AS b(j))
SELECT match_id, {r6_sql('sum(q) FILTER (WHERE i > j) / sum(q)')} AS h, {r6_sql('sum(q) FILTER (WHERE i = j) / sum(q)')} AS d, {r6_sql('sum(q) FILTER (WHERE i < j) / sum(q)')} AS a FROM big GROUP BY match_id""")
def independent_grid(spark, d):
    g = rated(spark, d).withColumn("grid", grid.cells(F.col("lam"), F.col("mu"), size=11))
    return rounded(g.select("match_id", *[c.alias(k) for k, c in grid.outcome(F.col("grid")).items()]))


@query("i11_consistency_audit", GRID_SQL + "SELECT match_id FROM proj GROUP BY match_id HAVING abs(sum(pp) - 1) > 1e-9")
def consistency_audit(spark, d):
    """Matches whose grid does not add up to one or to its three-way probabilities: none."""
    rows = grid.score_rows(projected(spark, d), "match_id", "mh", "md")
    of = lambda keep: F.sum(F.when(keep, F.col("p")).otherwise(0.0))
    sums = rows.groupBy("match_id").agg(F.sum("p").alias("all"), (of(F.col("i") > F.col("j")) - F.first("mh")).alias("h"), (of(F.col("i") == F.col("j")) - F.first("md")).alias("d"))
    return sums.where((F.abs(F.col("all") - 1) > 1e-9) | (F.abs("h") > 1e-9) | (F.abs("d") > 1e-9)).select("match_id")
