"""Queries C, and B15, B24, B25, B30: settlement, lookups, resolution, routing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import GENERIC, LOOSE_TOKENS, TRIMMED, candidates, loose_keys, squash
from ..operators import resolve, settle
from ..operators.ratings import expected_score
from ..sources.matches import matches, team_matches
from .expressions import token_set_sql
from .registry import M_SQL, query, r6_sql, rounded, table

CUT = "1998-01-01"


@query("c1_new_keys", M_SQL + f"SELECT match_id FROM m n WHERE NOT EXISTS (SELECT 1 FROM m h WHERE h.date < DATE '{CUT}' AND h.div = n.div AND h.home = n.home AND h.away = n.away)")
def new_keys(spark, d):
    m = matches(spark, d)
    return settle.new_only(m, m.where(F.col("date") < CUT), ["div", "home", "away"]).select("n.match_id")


@query("c2_placeholder_superseded", M_SQL + """
, s AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN 'full' ELSE 'placeholder' END AS source FROM m)
SELECT div, home, away, match_id, source FROM (SELECT *, row_number() OVER (PARTITION BY div, home, away ORDER BY (source = 'placeholder')::INTEGER, match_id) AS rn FROM s) WHERE rn = 1""")
def placeholder_superseded(spark, d):
    m = matches(spark, d).withColumn("source", F.when(F.col("match_id") % 3 == 0, "full").otherwise("placeholder"))
    return settle.superseded(m, ["div", "home", "away"]).select("div", "home", "away", "match_id", "source")


PENDING_SQL = ", pend AS (SELECT match_id AS pid, div, home, away, date + (match_id % 9 - 4)::INTEGER AS date FROM m)"


def pending(m):
    return m.select(F.col("match_id").alias("pid"), "div", "home", "away", F.date_add("date", (F.col("match_id") % 9 - 4).cast("int")).alias("date"))


@query("c3_settle_interval", M_SQL + PENDING_SQL + """
SELECT pid, match_id, played, hg, ag FROM (
  SELECT p.pid, r.match_id, r.date AS played, r.hg, r.ag, row_number() OVER (PARTITION BY p.pid ORDER BY r.date, r.match_id) AS rn
  FROM pend p JOIN m r ON p.div = r.div AND p.home = r.home AND p.away = r.away AND r.date BETWEEN p.date - 3 AND p.date + 3) WHERE rn = 1""")
def settle_interval(spark, d):
    m = matches(spark, d)
    return settle.settle_within(pending(m), m)


@query("c4_settle_by_id", M_SQL + """
, p AS (SELECT match_id AS id, date, hg, ag FROM m),
r AS (SELECT id, hg + 1 AS hg, ag, 0 AS rank FROM p WHERE id % 5 = 0 UNION ALL SELECT id, hg, ag, 1 FROM p WHERE id % 2 = 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS rn FROM r) WHERE rn = 1)
SELECT p.id, p.date, b.hg, b.ag, CASE WHEN b.hg IS NOT NULL THEN 'graded' WHEN DATE '2001-07-20' - p.date > 14 THEN 'dropped' ELSE 'pending' END AS status FROM p LEFT JOIN b USING (id)""")
def settle_by_id(spark, d):
    p = matches(spark, d).select(F.col("match_id").alias("id"), "date", "hg", "ag")
    manual = p.where("id % 5 = 0").select("id", (F.col("hg") + 1).alias("hg"), "ag")
    return settle.settle_by_id(p.select("id", "date"), manual, p.where("id % 2 = 0").select("id", "hg", "ag"), F.lit("2001-07-20").cast("date"))


@query("c5_dimension_join", M_SQL + f"""
, w AS (SELECT div, date, avg(cards) AS temp FROM m WHERE match_id % 3 = 0 GROUP BY 1, 2)
SELECT div, {r6_sql('avg((temp IS NOT NULL)::INTEGER)')} AS matched, {r6_sql('avg(temp)')} AS temp FROM m LEFT JOIN w USING (div, date) GROUP BY div""")
def dimension_join(spark, d):
    m = matches(spark, d)
    w = m.where("match_id % 3 = 0").groupBy("div", "date").agg(F.avg("cards").alias("temp"))
    return rounded(m.join(w, ["div", "date"], "left").groupBy("div").agg(F.avg(F.col("temp").isNotNull().cast("int")).alias("matched"), F.avg("temp").alias("temp")))


@query("c6_as_of_before", M_SQL + f"""
, v AS (SELECT home AS team, date, arg_max(cards, match_id)::DOUBLE AS val FROM m WHERE match_id % 2 = 0 GROUP BY 1, 2)
SELECT t.team, t.match_id, t.date, v.val AS val_before FROM tm t ASOF LEFT JOIN v ON t.team = v.team AND t.date > v.date""")
def as_of_before(spark, d):
    m = matches(spark, d)
    v = m.where("match_id % 2 = 0").select(F.col("home").alias("team"), "date", F.col("cards").cast("double").alias("val"), F.col("match_id").alias("ord"))
    return settle.as_of(team_matches(m).select("team", "date", "match_id"), v, "team", "date", "val").select("team", "match_id", "date", "val_before")


PERIODS_SQL = """
, per AS (SELECT div, date_trunc('year', date)::DATE AS start, (date_trunc('year', date) + INTERVAL 8 MONTH)::DATE AS finish, sum(hg)::BIGINT AS value FROM m GROUP BY ALL),
q AS (SELECT match_id AS qid, div, date AS day FROM m WHERE match_id % 4 = 0)
"""


@query("c7_validity_lookup", M_SQL + PERIODS_SQL + """
SELECT qid, div, day, arg_max(value, (CASE WHEN start <= day AND day <= finish THEN 100000 ELSE 0 END + (start - DATE '1990-01-01'))) AS value, bool_or(start <= day AND day <= finish) AS exact
FROM q JOIN per USING (div) GROUP BY ALL""")
def validity_lookup(spark, d):
    m = matches(spark, d)
    start = F.trunc("date", "year")
    per = m.groupBy("div", start.alias("start"), F.add_months(start, 8).alias("finish")).agg(F.sum("hg").alias("value"))
    return settle.valid_at(m.where("match_id % 4 = 0").select(F.col("match_id").alias("qid"), "div", F.col("date").alias("day")), per, "div")


def last_state(m):
    """(team, div, gf, last_date): each team's state after its last match before the cut."""
    tm = team_matches(m.where(F.col("date") < CUT))
    return tm.groupBy("team").agg(F.max_by("div", F.struct("date", "match_id")).alias("div"), F.avg("gf").alias("gf"), F.max("date").alias("last_date"))


STATE_SQL = f", st AS (SELECT team, arg_max(div, date) AS div, avg(gf) AS gf, max(date) AS last_date FROM tm WHERE date < DATE '{CUT}' AND team % 7 <> 0 GROUP BY team), fx AS (SELECT match_id, date, home, away FROM m WHERE date >= DATE '{CUT}')"


def known_state(m):
    return last_state(m).where("team % 7 <> 0")


@query("c8_both_sides", M_SQL + STATE_SQL + f"""
SELECT match_id, {r6_sql('coalesce(h.gf, 1.3)')} AS h_gf, {r6_sql('coalesce(a.gf, 1.3)')} AS a_gf, h.team IS NOT NULL AS h_known, a.team IS NOT NULL AS a_known
FROM fx LEFT JOIN st h ON h.team = home LEFT JOIN st a ON a.team = away""")
def both_sides(spark, d):
    m = matches(spark, d)
    fx = m.where(F.col("date") >= CUT).select("match_id", "date", "home", "away")
    return rounded(settle.both_sides(fx, known_state(m).select("team", "gf")).select("match_id", "h_gf", "a_gf", "h_known", "a_known"))


ROUTES_SQL = M_SQL + STATE_SQL + """
, r AS (SELECT match_id, CASE WHEN h.team IS NULL AND a.team IS NULL THEN 'both unknown' WHEN h.team IS NULL THEN 'home unknown' WHEN a.team IS NULL THEN 'away unknown' WHEN h.div <> a.div THEN 'different divisions' END AS reason,
  h.team IS NOT NULL AND a.team IS NOT NULL AS known FROM fx LEFT JOIN st h ON h.team = home LEFT JOIN st a ON a.team = away + 100 * (match_id % 9 = 0)::INTEGER)
"""


def routed(spark, d):
    m = matches(spark, d)
    fx = m.where(F.col("date") >= CUT).select("match_id", "home", (F.col("away") + F.when(F.col("match_id") % 9 == 0, 100).otherwise(0)).alias("away"))
    return settle.coverage(fx, known_state(m))


@query("b24_coverage", ROUTES_SQL + "SELECT match_id, reason IS NULL AS covered, reason FROM r")
def coverage(spark, d):
    return routed(spark, d).select("match_id", "covered", "reason")


@query("b25_route", ROUTES_SQL + "SELECT match_id, CASE WHEN reason IS NULL THEN 'core' WHEN known THEN 'external' ELSE 'unrated' END AS route FROM r")
def route(spark, d):
    return routed(spark, d).select("match_id", "route")


@query("b15_stale_decay", M_SQL + f"""
, st AS (SELECT team, arg_max(div, date) AS div, 1400 + 10.0::DOUBLE * (team % 100) AS elo, max(date) - (team % 40)::INTEGER * 25 AS last_date FROM tm GROUP BY team),
c AS (SELECT max(last_date) AS cutoff FROM st), a AS (SELECT div, avg(elo) AS anchor FROM st GROUP BY div),
x AS (SELECT team, elo, anchor, greatest(least(DATE '2001-09-01', cutoff) - last_date, 0) AS days_out FROM st JOIN a USING (div), c),
y AS (SELECT *, CASE WHEN days_out <= 150 THEN 1.0::DOUBLE ELSE pow(0.5::DOUBLE, (days_out - 150) / 550.0) END AS weight FROM x)
SELECT team, elo, days_out::INTEGER AS days_out, {r6_sql('weight')} AS weight, {r6_sql('anchor + (elo - anchor) * weight')} AS decayed FROM y""")
def stale_decay(spark, d):
    tm = team_matches(matches(spark, d))
    st = tm.groupBy("team").agg(F.max_by("div", F.struct("date", "match_id")).alias("div"), F.max("date").alias("last_date"))
    st = st.withColumns({"elo": 1400 + 10.0 * (F.col("team") % 100), "last_date": F.date_sub("last_date", (F.col("team") % 40 * 25).cast("int"))})
    return rounded(settle.decayed(st, F.lit("2001-09-01").cast("date")))


@query("b30_snapshot_guard", M_SQL + "SELECT match_id, CASE WHEN abs(date - DATE '1998-06-15') <= 21 THEN 1400 + home % 100 END AS rating, CASE WHEN abs(date - DATE '1998-06-15') > 21 THEN 'outside the snapshot window' END AS reject_reason FROM m")
def snapshot_guard(spark, d):
    near = F.abs(F.datediff("date", F.lit("1998-06-15").cast("date"))) <= 21
    return matches(spark, d).select("match_id", F.when(near, 1400 + F.col("home") % 100).alias("rating"), F.when(~near, "outside the snapshot window").alias("reject_reason"))


@query("c9_unordered_pairs", M_SQL + "SELECT least(home, away) AS lo, greatest(home, away) AS hi, count(*) AS n, min(date) AS first FROM m GROUP BY 1, 2")
def unordered_pairs(spark, d):
    return matches(spark, d).groupBy(F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")).agg(F.count("*").alias("n"), F.min("date").alias("first"))


TOKENS_SQL = token_set_sql("{x}").replace("{'", "{{'").replace("'}", "'}}")


@query("c10_token_containment", f"""
WITH k AS (SELECT p_partkey AS known_id, p_retailprice AS peak, {TOKENS_SQL.format(x='p_name')} AS u FROM part),
n AS (SELECT DISTINCT p_brand || ' ' || p_name AS name FROM part UNION SELECT DISTINCT p_type FROM part),
a AS (SELECT name, {TOKENS_SQL.format(x='name')} AS t FROM n)
SELECT name, known_id FROM (SELECT name, known_id, row_number() OVER (PARTITION BY name ORDER BY peak DESC, known_id) AS rn FROM a JOIN k ON len(t) > 0 AND len(u) > 0 AND (list_has_all(u, t) OR list_has_all(t, u))) WHERE rn = 1""")
def token_containment(spark, d):
    p = table(spark, d, "part")
    asked = p.select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).union(p.select("p_type")).distinct()
    return resolve.by_containment(asked, p.select(F.col("p_partkey").alias("known_id"), F.col("p_name").alias("known_name"), F.col("p_retailprice").alias("peak")))


def words_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


CORE_SQL = "list_filter(list_transform(regexp_split_to_array({x}, '[\\s\\-./]+'), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: t <> '' AND t NOT IN ({drop}))"
KEY_SQL = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def keys_sql(x: str) -> str:
    core = f"array_to_string({CORE_SQL.format(x=x, drop=words_sql(LOOSE_TOKENS))}, '')"
    return f"{KEY_SQL.format(x=x)} AS fullkey, CASE WHEN {core} = '' THEN {KEY_SQL.format(x=x)} ELSE {core} END AS core"


@query("c11_unique_or_refuse", f"""
WITH k AS (SELECT known_name, {keys_sql('known_name')} FROM (SELECT DISTINCT n_name AS known_name FROM nation)),
al AS (SELECT 'Country ' || n_nationkey AS alias, n_name AS known_name FROM nation),
asked AS (SELECT 'FC ' || n_name AS name, 0 AS pos, 'FC ' || n_name AS spelling FROM nation UNION SELECT 'Country ' || n_nationkey, 0, 'Country ' || n_nationkey FROM nation
  UNION SELECT n_name || ' Juniors', 0, n_name || ' Juniors' FROM nation UNION SELECT s_name, 0, s_name FROM supplier UNION SELECT s_name, 1, n_name || ' ' || (s_suppkey % 3) FROM supplier JOIN nation ON n_nationkey = s_nationkey),
x AS (SELECT *, {keys_sql('spelling')} FROM asked),
hits AS (SELECT name, 1 AS stage, pos, known_name FROM x JOIN al ON alias = spelling
  UNION ALL SELECT name, 2, pos, min(known_name) FROM x JOIN k ON k.fullkey = x.fullkey AND x.fullkey <> '' GROUP BY name, pos HAVING count(*) = 1
  UNION ALL SELECT name, 3, pos, min(known_name) FROM x JOIN k ON k.core = x.core AND x.core <> '' GROUP BY name, pos HAVING count(*) = 1
  UNION ALL SELECT name, 4, pos, min(known_name) FROM x JOIN k ON length(k.core) >= 4 AND x.core <> '' AND (contains(x.core, k.core) OR contains(k.core, x.core)) GROUP BY name, pos HAVING count(*) = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stage, pos, known_name) AS rn FROM hits) WHERE rn = 1)
SELECT a.name, known_name, stage FROM (SELECT DISTINCT name FROM asked) a LEFT JOIN best USING (name)""")
def unique_or_refuse(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    country = F.concat(F.lit("Country "), F.col("n_nationkey"))
    plain = n.select(F.explode(F.array(F.concat(F.lit("FC "), "n_name"), country, F.concat("n_name", F.lit(" Juniors")))).alias("name")).select("name", F.array("name").alias("spellings"))
    places = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("name"), F.array("s_name", F.concat("n_name", F.lit(" "), F.col("s_suppkey") % 3)).alias("spellings"))
    return resolve.unique_or_refuse(plain.union(places).distinct(), n.select(F.col("n_name").alias("known_name")), n.select(country.alias("alias"), F.col("n_name").alias("known_name")))


@query("c12_first_candidate", f"""
WITH asked AS (SELECT DISTINCT list_value('F.C. ' || p_name, p_name || ' SK', 'Sporting ' || p_name, p_brand, p_type || ' ' || p_name)[p_partkey % 5 + 1] AS name FROM part),
known AS (SELECT DISTINCT replace(p_name, ' ', '') AS known_name FROM part WHERE p_name < 'h' UNION SELECT DISTINCT p_type FROM part WHERE p_type < 'M' UNION SELECT split_part(p_name, ' ', 2) FROM part),
b AS (SELECT name, trim(regexp_replace(name, '[.'']', '', 'g')) AS base FROM asked),
p AS (SELECT *, list_filter(string_split(base, ' '), lambda t: t <> '') AS parts FROM b),
e AS (SELECT *, list_filter([{words_sql(TRIMMED)}], lambda t: t = lower(parts[1]) OR t = lower(parts[-1]))[-1] AS token FROM p),
t AS (SELECT *, CASE WHEN token IS NULL THEN base ELSE array_to_string(list_filter(parts, lambda t: lower(t) <> token), ' ') END AS short FROM e),
l AS (SELECT name, list_concat([replace(base, ' ', ''), base, replace(short, ' ', ''), short], CASE WHEN len(parts) > 1 THEN list_filter([parts[-1], parts[1]], lambda t: length(t) >= 4 AND lower(t) NOT IN ({words_sql(GENERIC)})) ELSE [] END) AS c FROM t),
u AS (SELECT name, list_filter(c, lambda v, i: v <> '' AND list_position(c, v) = i) AS c FROM l),
r AS (SELECT name, unnest(c) AS known_name, generate_subscripts(c, 1) - 1 AS pos FROM u)
SELECT name, known_name, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS rn FROM r JOIN known USING (known_name)) WHERE rn = 1""")
def first_candidate(spark, d):
    p = table(spark, d, "part")
    name = F.element_at(F.array(F.concat(F.lit("F.C. "), "p_name"), F.concat("p_name", F.lit(" SK")), F.concat(F.lit("Sporting "), "p_name"), F.col("p_brand"), F.concat_ws(" ", "p_type", "p_name")), (F.col("p_partkey") % 5 + 1).cast("int"))
    known = p.where("p_name < 'h'").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("known_name")).union(p.where("p_type < 'M'").select("p_type")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return resolve.first_candidate(p.select(name.alias("name")).distinct(), known.distinct(), candidates(F.col("name"))).withColumnRenamed("at", "pos")


@query("c13_region_preference", """
WITH known AS (SELECT s_suppkey AS known_id, 'club' || (s_suppkey % 40) AS key, n_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey),
asked AS (SELECT DISTINCT 'Club ' || (s_suppkey % 50) AS name FROM supplier UNION SELECT DISTINCT 'SK Club ' || (s_suppkey % 60) FROM supplier),
good AS (SELECT n_name FROM nation WHERE n_nationkey < 8),
g AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE region IN (SELECT n_name FROM good)) AS ng, min(known_id) AS anyone, min(known_id) FILTER (WHERE region IN (SELECT n_name FROM good)) AS one
  FROM asked JOIN known ON key = lower(replace(replace(name, 'SK ', ''), ' ', '')) GROUP BY name)
SELECT name, CASE WHEN n = 1 THEN anyone WHEN ng = 1 THEN one END AS known_id FROM asked LEFT JOIN g USING (name)""")
def region_preference(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    good = n.where("n_nationkey < 8").select(F.col("n_name").alias("region")).distinct()
    known = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("known_id"), F.concat(F.lit("club"), F.col("s_suppkey") % 40).alias("key"), F.col("n_name").alias("region"), loose_keys(F.concat(F.lit("Club "), F.col("s_suppkey") % 40)).alias("loose"))
    asked = s.select(F.explode(F.array(F.concat(F.lit("Club "), F.col("s_suppkey") % 50), F.concat(F.lit("SK Club "), F.col("s_suppkey") % 60))).alias("name")).distinct()
    return resolve.by_region(asked, known, good)


FUZZY_SQL = """
, f AS (SELECT match_id, date, 'T' || (home % 100) AS hk, 'T' || (away % 100) AS ak, div FROM m),
h AS (SELECT date, 'T' || (home % 10) AS hk, 'T' || (away % 10) AS ak FROM m WHERE match_id % 5 = 0)
"""


@query("c14_fuzzy_dedup", M_SQL + FUZZY_SQL + """
SELECT match_id FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.date = f.date AND (starts_with(f.hk, h.hk) OR starts_with(h.hk, f.hk)) AND (starts_with(f.ak, h.ak) OR starts_with(h.ak, f.ak)))""")
def fuzzy_dedup(spark, d):
    m = matches(spark, d)
    key = lambda c, k: F.concat(F.lit("T"), F.col(c) % k)
    f = m.select("match_id", "date", key("home", 100).alias("home_key"), key("away", 100).alias("away_key"))
    return resolve.not_alike(f, m.where("match_id % 5 = 0").select("date", key("home", 10).alias("home_key"), key("away", 10).alias("away_key"))).select("f.match_id")


@query("c15_exact_dedup", M_SQL + "SELECT match_id FROM m f WHERE NOT EXISTS (SELECT 1 FROM m h WHERE h.match_id % 5 = 0 AND h.date = f.date AND h.home = f.home AND h.away = f.away)")
def exact_dedup(spark, d):
    m = matches(spark, d)
    return m.join(m.where("match_id % 5 = 0").select("date", "home", "away"), ["date", "home", "away"], "left_anti").select("match_id")


@query("c16_round_robin", f"""
WITH t AS (SELECT n_nationkey AS k, n_name AS name, 1400.0::DOUBLE + 20 * n_nationkey AS elo FROM nation),
g AS (SELECT x.name AS a, y.name AS b, 1 / (1 + pow(10.0::DOUBLE, -(x.elo - y.elo) / 400)) AS e, 0.27 * exp(-abs(x.elo - y.elo) / 300) AS dr FROM t x JOIN t y ON x.k < y.k),
s AS (SELECT a AS name, 3 * e * (1 - dr) + dr AS pts, (e * (1 - dr) > 0.5)::INTEGER AS dom FROM g UNION ALL SELECT b, 3 * (1 - e) * (1 - dr) + dr, ((1 - e) * (1 - dr) > 0.5)::INTEGER FROM g)
SELECT name, {r6_sql('sum(pts)')} AS points, sum(dom)::BIGINT AS dominated, rank() OVER (ORDER BY round(sum(pts), 6) DESC)::INTEGER AS place FROM s GROUP BY name""")
def round_robin(spark, d):
    """Expected points of each contender against all others; contenders are a short list."""
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (1400.0 + 20 * F.col("n_nationkey")).alias("elo"))
    x, y = t.alias("x"), t.alias("y")
    gap = F.col("x.elo") - F.col("y.elo")
    e, dr = expected_score(gap), 0.27 * F.exp(-F.abs(gap) / 300)
    g = x.join(y, F.col("x.k") < F.col("y.k")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), (e * (1 - dr)).alias("pa"), dr.alias("dr"), ((1 - e) * (1 - dr)).alias("pb"))
    sides = g.select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("pa").alias("p"), F.col("dr")), F.struct(F.col("b").alias("name"), F.col("pb").alias("p"), F.col("dr")))).alias("s")).select("s.*")
    out = rounded(sides.groupBy("name").agg(F.sum(3 * F.col("p") + F.col("dr")).alias("points"), F.count_if(F.col("p") > 0.5).alias("dominated")))
    return out.withColumn("place", F.rank().over(W.orderBy(F.desc("points"))))  # a row a contender


@query("c17_job_grid", M_SQL + "SELECT div, strftime(day::DATE, '%Y-%m-%d') AS day FROM (SELECT DISTINCT div FROM m), generate_series(DATE '1999-01-01', DATE '1999-01-31', INTERVAL 1 DAY) AS g(day)")
def job_grid(spark, d):
    days = F.explode(F.sequence(F.lit("1999-01-01").cast("date"), F.lit("1999-01-31").cast("date")))
    return matches(spark, d).select("div").distinct().select("div", days.alias("day")).select("div", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("c18_aligned_by_key", M_SQL + f"SELECT match_id, div, {r6_sql('oh')} AS price FROM m WHERE match_id % 2 = 0")
def aligned_by_key(spark, d):
    m = matches(spark, d)
    return rounded(m.where("match_id % 2 = 0").select("match_id", "div").join(m.select("match_id", F.col("oh").alias("price")), "match_id"))


@query("c19_coordinate_reuse", "SELECT n_nationkey, n_nationkey % 4 AS coord, (SELECT count(*) FROM nation b WHERE b.n_nationkey % 4 = a.n_nationkey % 4) AS shared FROM nation a")
def coordinate_reuse(spark, d):
    """What is known of a coordinate is worked out once for each distinct one and joined back."""
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 4).alias("coord"))
    return n.join(n.groupBy("coord").agg(F.count("*").alias("shared")), "coord").select("n_nationkey", "coord", "shared")


@query("c20_covered_only", M_SQL + "SELECT match_id FROM m WHERE div IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def covered_only(spark, d):
    divs = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("div"))
    return matches(spark, d).join(divs, "div", "left_semi").select("match_id")


@query("c21_source_fallback", M_SQL + """
, q AS (SELECT DISTINCT home AS team, date FROM m), h AS (SELECT DISTINCT team, date, 1400 + team % 100 AS v FROM tm WHERE match_id % 2 = 0), s AS (SELECT DISTINCT team, 1300 + team % 100 AS v FROM tm WHERE team % 3 = 0)
SELECT q.team, q.date, coalesce(h.v, s.v) AS rating, CASE WHEN h.v IS NOT NULL THEN 'history' WHEN s.v IS NOT NULL THEN 'snapshot' END AS source FROM q LEFT JOIN h USING (team, date) LEFT JOIN s ON s.team = q.team""")
def source_fallback(spark, d):
    m = matches(spark, d)
    tm = team_matches(m)
    q = m.select(F.col("home").alias("team"), "date").distinct()
    h = tm.where("match_id % 2 = 0").select("team", "date", (1400 + F.col("team") % 100).alias("hv")).distinct()
    s = tm.where("team % 3 = 0").select("team", (1300 + F.col("team") % 100).alias("sv")).distinct()
    return q.join(h, ["team", "date"], "left").join(s, "team", "left").select("team", "date", F.coalesce("hv", "sv").alias("rating"), F.when(F.col("hv").isNotNull(), "history").when(F.col("sv").isNotNull(), "snapshot").alias("source"))


@query("c22_accumulated_record", M_SQL + """
, u AS (SELECT match_id, div, home, away, date, 0 AS batch FROM m WHERE match_id % 2 = 0 UNION ALL SELECT match_id, div, home, away, date, 1 FROM m)
SELECT div, home, away, date, match_id, batch FROM (SELECT *, row_number() OVER (PARTITION BY div, home, away, date ORDER BY batch, match_id) AS rn FROM u) WHERE rn = 1""")
def accumulated_record(spark, d):
    m = matches(spark, d).select("match_id", "div", "home", "away", "date")
    both = m.where("match_id % 2 = 0").withColumn("batch", F.lit(0)).unionByName(m.withColumn("batch", F.lit(1)))
    return settle.best_first(both, ["div", "home", "away", "date"], F.col("batch"), F.col("match_id")).select("div", "home", "away", "date", "match_id", "batch")
