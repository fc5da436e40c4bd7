"""Queries K: streams over the tables, drained, and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds
from ..operators import settle
from ..sources.matches import matches
from ..sources.storage import stored
from ..streaming import flows
from ..streaming.rating_state import RatingState
from .expressions import P_SQL, probabilities
from .registry import M_SQL, query, r6_sql, rounded, table
from .windows import K_DIV, MARGIN, k_of_division, replay_sql, weight


@query("k1_stream_ingest", M_SQL + "SELECT DISTINCT div, home, away, date FROM m n WHERE NOT EXISTS (SELECT 1 FROM m h WHERE h.date < DATE '1998-01-01' AND h.div = n.div AND h.home = n.home AND h.away = n.away AND h.date = n.date)")
def stream_ingest(spark, d):
    key = ["div", "home", "away", "date"]
    m = matches(spark, d).select(*key, F.col("date").cast("timestamp").alias("ts"))
    stream = flows.source(spark, m, order="ts")
    return flows.drained(flows.new_keys(stream, [*key, "ts"], "ts", "1 day", m.where("date < '1998-01-01'").select(*key, "ts"))).select(*key)


@query("k2_stream_ratings", replay_sql(f"{K_DIV} * {MARGIN}") + f"SELECT match_id, {r6_sql('eh')} AS elo_h, {r6_sql('ea')} AS elo_a FROM rated")
def stream_ratings(spark, d):
    """Ratings kept up by a stream in which every fiftieth match arrives a year late; the last rating of a match counts."""
    score = F.when(F.col("hg") > F.col("ag"), 1.0).when(F.col("hg") == F.col("ag"), 0.5).otherwise(0.0)
    arrival = F.date_add("date", F.when(F.col("match_id") % 50 == 0, 365).otherwise(0))
    m = matches(spark, d).select("match_id", "date", "home", "away", score.alias("score"), weight(k_of_division()).cast("double").alias("weight"), arrival.alias("arrival"))
    state = RatingState(spark, flows.shared(spark))
    stream = flows.source(spark, m, order="arrival")
    q = stream.writeStream.option("checkpointLocation", f"{state.base}/checkpoint").trigger(availableNow=True).foreachBatch(state.refresh).start()
    q.awaitTermination()
    return rounded(state.ratings())


@query("k3_stream_first_write", M_SQL + "SELECT DISTINCT div, home, away, date FROM m")
def stream_first_write(spark, d):
    key = ["div", "home", "away", "date"]
    m = matches(spark, d).select(*key, F.col("date").cast("timestamp").alias("ts"))
    return flows.drained(flows.first_in_window(flows.source(spark, m, order="ts"), key, "ts", "30 days")).select(*key)


PREDICTIONS = "SELECT match_id AS pid, home, away, date + (match_id % 9 - 4)::INTEGER AS date FROM m WHERE match_id % 3 = 0"


def both_streams(spark, d):
    m = stored(matches(spark, d).select("match_id", "date", "home", "away", "hg", "ag"))  # both streams are written from it
    p = m.where("match_id % 3 = 0").select(F.col("match_id").alias("pid"), "home", "away", F.date_add("date", (F.col("match_id") % 9 - 4).cast("int")).cast("timestamp").alias("p_ts"))
    r = m.select("match_id", "home", "away", F.col("date").cast("timestamp").alias("r_ts"), "hg", "ag")
    return flows.source(spark, p, order="p_ts"), flows.source(spark, r, order="r_ts")


@query("k4_stream_settle", M_SQL + f", p AS ({PREDICTIONS}) SELECT pid, match_id, hg, ag FROM p JOIN m ON p.home = m.home AND p.away = m.away AND m.date BETWEEN p.date - 3 AND p.date + 3")
def stream_settle(spark, d):
    return flows.drained(flows.settled(*both_streams(spark, d)).select("p.pid", "r.match_id", "r.hg", "r.ag"))


@query("k5_stream_expiry", M_SQL + f"""
, p AS ({PREDICTIONS}), s AS (SELECT DISTINCT pid FROM p JOIN m ON p.home = m.home AND p.away = m.away AND m.date BETWEEN p.date - 3 AND p.date + 3), c AS (SELECT max(date) AS today FROM m)
SELECT p.pid, CASE WHEN s.pid IS NOT NULL THEN 'graded' WHEN today - p.date > 14 THEN 'dropped' ELSE 'pending' END AS status FROM p LEFT JOIN s USING (pid), c""")
def stream_expiry(spark, d):
    """Predictions settled by the stream, dropped by it after 14 days without a result, or, as it holds them still, pending."""
    p, r = both_streams(spark, d)
    done = flows.drained(flows.settled(p, r, expiry=14.5).select("p.pid", F.col("r.match_id").isNotNull().alias("hit"))).groupBy("pid").agg(F.max("hit").alias("hit"))
    asked = matches(spark, d).where("match_id % 3 = 0").select(F.col("match_id").alias("pid"))
    return asked.join(done, "pid", "left").select("pid", F.when(F.col("hit"), "graded").when(~F.col("hit"), "dropped").otherwise("pending").alias("status"))


@query("k6_stream_supersede", M_SQL + """
, s AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN 'full' ELSE 'placeholder' END AS source FROM m)
SELECT div, home, away, match_id, source FROM (SELECT *, row_number() OVER (PARTITION BY div, home, away ORDER BY (source = 'placeholder')::INTEGER, match_id) AS rn FROM s) WHERE rn = 1""")
def stream_supersede(spark, d):
    """Each batch adds what it has; a full row replaces a placeholder when the table is read."""
    key = ["div", "home", "away"]
    m = matches(spark, d).select(*key, "match_id", F.when(F.col("match_id") % 3 == 0, "full").otherwise("placeholder").alias("source"))
    merge = lambda rows: settle.superseded(rows, key)
    return merge(flows.drained(flows.source(spark, m), batch=flows.upserts(merge)).drop("v"))


@query("k7_stream_rollup", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, {r6_sql('sum(value)')} AS total FROM events GROUP BY 1, 2")
def stream_rollup(spark, d):
    e = flows.source(spark, table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), order="ts", end="ts")
    out = flows.tumbling(e, "1 day", F.count("*").alias("n"), F.sum("value").alias("total"), keys=("event_type",))
    return rounded(flows.drained(out).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total"))


@query("k7_live_metrics", P_SQL + f"""
SELECT div, date AS day, count(*) AS n, {r6_sql("avg((CASE WHEN mh >= md AND mh >= ma THEN hg > ag WHEN md >= ma THEN hg = ag ELSE hg < ag END)::INTEGER)")} AS accuracy,
  {r6_sql("avg(-ln(greatest(CASE WHEN hg > ag THEN mh WHEN hg = ag THEN md ELSE ma END, 1e-9)))")} AS logloss,
  {r6_sql("avg(CASE WHEN ch > 1.01 THEN CASE WHEN mh >= md AND mh >= ma THEN oh / ch WHEN md >= ma THEN od / cd ELSE oa / ca END - 1 END)")} AS clv
FROM p GROUP BY div, date""")
def live_metrics(spark, d):
    """Accuracy, log-loss and closing-line value of each division's day, written when the day has closed."""
    m = probabilities(matches(spark, d)).select("div", F.col("date").cast("timestamp").alias("ts"), "hg", "ag", "mh", "md", "ma", "oh", "od", "oa", "ch", "cd", "ca")
    s = flows.source(spark, m, order="ts", end="ts")
    result, pick = odds.result(F.col("hg"), F.col("ag")), odds.first_max({"H": F.col("mh"), "D": F.col("md"), "A": F.col("ma")})
    by = lambda of, cols: F.when(of == "H", F.col(cols[0])).when(of == "D", F.col(cols[1])).otherwise(F.col(cols[2]))
    s = s.select("ts", "div", (pick == result).cast("int").alias("hit"), (-F.log(F.greatest(by(result, ("mh", "md", "ma")), F.lit(1e-9)))).alias("loss"),
                 F.when(F.col("ch") > 1.01, by(pick, ("oh", "od", "oa")) / by(pick, ("ch", "cd", "ca")) - 1).alias("clv"))
    out = flows.tumbling(s, "1 day", F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("loss").alias("logloss"), F.avg("clv").alias("clv"), keys=("div",))
    return rounded(flows.drained(out).select("div", F.to_date("w.start").alias("day"), "n", "accuracy", "logloss", "clv"))


@query("k8_sliding_slate", "SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL (k) DAY AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM events, range(7) AS r(k) GROUP BY 1")
def sliding_slate(spark, d):
    """Events and users of each window of seven days that begins on a day."""
    e = flows.source(spark, table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), order="ts", end="ts")
    out = flows.drained(flows.distinct_in_windows(e, "7 days", "1 day", "user_id"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.col("items").alias("users"))


@query("k9_stream_stale", "SELECT user_id, max(ts) AS last_seen, date_diff('day', max(ts)::DATE, (SELECT max(ts) FROM events)::DATE) AS days_out FROM events GROUP BY user_id")
def stream_stale(spark, d):
    """Days since each key's last event, at the end of the data: the last of the spells that the stream has closed."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    spells = flows.drained(flows.stale(flows.source(spark, events, order="ts", end="ts"), "user_id", "7 days"))
    last = spells.where("user_id is not null").groupBy("user_id").agg(F.max("last_seen").alias("last_seen"))
    cutoff = events.agg(F.max("ts").alias("cutoff"))  # one row
    return last.join(cutoff, how="cross").select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.datediff("cutoff", "last_seen").cast("long").alias("days_out"))


@query("k9_stale_spells", """
WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events)
SELECT user_id, ts AS last_seen, count(*) AS n FROM e WHERE following IS NULL OR following - ts >= INTERVAL 7 DAY GROUP BY user_id, ts""")
def stale_spells(spark, d):
    """Every time that a key fell silent for seven days."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    spells = flows.drained(flows.stale(flows.source(spark, events, order="ts", end="ts"), "user_id", "7 days"))
    return spells.where("user_id is not null").groupBy("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen")).agg(F.count("*").alias("n"))
