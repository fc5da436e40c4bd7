"""The flagship: matches -> sequential ratings -> three-way probabilities -> score grid -> metrics by division."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds
from ..operators import grid
from ..operators.metrics import brier
from ..sources.matches import matches
from .registry import query, r6_sql, rounded
from .windows import K_DIV, MARGIN, club_ratings, replay_sql


@query("flagship_by_division", replay_sql(f"{K_DIV} * {MARGIN}") + f"""
, p0 AS (SELECT m.*, ex, eh - ea AS gap, 0.27 * exp(-abs(eh - ea) / 300.0) AS dr FROM rated JOIN m USING (match_id)),
p AS (SELECT *, ex * (1 - dr) AS ph, dr AS pd, (1 - ex) * (1 - dr) AS pa, (gap + 65) / 190 AS sup FROM p0),
r AS (SELECT *, greatest(least((2.6 + least(0.55 * abs(sup), 0.9) + sup) / 2, 5.0), 0.2) AS lam, greatest(least((2.6 + least(0.55 * abs(sup), 0.9) - sup) / 2, 5.0), 0.2) AS mu FROM p),
c AS (SELECT match_id, i, j, exp(-lam + i * ln(lam)) / factorial(i::INTEGER) * exp(-mu + j * ln(mu)) / factorial(j::INTEGER) AS q FROM r, range(9) AS a(i), range(9) AS b(j)),
o AS (SELECT match_id, sum(q) FILTER (WHERE i + j > 2) / sum(q) AS over25 FROM c GROUP BY match_id)
SELECT div, count(*) AS n, {r6_sql("avg((CASE WHEN ph >= pd AND ph >= pa THEN hg > ag WHEN pd >= pa THEN hg = ag ELSE hg < ag END)::INTEGER)")} AS accuracy,
  {r6_sql("avg(-ln(greatest(CASE WHEN hg > ag THEN ph WHEN hg = ag THEN pd ELSE pa END, 1e-9)))")} AS logloss, {r6_sql("avg(pow(over25 - (hg + ag > 2)::INTEGER, 2))")} AS over_brier
FROM r JOIN o USING (match_id) GROUP BY div""")
def by_division(spark, d):
    rows = club_ratings(spark, d).join(matches(spark, d).select("match_id", "div", "hg", "ag"), "match_id")
    gap = F.col("elo_h") - F.col("elo_a")
    lam, mu = grid.from_gap(gap)
    rows = rows.withColumns({k: c for k, c in zip(("ph", "pd", "pa"), odds.three_way(F.col("exp_h"), gap, 0.27, 300.0))}).withColumns({"lam": lam, "mu": mu})
    result = odds.result(F.col("hg"), F.col("ag"))
    own = F.when(result == "H", F.col("ph")).when(result == "D", F.col("pd")).otherwise(F.col("pa"))
    pick = odds.first_max({"H": F.col("ph"), "D": F.col("pd"), "A": F.col("pa")})
    over = grid.over(grid.cells(F.col("lam"), F.col("mu")))
    rows = rows.select("div", (pick == result).cast("int").alias("hit"), (-F.log(F.greatest(own, F.lit(1e-9)))).alias("loss"), over.alias("over25"), (F.col("hg") + F.col("ag") > 2).alias("was_over"))
    return rounded(rows.groupBy("div").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("loss").alias("logloss"), brier(F.col("over25"), F.col("was_over")).alias("over_brier")))
