"""Attack and defence strengths, fitted anew for every month from the matches before it.

Goals depend on (scorer, opponent, at home) alone, so a match enters the weighted Poisson likelihood through two sums of its
cell: of weights and of weighted goals.  Weights halve with age, and age splits into a factor of the match and one of the month, so
running sums over months serve every month.  A fit then reads one row a cell, whatever the number of matches, and all
fits are groups of one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FITTED = "div int, month date, team long, attack double, defence double, home double, base double"


def newton(att: np.ndarray, dfn: np.ndarray, home: np.ndarray, weight: np.ndarray, goals: np.ndarray, teams: int, alpha: float, steps: int = 50) -> np.ndarray:
    """Attack of each team, defence of each team, home edge and intercept of least penalised mean deviance (the intercept is free)."""
    n = len(att)
    x = np.zeros((n, 2 * teams + 2))
    rows = np.arange(n)
    x[rows, att] = 1
    x[rows, teams + dfn] = 1
    x[:, -2], x[:, -1] = home, 1
    share = weight / weight.sum()
    mean = goals / weight
    penalty = np.r_[np.full(2 * teams + 1, alpha), 0.0]
    beta = np.zeros(2 * teams + 2)
    beta[-1] = np.log(max(float(share @ mean), 1e-6))
    for _ in range(steps):
        rate = np.exp(np.clip(x @ beta, -20, 20))
        slope = x.T @ (share * (rate - mean)) + penalty * beta
        curve = (x * (share * rate)[:, None]).T @ x + np.diag(penalty + 1e-12)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def monthly(m: DataFrame, months: DataFrame, half_life: float = 180.0, alpha: float = 0.008) -> DataFrame:
    """FITTED: strengths for each (div, month) of `months`, a month being its first day, from the matches before it."""
    side = lambda a, d, at, g: F.struct(F.col(a).alias("att"), F.col(d).alias("dfn"), F.lit(at).alias("at_home"), F.col(g).cast("double").alias("goals"))
    rows = m.where("hg is not null and ag is not null").select("div", "date", F.trunc("date", "month").alias("month"), F.explode(F.array(side("home", "away", 1.0, "hg"), side("away", "home", 0.0, "ag"))).alias("s")).select("div", "date", "month", "s.*")
    first = F.lit("1970-01-01").cast("date")
    rows = rows.withColumn("w", F.pow(F.lit(2.0), F.datediff("date", first) / half_life))
    cell = ["div", "att", "dfn", "at_home"]
    each = rows.groupBy(*cell, "month").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("goals")).alias("g"))
    so_far, ahead = W.partitionBy(*cell).orderBy("month"), W.partitionBy(*cell).orderBy("month")
    sums = each.select(*cell, "month", F.sum("w").over(so_far).alias("w"), F.sum("g").over(so_far).alias("g"), F.lead("month").over(ahead).alias("until"))
    bounds = months.agg(F.min("month").alias("low"), F.max("month").alias("high"))  # one row
    spans = sums.join(F.broadcast(bounds), how="cross").withColumns({"a": F.greatest(F.add_months("month", 1), "low"), "b": F.least(F.coalesce("until", "high"), "high")})
    serving = spans.where("a <= b").select(*cell, "w", "g", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(months.select("div", "month").distinct(), ["div", "month"], "left_semi")

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        teams, at = np.unique(np.r_[pdf["att"], pdf["dfn"]], return_inverse=True)
        n = len(pdf)
        w = pdf["w"].to_numpy()
        scale = w.max()
        beta = newton(at[:n], at[n:], pdf["at_home"].to_numpy(), w / scale, pdf["g"].to_numpy() / scale, len(teams), alpha)
        t = len(teams)
        return pd.DataFrame({"div": key[0], "month": key[1], "team": teams, "attack": beta[:t], "defence": beta[t : 2 * t], "home": beta[-2], "base": beta[-1]})

    return serving.groupBy("div", "month").applyInPandas(fit, FITTED)


def rates(m: DataFrame, fitted: DataFrame) -> DataFrame:
    """`m` with lam and mu by its month's strengths: a team not seen before has none; a division not seen before has null rates."""
    rows = m.withColumn("month", F.trunc("date", "month"))
    common = fitted.groupBy("div", "month").agg(F.first("home").alias("_home"), F.first("base").alias("_base"))
    rows = rows.join(common, ["div", "month"], "left")
    for s in ("home", "away"):
        own = fitted.select("div", "month", F.col("team").alias(s), F.col("attack").alias(f"{s}_att"), F.col("defence").alias(f"{s}_dfn"))
        rows = rows.join(own, ["div", "month", s], "left").fillna(0.0, [f"{s}_att", f"{s}_dfn"])
    clip = lambda c: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(6.0)), F.lit(0.1)))
    lam, mu = F.exp(F.col("_base") + F.col("_home") + F.col("home_att") + F.col("away_dfn")), F.exp(F.col("_base") + F.col("away_att") + F.col("home_dfn"))
    return rows.select(*m.columns, clip(lam).alias("lam"), clip(mu).alias("mu"))
