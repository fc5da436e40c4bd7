"""Prices and probabilities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("h", "d", "a")


def first_valid(df: DataFrame, candidates: list[str], above: float = 1.01) -> Column:
    """The first candidate above the threshold; columns that do not exist are skipped."""
    have = [F.when(F.expr(f"try_cast(`{c}` as double)") > above, F.expr(f"try_cast(`{c}` as double)")) for c in candidates if c in df.columns]
    return F.coalesce(*have, F.lit(None).cast("double"))


def first_whole_triple(triples: list[tuple[str, str, str]], above: float = 1.0) -> Column:
    """The first triple of prices that are all above the threshold, as a struct (h, d, a)."""
    def whole(t):
        return F.when(reduce(lambda x, y: x & y, [F.col(c) > above for c in t]), F.struct(*[F.col(c).cast("double").alias(o) for c, o in zip(t, OUTCOMES)]))

    return F.coalesce(*[whole(t) for t in triples])


def implied(oh: Column, od: Column, oa: Column) -> tuple[Column, Column, Column]:
    """Probabilities with the margin taken out."""
    total = 1 / oh + 1 / od + 1 / oa
    return 1 / oh / total, 1 / od / total, 1 / oa / total


def pooled(market, model, weight: float) -> tuple[Column, ...]:
    """Log-opinion pool: market^w * model^(1-w), normalised."""
    mixed = [F.pow(a, F.lit(weight)) * F.pow(b, F.lit(1 - weight)) for a, b in zip(market, model)]
    total = sum(mixed[1:], mixed[0])
    return tuple(x / total for x in mixed)


def ensemble(first, second, share: float = 0.2) -> tuple[Column, ...]:
    """(1 - share) * first + share * second; the first where there is no second."""
    return tuple(F.coalesce((1 - share) * a + share * b, a) for a, b in zip(first, second))


def three_way(exp_h: Column, gap: Column, a: float, c: float) -> tuple[Column, Column, Column]:
    """Home, draw and away from an expected score and a rating gap; the draw falls as a * exp(-|gap| / c)."""
    draw = a * F.exp(-F.abs(gap) / c)
    return exp_h * (1 - draw), draw, (1 - exp_h) * (1 - draw)


def first_max(values: dict[str, Column]) -> Column:
    """The key of the largest value; of the first one on ties."""
    best = F.greatest(*values.values())
    out = F.when(F.lit(False), F.lit(""))
    for key, v in values.items():
        out = out.when(v == best, F.lit(key))
    return out


def tier(prob: Column, weight: Column) -> Column:
    """high from 0.80, medium from 0.70, else low; a rating weight under 0.9 makes high medium."""
    return F.when((prob >= 0.8) & (weight >= 0.9), "high").when(prob >= 0.7, "medium").otherwise("low")


def stale_weight(days: Column, grace: int = 150, half_life: int = 550) -> Column:
    return F.when(days.isNull() | (days <= grace), 1.0).otherwise(F.pow(F.lit(0.5), (days - grace) / half_life))


def result(hg: Column, ag: Column) -> Column:
    return F.when(hg > ag, "H").when(hg < ag, "A").otherwise("D")


def tournament_k(name: Column) -> Column:
    """Importance of an international match by words in its competition's name; the first rule that fits wins."""
    t = F.lower(name)
    final = ~t.contains("qual")
    return (F.when(t.contains("world cup") & final, 55).when(t.contains("euro") & final, 45)
            .when(t.rlike("copa|nations league|gold cup|asian cup|african cup"), 45).when(t.rlike("qualification|qualifier"), 35)
            .when(t.contains("friendly"), 18).otherwise(30))


def stage_k(stage: Column) -> Column:
    """Importance of a match by its stage; the first rule that fits wins."""
    return (F.when(stage.contains("Final"), 50).when(stage.contains("SF") | stage.contains("QF"), 45).when(stage.contains("R16"), 40)
            .when(stage.contains("World Cup"), 35).otherwise(20))


def priced(home_elo: Column, away_elo: Column) -> tuple[Column, Column, Column]:
    """Synthetic prices from ratings alone: home edge 60, draw floor 0.18, margin 1.08, floors under each probability."""
    e = 1 / (1 + F.pow(F.lit(10.0), (away_elo - home_elo - 60) / 400))
    draw = F.greatest(F.lit(0.18), 0.32 - F.abs(home_elo - away_elo) / 1500)
    chances = ((e * (1 - draw), 0.02), (draw, 0.05), ((1 - e) * (1 - draw), 0.02))
    return tuple(F.round(1.08 / F.greatest(p, F.lit(floor)), 2) for p, floor in chances)


def priced_by_score(hg: Column, ag: Column) -> Column:
    """Prices (h, d, a) made up from the final score.  They leak the result: for labelled history only, never as features."""
    def triple(h, d, a):
        return F.struct(F.lit(h).alias("h"), F.lit(d).alias("d"), F.lit(a).alias("a"))

    win = {3: (1.3, 5.5, 10.0), 2: (1.6, 4.0, 6.0), 1: (2.1, 3.4, 3.5)}
    by = hg - ag
    return (F.when(by >= 3, triple(*win[3])).when(by == 2, triple(*win[2])).when(by == 1, triple(*win[1]))
            .when(by <= -3, triple(*win[3][::-1])).when(by == -2, triple(*win[2][::-1])).when(by == -1, triple(*win[1][::-1]))
            .when(hg + ag == 0, triple(2.8, 3.0, 2.8)).otherwise(triple(2.5, 3.2, 2.9)))
