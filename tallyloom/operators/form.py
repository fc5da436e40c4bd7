"""Leak-free features of a team's earlier matches.  One window specification serves all, so Spark sorts each team once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_team():
    return W.partitionBy("team").orderBy("date", "match_id")


def by_pair():
    return W.partitionBy("lo", "hi").orderBy("date", "match_id")


def before(c: Column | str, n: int, spec=None, prior: float | None = None) -> Column:
    """Mean over the n rows before this one; what there is of them; the prior (or null) when there is none."""
    mean = F.avg(c).over((spec or by_team()).rowsBetween(-n, -1))
    return mean if prior is None else F.coalesce(mean, F.lit(prior))


def rolling_form(tm: DataFrame, goals_prior: float = 1.3, form_prior: float = 0.5) -> DataFrame:
    """gf5, ga5, gf10, ga10 and form5 (points / 3) of each team before each match."""
    return tm.select("team", "match_id", *[before(x, n, prior=goals_prior).alias(f"{x}{n}") for x in ("gf", "ga") for n in (5, 10)], before(F.col("pts") / 3, 5, prior=form_prior).alias("form5"))


def rest(unseen: int = 7, cap: int = 60) -> Column:
    """Days since the team's last match."""
    return F.least(F.coalesce(F.datediff("date", F.lag("date").over(by_team())), F.lit(unseen)), F.lit(cap))


def rest_days(tm: DataFrame, unseen: int = 7, cap: int = 60) -> DataFrame:
    return tm.select("team", "match_id", rest(unseen, cap).alias("rest"))


def sides(tm: DataFrame, windows: dict[str, Column]) -> DataFrame:
    """(match_id, h_.., a_..): windows of both teams of each match.  Teams are sorted once for all of them, and the two narrow
    rows of a match meet by its id, so no wide row is exchanged for each side."""
    own = tm.where("team is not null").select("match_id", "is_home", *[c.alias(k) for k, c in windows.items()])
    both = own.groupBy("match_id").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("is_home") == home, F.col(k))).alias(f"{p}_{k}") for p, home in (("h", True), ("a", False)) for k in windows])
    return both.where("_n = 2").drop("_n")


def head_to_head(m: DataFrame, home_view: bool = False, prior: float = 0.5) -> DataFrame:
    """Mean of earlier results of the pair, seen from the smaller key; from the home side only if asked."""
    pair = m.select("match_id", "date", "home", F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi"), F.when(F.col("hg") == F.col("ag"), 0.5).when((F.col("hg") > F.col("ag")) == (F.col("home") < F.col("away")), 1.0).otherwise(0.0).alias("score"))
    mean = F.coalesce(F.avg("score").over(by_pair().rowsBetween(W.unboundedPreceding, -1)), F.lit(prior))
    return pair.select("match_id", (F.when(F.col("home") == F.col("lo"), mean).otherwise(1 - mean) if home_view else mean).alias("h2h"))


def shots_form(tm: DataFrame, n: int = 10, prior: float = 4.4) -> DataFrame:
    """Shots on target for and against; goals stand in where shots are missing."""
    sf, sa = F.coalesce("sf", "gf"), F.coalesce("sa", "ga")
    return tm.select("team", "match_id", before(sf, n, prior=prior).alias("sot_for"), before(sa, n, prior=prior).alias("sot_against")).withColumn("dominance", F.col("sot_for") - F.col("sot_against"))


def wide_shots(tm: DataFrame) -> DataFrame:
    sf, sa = F.coalesce("sf", "gf"), F.coalesce("sa", "ga")
    out = tm.select("team", "match_id", *[before(c, n, prior=4.4).alias(f"{k}{n}") for k, c in (("sf", sf), ("sa", sa)) for n in (5, 10)], before("gf", 10, prior=1.3).alias("gf10"))
    return out.withColumn("over", F.col("gf10") - 0.29 * F.col("sf10"))


def cards_form(tm: DataFrame) -> DataFrame:
    return tm.select("team", "match_id", before("cards", 5).alias("cards5"), before("cards", 10).alias("cards10"))


def referee_form(m: DataFrame, n: int = 40, chunk: int = 10_000) -> DataFrame:
    """A referee's mean cards over up to n earlier matches and their number; matches without a referee have neither.

    Few referees have many matches, so a referee is no unit of work: matches are numbered within a day and shifted by the
    days before, and windows run over chunks of `chunk` matches, each with the last n of the chunk before as its context.
    """
    rows = m.where("referee is not null").select("match_id", "date", "referee", "cards")
    days = rows.groupBy("referee", "date").agg(F.count("*").alias("k"))
    starts = days.select("referee", "date", (F.sum("k").over(W.partitionBy("referee").orderBy("date")) - F.col("k")).alias("start"))  # a row a referee and day
    placed = rows.join(starts, ["referee", "date"]).withColumn("ref_n", F.col("start") + F.row_number().over(W.partitionBy("referee", "date").orderBy("match_id")) - 1)
    own = F.expr(f"ref_n div {chunk}")
    parts = F.when(F.col("ref_n") % chunk >= chunk - n, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.select("match_id", "referee", "cards", "ref_n", own.alias("own"), F.explode(parts).alias("part"))
    seen = spread.withColumn("ref_avg", before("cards", n, W.partitionBy("referee", "part").orderBy("ref_n")))
    named = seen.where("part = own").select("match_id", "ref_avg", F.col("ref_n").cast("long").alias("ref_n"))
    return named.unionByName(m.where("referee is null").select("match_id", F.lit(None).cast("double").alias("ref_avg"), F.lit(0).cast("long").alias("ref_n")))


def trend(n: int) -> Column:
    """Change of the rating after a match over the last n matches (n - 1 steps); 0 with fewer."""
    return F.coalesce(F.lag("elo", 1).over(by_team()) - F.lag("elo", n).over(by_team()), F.lit(0.0))


def group_totals(moves: DataFrame, span: Column | None = None) -> DataFrame:
    """Point-in-time totals by group when members (member, grp, value, ts, id) move between groups or change value.

    Each row adds its value to its group, and takes the member's former value from the former group.  Where `span`, a
    coarser ts such as its day, is given, spans are summed first, so a running total stays within a span of a group.
    """
    own = W.partitionBy("member").orderBy("ts", "id")
    prior = moves.select("*", F.lag("grp").over(own).alias("old_grp"), F.lag("value").over(own).alias("old_value"))
    stays = F.col("old_grp") == F.col("grp")
    deltas = F.array(F.struct(F.col("grp"), F.when(stays, F.col("value") - F.col("old_value")).otherwise(F.col("value")).alias("delta"), F.lit(1).alias("part")), F.struct(F.col("old_grp").alias("grp"), (-F.col("old_value")).alias("delta"), F.lit(0).alias("part")))
    rows = prior.select("ts", "id", F.explode(deltas).alias("d"), stays.alias("stays")).where("d.grp is not null and not (d.part = 0 and stays)").select("ts", "id", "d.*")
    rows = rows.withColumn("span", F.struct((F.lit(0) if span is None else span).alias("of")))  # a struct is never null
    spans = rows.groupBy("grp", "span").agg(F.sum("delta").alias("of_span"))
    ahead = spans.select("grp", "span", F.sum("of_span").over(W.partitionBy("grp").orderBy("span").rowsBetween(W.unboundedPreceding, -1)).alias("ahead"))
    inside = F.sum("delta").over(W.partitionBy("grp", "span").orderBy("ts", "id", "part").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(ahead, ["grp", "span"]).select("grp", "ts", "id", (F.coalesce("ahead", F.lit(0.0)) + F.col("inside")).alias("total"))


def last_rows(m: DataFrame, n: int) -> DataFrame:
    """The last n matches in time: a top-n of keys bounds the filter, so no partition holds all rows."""
    edge = m.orderBy(F.desc("date"), F.desc("match_id")).limit(n).agg(F.min(F.struct("date", "match_id")).alias("edge"))
    return m.join(F.broadcast(edge), F.struct("date", "match_id") >= F.col("edge")).drop("edge")  # one row


def numbered(m: DataFrame) -> DataFrame:
    """`m` with n, its place in time from 1, without sorting all rows in one task: ranks within a day plus the days' offsets."""
    days = m.groupBy("date").agg(F.count("*").alias("k"))
    starts = days.select("date", (F.sum("k").over(W.orderBy("date")) - F.col("k")).alias("start"))  # a row a day
    return m.join(starts, "date").withColumn("n", F.col("start") + F.row_number().over(W.partitionBy("date").orderBy("match_id"))).drop("start")


def expanding_folds(m: DataFrame, k: int = 4) -> DataFrame:
    """(fold, role, match_id): train on everything before each of the last k equal folds; the remainder goes to the first train."""
    rows = numbered(m).join(m.agg(F.count("*").alias("all")), how="cross")  # one row
    size = F.expr(f"all div {k + 1}")
    fold = F.explode(F.sequence(F.lit(1), F.lit(k)))
    end = F.col("all") - (k + 1 - F.col("fold")) * size
    rows = rows.select("match_id", "n", "all", fold.alias("fold")).withColumn("end", end).where(F.col("n") <= F.col("end") + size)
    return rows.select("fold", F.when(F.col("n") <= F.col("end"), "train").otherwise("test").alias("role"), "match_id")


def walk_forward(m: DataFrame, windows: int, width: int, least: int) -> DataFrame:
    """(win, role, match_id): `windows` last blocks of `width`, the latest first, each with all before it as training."""
    rows = numbered(m).join(m.agg(F.count("*").alias("all")), how="cross")  # one row
    rows = rows.select("match_id", "n", "all", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("win"))
    end = F.col("all") - F.col("win") * width
    return rows.where((end - width >= least) & (F.col("n") <= end)).select("win", F.when(F.col("n") > end - width, "test").otherwise("train").alias("role"), "match_id")
