"""Reading messy files and nested feeds into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import loose_keys, squash
from .storage import stored

from ..functions.calendar import day_month_year

CLUB_SCHEMA = "Div string, AltDiv string, Date string, HomeTeam string, AwayTeam string, FTHG string, FTAG string, HST string, AST string"
INTERNATIONAL_SCHEMA = "date date, home_team string, away_team string, home_score double, away_score double, tournament string, neutral boolean"
PERIOD_SCHEMA = "Rank string, Club string, Country string, Level string, Elo string, From string, To string"


def club_matches(spark: SparkSession, path: str) -> DataFrame:
    """Club results from Latin-1 CSV files: the division may stand in either of two columns, dates in either of two forms,
    numbers may be unreadable (null), and rows without a key are left out."""
    raw = spark.read.csv(path, schema=CLUB_SCHEMA, header=True, encoding="ISO-8859-1")
    out = raw.select(
        F.coalesce("Div", "AltDiv").alias("div"), day_month_year(F.col("Date")).alias("date"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"),
        *[F.col(c).try_cast("double").cast("int").alias(n) for c, n in (("FTHG", "hg"), ("FTAG", "ag"), ("HST", "hst"), ("AST", "ast"))])
    return out.na.drop(subset=["div", "date", "home", "away"])


def international_matches(spark: SparkSession, path: str) -> DataFrame:
    """International results; unplayed matches keep null scores."""
    return spark.read.csv(path, schema=INTERNATIONAL_SCHEMA, header=True)


def rating_periods(spark: SparkSession, path: str) -> DataFrame:
    """Validity periods of ratings; headers inside, short lines and unreadable ratings are skipped."""
    raw = spark.read.csv(path, schema=PERIOD_SCHEMA, mode="DROPMALFORMED")
    rows = raw.select(F.col("Club").alias("club"), F.col("Elo").try_cast("double").alias("elo"), F.try_to_date("From", "yyyy-MM-dd").alias("start"), F.try_to_date("To", "yyyy-MM-dd").alias("finish"))
    return rows.where("elo is not null and start is not null and finish is not null")


SCOREBOARD = (
    "events array<struct<id: string, date: string, competitions: array<struct<status: struct<type: struct<completed: boolean>>, "
    "competitors: array<struct<homeAway: string, score: string, team: struct<displayName: string>, statistics: array<struct<name: string, displayValue: string>>>>>>>>")


def scoreboard_matches(feed: DataFrame, text: str = "body") -> DataFrame:
    """Finished matches of scoreboard documents: the first competition of each event, its sides told apart by homeAway."""
    events = feed.select(F.explode(F.from_json(text, SCOREBOARD)["events"]).alias("e")).select("e.id", "e.date", F.get("e.competitions", 0).alias("c")).where("c.status.type.completed")

    def side(which):
        return F.get(F.filter("c.competitors", lambda x: x["homeAway"] == which), 0)

    def stat(who, name):
        return F.map_from_entries(F.transform(who["statistics"], lambda s: F.struct(s["name"], s["displayValue"])))[name].try_cast("double")

    h, a = side("home"), side("away")
    return events.select("id", F.to_date(F.substring("date", 1, 10)).alias("date"), h["team"]["displayName"].alias("home"), a["team"]["displayName"].alias("away"), h["score"].try_cast("int").alias("hg"), a["score"].try_cast("int").alias("ag"), stat(h, "shotsOnTarget").alias("hst"), stat(a, "shotsOnTarget").alias("ast"))


DAY_FEED = "events array<struct<idEvent: string, strHomeTeam: string, strAwayTeam: string, intHomeScore: string, intAwayScore: string, strPostponed: string>>"


def day_feed(feed: DataFrame, text: str = "body") -> DataFrame:
    """(id, home, away, hg, ag, status): finished, fixture or postponed."""
    e = feed.select(F.explode_outer(F.from_json(text, DAY_FEED)["events"]).alias("e")).where("e is not null").select("e.*")
    hg, ag = F.col("intHomeScore").try_cast("int"), F.col("intAwayScore").try_cast("int")
    status = F.when(F.lower("strPostponed") == "yes", "postponed").when(hg.isNotNull() & ag.isNotNull(), "finished").otherwise("fixture")
    return e.select(F.col("idEvent").alias("id"), F.col("strHomeTeam").alias("home"), F.col("strAwayTeam").alias("away"), hg.alias("hg"), ag.alias("ag"), status.alias("status"))


def manual_key(*parts: Column | str) -> Column:
    """A key m-date-home-away without spaces."""
    return F.replace(F.concat_ws("-", F.lit("m"), *parts), F.lit(" "), F.lit(""))


def ranking_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, at, href, label): the list links of each page in order, by built-in expressions."""
    items = F.regexp_extract_all(F.col(html), F.lit(r'<li><a href="/([^"]*)">([^<]*)</a></li>'), 0)
    rows = pages.select("page_id", F.posexplode(items).alias("at", "item"))
    pick = lambda k: F.regexp_extract("item", r'<li><a href="/([^"]*)">([^<]*)</a></li>', k)
    return rows.select("page_id", "at", pick(1).alias("href"), pick(2).alias("label"))


def ranking_clubs(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, at, name, api, country, rating): the rows of ranking tables that have a rating, a country and a name.

    A row's rating is the last of its right-aligned cells of three or four digits; its country is the link of three capitals;
    its own link, if there is one, is the first other.
    """
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("at", "row"))
    links = F.regexp_extract_all("row", F.lit('<a href="/([A-Za-z0-9]+)">'), F.lit(1))
    cells = F.regexp_extract_all("row", F.lit(r'<td class="r">\s*(\d{3,4})\s*</td>'), F.lit(1))
    rows = rows.select("page_id", "at", cells.alias("cells"), links.alias("links"), F.regexp_extract("row", '<a href="/([A-Z]{3})">', 1).alias("country"), F.trim(F.regexp_extract("row", '<span class="(?:Ast|min641)">([^<]+)</span>', 1)).alias("name"))
    rows = rows.where((F.size("cells") > 0) & (F.col("country") != "") & (F.col("name") != ""))
    return rows.select("page_id", "at", "name", F.get(F.filter("links", lambda x: x != F.col("country")), 0).alias("api"), "country", F.element_at("cells", -1).cast("int").alias("rating"))


def enough(rows: DataFrame, name: str = "name", least: int = 500) -> DataFrame:
    """`rows`, stored, if they hold at least `least` different names; else the pages' layout has changed, and nothing is returned."""
    kept = stored(rows)
    n = kept.agg(F.count_distinct(name)).first()[0]
    if n < least:
        raise ValueError(f"pages gave {n} names, fewer than {least}: has their layout changed?")
    return kept


def club_keys(clubs: DataFrame) -> DataFrame:
    """(key, kind, name, api, country, rating): each club under its exact keys (name and link) and its loose ones."""
    exact, loose = F.array(squash(F.col("name")), squash(F.coalesce("api", F.lit("")))), loose_keys(F.col("name"))
    each = lambda keys, kind: F.transform(F.array_distinct(F.filter(keys, lambda k: k != "")), lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))
    return clubs.select(F.explode(F.concat(each(exact, "exact"), each(loose, "loose"))).alias("k"), "name", "api", "country", "rating").select("k.*", "name", "api", "country", "rating")


def daily(weather: DataFrame, text: str = "body") -> DataFrame:
    """One row a day from parallel arrays."""
    schema = "time array<string>, temp array<double>, wind array<double>"
    d = weather.select("place", F.from_json(text, schema).alias("d")).select("place", "d.time", "d.temp", "d.wind")
    return d.select("place", F.explode(F.arrays_zip("time", "temp", "wind")).alias("x")).select("place", F.to_date("x.time").alias("date"), "x.temp", "x.wind")


SLATE = "date date, n long, unrated long, n_anchored long, competitions array<string>, matches array<struct<match_id: long, home: long, away: long, stage: string, anchored: boolean>>, unrated_list array<struct<match_id: long, home: long, away: long>>"


def sink_slate(matches: DataFrame, path: str) -> None:
    """One nested JSON document a day: the rated matches (n, of which n_anchored have prices; their competitions), in order
    of their id, and those that aren't.  matches: match_id, date, home, away, stage, anchored, rated."""
    rated, anchored = F.col("rated"), F.col("anchored")
    row = F.struct("match_id", "home", "away", "stage", "anchored")
    nested = matches.groupBy("date").agg(
        F.count_if(rated).alias("n"), F.count_if(~rated).alias("unrated"), F.count_if(rated & anchored).alias("n_anchored"), F.array_sort(F.collect_set(F.when(rated, F.col("stage")))).alias("competitions"),
        F.array_sort(F.collect_list(F.when(rated, row))).alias("matches"), F.array_sort(F.collect_list(F.when(~rated, F.struct("match_id", "home", "away")))).alias("unrated_list"))
    nested.write.mode("overwrite").json(path)


def first_writes(log: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: those whose key is not logged, each key once (its smallest pid)."""
    fresh = new.join(log.select(*key).distinct(), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in key]), "pid").alias("_r")).select(*key, "_r.*")


def discovered(names: DataFrame, text: str = "", kind: str = "all", limit: int = 50) -> DataFrame:
    """(name, kind, count): the first `limit` names (name, kind) of a kind that hold a text, whatever their case, with their
    number before the limit."""
    found = names.where(F.contains(F.lower("name"), F.lit(text.lower())) & (F.lit(kind == "all") | (F.col("kind") == kind)))
    return found.orderBy("name", "kind").limit(limit).join(found.agg(F.count("*").alias("count")), how="cross")  # one row
