"""Entity resolution that refuses rather than guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import LOOSE_TOKENS, core_key, loose_keys, squash, token_set
from ..sources.storage import stored
from .settle import best_first


def by_containment(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, known_id): known entities (known_id, known_name, peak) whose token set holds the name's or lies in it.

    The highest peak wins, then the smaller id.  Equal token sets are one row first, with their best entity; different ones
    meet in the rarest token of the smaller set, which the larger must hold.
    """
    name_sets = names.select("name", token_set(F.col("name")).alias("t")).where(F.size("t") > 0)
    known_sets = known.select("known_id", "peak", token_set(F.col("known_name")).alias("u")).where(F.size("u") > 0)
    left = name_sets.select("t").distinct()
    right = known_sets.groupBy("u").agg(F.min(F.struct((-F.col("peak")).alias("down"), F.col("known_id").alias("id"))).alias("best"))
    tokens = left.select(F.explode("t").alias("tok")).unionByName(right.select(F.explode("u").alias("tok")))
    often = tokens.groupBy("tok").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, s: str) -> DataFrame:
        return rows.withColumn("tok", F.explode(s)).join(often, "tok").groupBy(*rows.columns).agg(F.min(F.struct("n", "tok")).alias("r")).select(*rows.columns, F.col("r.tok").alias("tok"))

    inside = rarest(left, "t").join(right.withColumn("tok", F.explode("u")), "tok").where(F.size(F.array_except("t", "u")) == 0)
    around = left.withColumn("tok", F.explode("t")).join(rarest(right, "u"), "tok").where(F.size(F.array_except("u", "t")) == 0)
    best = inside.select("t", "best").unionByName(around.select("t", "best")).groupBy("t").agg(F.min("best").alias("best"))
    return name_sets.join(best, "t").select("name", F.col("best.id").alias("known_id"))


def _grams(c: Column, low: int, high: int) -> Column:
    """All substrings of low to high characters, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, n))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.length(c) >= n, of(n)).otherwise(F.array().cast("array<string>")))))


ANCHOR = 8
SHORTEST = 4


def _contained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of core keys (core, known_core): known ones of four letters or more within an asked one, and longer known ones
    around an asked one of more than eight letters.

    They meet in the first eight letters of the inner key, so a join is on equal anchors, never on all pairs.
    """
    asked, known = asked.distinct(), known.where(F.length("known_core") >= SHORTEST).distinct()
    head = lambda c: F.substring(c, 1, ANCHOR)
    outer = asked.withColumn("a", F.explode(_grams(F.col("core"), SHORTEST, ANCHOR))).join(known.withColumn("a", head("known_core")), "a").where(F.contains("core", "known_core"))
    long_ = asked.where(F.length("core") > ANCHOR).withColumn("a", head("core"))
    inner = long_.join(known.withColumn("a", F.explode(_grams(F.col("known_core"), ANCHOR, ANCHOR))), "a").where(F.contains("known_core", "core"))
    return outer.select("core", "known_core").union(inner.select("core", "known_core")).distinct()


def _around(have: DataFrame) -> DataFrame:
    """(core, n, known_name): for each text of up to eight letters, how many known names have it inside a longer core key, and
    the first of them.  Short texts are in many names, so they are counted, never paired."""
    grams = have.where(F.length("known_core") >= SHORTEST).select("known_name", "known_core", F.explode(_grams(F.col("known_core"), 1, ANCHOR)).alias("core"))
    return grams.where(F.length("core") < F.length("known_core")).groupBy("core").agg(F.count("*").alias("n"), F.min("known_name").alias("known_name"))


def unique_or_refuse(names: DataFrame, known: DataFrame, alias: DataFrame | None = None, drop=LOOSE_TOKENS) -> DataFrame:
    """(name, known_name, stage): the known name that a name's spellings refer to, or null.

    Stages: alias (alias, known_name), full key, core key without the tokens of `drop`, one core key within the other.  Each
    of the last three must fit exactly one known name.  Names may carry `spellings`, an array in order; an earlier stage wins,
    then an earlier spelling.  Null and empty spellings fit nothing.
    """
    spellings = F.col("spellings") if "spellings" in names.columns else F.array("name")
    asked = names.select("name", F.posexplode(spellings).alias("pos", "spelling")).where("spelling is not null")
    asked = stored(asked.withColumns({"full": squash(F.col("spelling")), "core": core_key(F.col("spelling"), drop)}))
    have = known.select("known_name").where("known_name is not null").distinct()
    have = stored(have.withColumns({"known_full": squash(F.col("known_name")), "known_core": core_key(F.col("known_name"), drop)}))

    def unique(pairs: DataFrame, stage: int) -> DataFrame:
        hits = pairs.groupBy("name", "pos").agg(F.countDistinct("known_name").alias("n"), F.min("known_name").alias("known_name"))
        return hits.where("n = 1").select("name", "pos", "known_name", F.lit(stage).alias("stage"))

    full = unique(asked.join(have, F.col("full") == F.col("known_full")).where("full <> ''"), 2)
    core = unique(asked.join(have, F.col("core") == F.col("known_core")).where("core <> ''"), 3)
    within = _contained(asked.select("core").where("core <> ''"), have.select("known_core"))
    paired = asked.join(within, "core").join(have, "known_core").groupBy("name", "pos").agg(F.countDistinct("known_name").alias("n"), F.min("known_name").alias("known_name"))
    counted = asked.where(F.length("core") <= ANCHOR).join(_around(have), "core").select("name", "pos", "n", "known_name")
    loose = paired.unionByName(counted).groupBy("name", "pos").agg(F.sum("n").alias("n"), F.min("known_name").alias("known_name"))
    found = full.unionByName(core).unionByName(loose.where("n = 1").select("name", "pos", "known_name", F.lit(4).alias("stage")))
    if alias is not None:
        by_alias = asked.join(alias.select(F.col("alias").alias("spelling"), "known_name"), "spelling").join(have, "known_name", "left_semi")
        found = found.unionByName(by_alias.select("name", "pos", "known_name", F.lit(1).alias("stage")))
    best = best_first(found, ["name"], F.col("stage"), F.col("pos"), F.col("known_name")).drop("pos")
    return names.select("name").distinct().join(best, "name", "left")


def first_candidate(names: DataFrame, known: DataFrame, candidates) -> DataFrame:
    """(name, known_name, at): the first of a name's candidates (an array column) that is known."""
    rows = names.select("name", F.posexplode(candidates).alias("at", "known_name")).join(known, "known_name", "left_semi")
    return best_first(rows, ["name"], F.col("at")).select("name", "known_name", "at")


def by_region(asked: DataFrame, known: DataFrame, preferred: DataFrame | list[str]) -> DataFrame:
    """(name, known_id): the one entity (known_id, key, region) of the name's key; several are settled by a preferred region, or refused.

    preferred: a few names, or a table (region).  If `known` has `loose`, an array of keys, names that no key fits are looked up once more by their loose keys.
    """
    if isinstance(preferred, list):
        known = known.withColumn("region", F.col("region").isin(*preferred))
    else:
        known = known.join(preferred.distinct().withColumn("_good", F.lit(True)), "region", "left").withColumn("region", F.coalesce("_good", F.lit(False))).drop("_good")
    good = F.col("region")
    pairs = asked.select("name", squash(F.col("name")).alias("key")).join(known, "key").select("name", "known_id", "region", F.lit(1).alias("stage"))
    if "loose" in known.columns:
        by_key = known.select("known_id", "region", F.explode("loose").alias("key"))
        pairs = pairs.union(asked.select("name", F.explode(loose_keys(F.col("name"))).alias("key")).join(by_key, "key").select("name", "known_id", "region", F.lit(2)))
    counts = pairs.distinct().groupBy("name", "stage").agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"), F.min("known_id").alias("any"), F.min(F.when(good, F.col("known_id"))).alias("one"))
    pick = F.when(F.col("n") == 1, F.col("any")).when(F.col("n_good") == 1, F.col("one"))
    return asked.select("name").distinct().join(best_first(counts, ["name"], F.col("stage")).select("name", pick.alias("known_id")), "name", "left")


def not_alike(fixtures: DataFrame, have: DataFrame) -> DataFrame:
    """Fixtures (date, home_key, away_key) with no fixture in `have` on the day whose keys equal or begin theirs, or the other way round.

    Keys of two letters or more meet in their first two letters; shorter ones, which begin many others, on the day alone.
    """
    def same(c):
        x, y = F.col(f"f.{c}"), F.col(f"h.{c}")
        return x.startswith(y) | y.startswith(x)

    head = lambda t, c: F.substring(f"{t}.{c}", 1, 2)
    on_day = [F.col("f.date") == F.col("h.date"), same("home_key"), same("away_key")]
    by_head = [head("f", c) == head("h", c) for c in ("home_key", "away_key")]
    short = F.coalesce(F.least(F.length("home_key"), F.length("away_key")) < 2, F.lit(False))
    rows = fixtures.where(~short).alias("f").join(have.where(~short).alias("h"), on_day + by_head, "left_anti")
    rows = rows.join(have.where(short).alias("h"), on_day, "left_anti")
    return rows.union(fixtures.where(short).alias("f").join(have.alias("h"), on_day, "left_anti")).alias("f")
