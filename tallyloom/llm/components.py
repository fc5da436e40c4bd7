"""Connected components of a link table, by rounds of minimum labels with shortcuts, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in `links` the smallest id it reaches.  Repeated and self links are allowed.

    Each round every node takes the smallest label among its neighbours' and its own, and then that label's label, so a
    path of n links takes about log n rounds.  Rounds are checkpointed; the driver sees one number a round.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to"))
    size = Observation()
    both = cut(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct().observe(size, F.count("*").alias("n")))
    if not size.get["n"]:
        return both.select("id", F.col("to").alias("component"))
    label = cut(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")))
    while True:
        near = both.join(label.select(F.col("id").alias("to"), F.col("component").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        new = label.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        up = label.select(F.col("id").alias("c"), F.col("component").alias("top"))
        seen = Observation()
        new = new.join(up, "c").select("id", "old", F.least("c", "top").alias("component"))
        new = cut(new.observe(seen, F.count(F.when(F.col("old") != F.col("component"), 1)).alias("changed")))
        label = new.select("id", "component")
        if not seen.get["changed"]:
            return label


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after following `links` (a, b), too: only those between different components are followed."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    label = cut(label.unionByName(ends.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component")))
    named = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    between = links.join(named("a"), "a").join(named("b"), "b").where("of_a <> of_b")
    top = components(between, "of_a", "of_b").select(F.col("id").alias("component"), F.col("component").alias("top"))
    return label.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
