"""Connected components of a table of links, without gathering any group.

Alternates the two star steps: every node hangs its larger neighbours under its
smallest neighbour, then its smaller neighbours too. Both steps are a grouped
minimum and a join, so a node with very many links is pre-aggregated before the
shuffle and its join partition can be split. Each round is written to the shared
folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.session import materialize

#: Links in a file of a round, by the number of links before it.
IN_A_FILE = 100_000


def _smallest(links: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    hung = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, of every linked node (u, v) but the smallest ones themselves."""
    now = materialize(links.where("u != v").select("u", "v").distinct(), "links")
    state, count = None, now.count()
    while True:
        now = materialize(_small_star(_large_star(now)), "links", 1 + count // IN_A_FILE)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, count = sums, sums[0]
