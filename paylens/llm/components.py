"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum (combined before the shuffle) and a join, so a
node with any number of neighbours is never collected; each round is written
to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paylens.llm.store import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return (both.join(least, both.a == least.n).filter(F.col("b") > F.col("a"))
            .select(F.col("m").alias("a"), "b").filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    joined = down.join(least, down.a == least.n)
    return (joined.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
            .filter("a <> b").distinct())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node in ``links(a, b)``; component is the smallest id reachable.

    Ends when all links are stars around their smallest node: no node is both a
    centre and a leaf and no leaf has two centres.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a < b").distinct(), name)
    while True:
        roles = links.select(F.col("a").alias("n"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).union(
            links.select("b", F.lit(0), F.lit(1))).groupBy("n").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf"))
        if not roles.filter("leaf > 1 or (leaf = 1 and centre = 1)").limit(1).count():
            break
        links = stored(_small_star(_large_star(links)), name)
    return (links.select(F.col("b").alias("id"), F.col("a").alias("component"))
            .union(links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()))
