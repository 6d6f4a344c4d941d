"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, written

#: A node with more links than this, and more than this share of all, is a hub; there are at most 1 / HUB_SHARE.
HUB_LINKS, HUB_SHARE = 256, 1e-4


def spread_join(many: DataFrame, one: DataFrame, key: str, by: Column, most: int) -> DataFrame:
    """``many`` joined with ``one``, which has a row per key with ``n``, its rows in ``many``.

    Keys of more than ``most`` rows are dealt over copies of their row by a hash
    of ``by``, so no task gets more of a key than about ``most``. Callers choose
    ``most`` so that few keys are above it: these are broadcast.
    """
    heavy = F.broadcast(one.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).alias("parts")))
    salted = many.join(heavy, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0))).drop("parts")
    copies = F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > most, F.ceil(F.col("n") / most) - 1).otherwise(F.lit(0).cast("long")))
    return salted.join(one.select("*", F.explode(copies).alias("salt")), [key, "salt"]).drop("salt", "n")


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).withColumn("m", F.least("u", "m"))
    return spread_join(both.where("v > u"), least, "u", F.col("v"), most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least, "u", F.col("v"), most).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the component's smallest node.

    ``links`` has long columns a and b. Each round is written to the shared
    folder, so that plans stay short and a lost executor costs one round; rounds
    grow with the logarithm of a component's diameter. An empty table gives an
    empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    (edges, path), before = written(edges, "links"), None
    most = max(HUB_LINKS, int(edges.count() * HUB_SHARE))
    while True:
        last = path
        edges, path = written(_small_star(_large_star(edges, most), most), "stars")
        remove(links.sparkSession, last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
