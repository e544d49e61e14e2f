"""Connected components of a link table by alternating star contraction."""

from pyspark.sql import functions as F

from .common import store


def _signature(links):
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(links):
    """Every neighbour greater than a node is linked to the least of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links):
    """A node and its lesser neighbours are linked to the least of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links):
    """``node`` and ``component`` (its least node) for every node of the links ``a``, ``b``.

    Each round shrinks the trees; there are about as many rounds as the logarithm
    of the longest path. Rounds are written to the shared folder, only a count
    and a checksum reach the driver. No links give no rows.
    """
    links = store(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = _signature(links)
    while seen[0]:
        links = store(_small_star(_large_star(links)), "links")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
