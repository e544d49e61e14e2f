"""Change-log views: current state and row-level differences."""

from pyspark.sql import functions as F


def current_state(changes, keys, order, op="_op", deleted=("D",)):
    """Newest version of each key, without keys whose newest change is a delete."""
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest]).where(
        ~F.col(op).isin(*deleted)
    )


def diff(before, after, keys):
    """Changes that turn ``before`` into ``after``: ``+I``, ``-D``, and ``-U`` with ``+U``."""
    vals = [c for c in after.columns if c not in keys]
    b = before.select(*keys, F.struct(*vals).alias("_b"))
    a = after.select(*keys, F.struct(*vals).alias("_a"))
    moved = b.join(a, list(keys), "full").where(~F.col("_b").eqNullSafe(F.col("_a")))
    old = F.struct(F.when(F.col("_a").isNull(), "-D").otherwise("-U").alias("op"), F.col("_b").alias("v"))
    new = F.struct(F.when(F.col("_b").isNull(), "+I").otherwise("+U").alias("op"), F.col("_a").alias("v"))
    return (
        moved.withColumn("_c", F.explode(F.array(
            F.when(F.col("_b").isNotNull(), old), F.when(F.col("_a").isNotNull(), new)
        )))
        .where(F.col("_c").isNotNull())
        .select(*keys, F.col("_c.op").alias("change"), *[F.col(f"_c.v.{c}").alias(c) for c in vals])
    )
