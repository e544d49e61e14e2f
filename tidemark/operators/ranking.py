"""Most recent, latest by key, and exact percentiles."""

from pyspark.sql import Window, functions as F

from ..functions.time import align
from ..session import pin


def recent_n(df, n, order, keys=()):
    """The ``n`` newest rows, over all rows or per key.

    Per key, Spark applies the rank limit before the shuffle too, so a busy key
    sends at most ``n`` rows per map task.
    """
    newest = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest_by_key(df, keys, cols, order):
    """The columns of the newest row per key, combined map-side; all come from one row.

    Of rows that tie in ``order`` the one with the largest columns counts.
    """
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order, *cols)).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


def throughput(df, keys=(), size_ms=1000, ts="ts", name="rows", last=60):
    """Rows per tick, newest ``last`` ticks (all ticks if None)."""
    tick = align(ts, size_ms).alias("tick")
    counts = df.groupBy(*keys, tick).agg(F.count(F.lit(1)).alias(name))
    return counts if last is None else recent_n(counts, last, ["tick"], keys)


# Rank error of the bracketing sketch is rows / ACCURACY on either side.
ACCURACY = 10_000
# A bracket is cut into so many equal ranges of values, of which only one is ranked.
RANGES = 1_000
# Brackets are broadcast only if there are at most so many keys.
BROADCAST_KEYS = 100_000


def percentiles(df, keys, col, quantiles):
    """Exact nearest-rank percentiles of a numeric column per key, one row per key.

    ``quantiles`` maps result name to an integer percentage q; the value is the
    one at rank ``min(floor(n * q / 100), n - 1)`` counted from 0. Per key and
    quantile a mergeable sketch brackets the rank with ten times its error bound.
    Rows below a bracket only add to one count, rows inside it to one count for
    each range of values; a running count over the ranges finds the one that holds
    the rank, and only its distinct values are ranked. A bracket that missed its
    rank would fail the query.
    """
    if not keys:
        every = percentiles(df.withColumn("_all", F.lit(0)), ["_all"], col, quantiles)
        return every.drop("_all")
    margin = 10.0 / ACCURACY
    bounds = []
    for i, q in enumerate(quantiles.values()):
        p = q / 100.0
        lo, hi = max(p - margin, 0.0), min(p + margin, 1.0)
        bounds += [
            F.percentile_approx(col, lo, ACCURACY).alias(f"_lo{i}") if lo > 0
            else F.min(col).alias(f"_lo{i}"),
            F.percentile_approx(col, hi, ACCURACY).alias(f"_hi{i}") if hi < 1
            else F.max(col).alias(f"_hi{i}"),
        ]
    marks = pin(df.groupBy(*keys).agg(F.count(col).alias("_n"), *bounds))
    brackets = marks.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), F.least(F.floor(F.col("_n") * q / 100), F.col("_n") - 1).alias("rank"),
                     F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"))
            for i, (n, q) in enumerate(quantiles.items())
        ])).alias("_b"),
    )
    if marks.count() <= BROADCAST_KEYS:
        brackets = F.broadcast(brackets)
    v, lo, hi = F.col(col), F.col("_b.lo"), F.col("_b.hi")
    width = hi.cast("double") - lo.cast("double")
    place = F.when(width > 0, F.floor((v.cast("double") - lo.cast("double")) / width * RANGES)).otherwise(F.lit(0))
    inside = v >= lo
    counted = (
        df.where(v.isNotNull()).select(*keys, col).join(brackets, list(keys)).where(v <= hi)
        .groupBy(*keys, F.col("_b.name").alias("_name"), F.col("_b.rank").alias("_rank"),
                 F.when(inside, place).otherwise(-1).cast("long").alias("_range"), F.when(inside, v).alias(col))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    part = [*keys, "_name"]
    run = lambda *by: F.sum("_c").over(
        Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    holds = (F.col("_run") > F.col("_rank")) & (F.col("_run") - F.col("_c") <= F.col("_rank"))
    ranges = counted.groupBy(*part, "_range").agg(F.sum("_c").alias("_c"), F.max("_rank").alias("_rank"))
    hit = ranges.withColumn("_run", run(*part, "_range")).where(holds & (F.col("_range") >= 0)).select(
        *part, "_range", (F.col("_run") - F.col("_c")).alias("_before"))
    found = (
        counted.join(hit, [*part, "_range"]).withColumn("_run", run(*part, col) + F.col("_before")).where(holds)
        .groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, v)).alias(n) for n in quantiles])
    )
    missed = F.raise_error(F.lit("a percentile's bracket missed its rank"))
    return marks.where("_n > 0").select(*keys).join(found, list(keys), "left").select(
        *keys, *[F.coalesce(F.col(n), missed.cast(df.schema[col].dataType)).alias(n) for n in quantiles])


def percentiles_approx(df, keys, col, quantiles):
    """Sketch-based percentiles: one pass, bounded memory."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(col, q / 100.0, ACCURACY).alias(n) for n, q in quantiles.items()]
    )


def rank_errors(rows, approx, keys, col, quantiles):
    """How far approximate percentiles are off: ``approx`` with ``<name>_error`` for each of ``quantiles``.

    The error is the distance between the asked share of rows and the nearest share at
    which the value stands among the group's values of ``col``; 0 where it is exact. It
    reads all ``rows`` once more, but only counts.
    """
    v, names = F.col("_value"), list(quantiles)
    marks = approx.select(*keys, *[F.col(n).alias(f"_at_{n}") for n in names])
    met = rows.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_value")).join(marks, list(keys))
    counts = met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(v < F.col(f"_at_{n}")).alias(f"_below_{n}") for n in names],
        *[F.count_if(v <= F.col(f"_at_{n}")).alias(f"_upto_{n}") for n in names],
    )
    off = lambda n, q: F.greatest(
        F.col(f"_below_{n}") / F.col("_n") - q / 100.0, q / 100.0 - F.col(f"_upto_{n}") / F.col("_n"), F.lit(0.0))
    errors = counts.select(*keys, *[off(n, q).alias(f"{n}_error") for n, q in quantiles.items()])
    return approx.join(errors, list(keys), "left")
