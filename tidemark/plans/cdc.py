"""Customer totals from change logs."""

from pyspark.sql import functions as F

from ..operators.changelog import current_state

# fixed values: change kinds that count
INSERT, UPDATE, DELETE = "I", "U", "D"


def _totals(rows):
    return rows.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("amount").cast("double").alias("total_spent"),
    )


def customer_totals(changes):
    """Totals over insert and update events; an updated order counts once per event."""
    return _totals(changes.where(F.col("_op").isin(INSERT, UPDATE)))


def log_totals(order_rows):
    """Totals over decoded log lines, which hold inserts and updates only."""
    return _totals(order_rows)


def current_rows(changes, key):
    """Newest state per key, deletes removed."""
    return current_state(changes, [key], "_lsn", deleted=(DELETE,))
