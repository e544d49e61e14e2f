"""Window-start function for Spark SQL text."""

def register(spark):
    """Make ``tumble(ts, INTERVAL ...)`` callable in SQL, on epoch-millisecond columns.

    It is a SQL function, so Catalyst inlines it as arithmetic. It returns epoch
    milliseconds, so ``CAST(tumble(..) AS BIGINT)`` keeps milliseconds.
    """
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION tumble(ts BIGINT, size INTERVAL DAY TO SECOND)
        RETURNS BIGINT
        RETURN ts - pmod(ts, unix_millis(timestamp_millis(0) + size))
    """)
