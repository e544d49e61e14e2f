"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES``
(optional) a comma-separated choice of queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.registry import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "fraud_detection", "stream_detection", "tumble_ohlc", "hop_volume", "rapid_fire",
    "session_burst", "ohlc_volatility", "wash_score", "trade_summary", "cascade_ohlc",
    "having_volume", "suspicious_match", "forward_match", "asof_quote", "asof_order",
    "lookup_nation", "lag_price", "lead_price", "percentiles", "recent_n", "latest_price",
    "late_split", "customer_totals", "cdc_log_totals", "customer_current", "changelog_totals",
    "stream_tumble", "stream_session", "stream_match", "stream_asof",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    # A first run compiles and loads classes; what follows is steady state.
    QUERIES["fraud_detection"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    out = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
        "events": events,
        "six_streams_rows_per_sec": {
            n: round(events / times[n])
            for n in ("fraud_detection", "stream_detection") if n in times
        },
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
