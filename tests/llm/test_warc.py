"""The archive gives every record back exactly."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, warc

ROWS = [
    (5, "http://a/5", "x" * 150), (2, "http://a/2", "x" * 150), (9, "http://a/9\r\nWARC-Type: evil", "x" * 150),
    (1, None, "short"), (3, "http://a/3", "short"), (4, "http://a/4", None), (6, "http://a/6", ""),
    (7, "http://a/7", "é" * 50), (8, "http://a/8", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49),
    (12, "u", "\r\n\r\nWARC/1.1\x00" * 9), (None, "u", "x" * 150), (None, None, None),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def brute(rows):
    payload = lambda r: (r[2] or "").encode()
    heads = {}
    for r in rows:
        if r[0] is not None:
            heads[payload(r)] = min(r[0], heads.get(payload(r), r[0]))
    out = []
    for r in rows:
        p = payload(r)
        again = len(p) >= 100 and r[0] != heads.get(p)
        out.append((r[0], len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", heads[p] if again else None))
    return sorted(out, key=repr)


def test_records(spark):
    folder = warc.write(pages(spark, ROWS))
    read = warc.read(spark, folder)
    assert sorted(map(tuple, warc.fields(read).collect()), key=repr) == brute(ROWS)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(r[2] or "").encode() for r in ROWS})
    by_id = {r["page_id"]: bytes(r["record"]) for r in read.collect()}
    head, body = by_id[12].split(b"\r\n\r\n", 1)
    assert body == (ROWS[11][2] + "\r\n\r\n").encode()
    assert f"Content-Length: {len(ROWS[11][2])}".encode() in head.split(b"\r\n")
    assert by_id[5].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"WARC-Refers-To: <urn:page:2>" in by_id[5]
    assert b"evil" in by_id[9] and by_id[9].count(b"\r\nWARC-Type:") == 1


def test_empty_table(spark):
    assert warc.read(spark, warc.write(pages(spark, []))).count() == 0


def test_changed_payload_is_found(spark):
    folder = warc.write(pages(spark, [(1, "u", "abc")]))
    bad = warc.write(pages(spark, [(1, "u", "abd")]))
    spark.read.parquet(f"{bad}/payloads").withColumn("digest", F.lit(hashlib.sha256(b"abc").hexdigest())).write.mode("append").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="fit digest"):
        warc.fields(warc.read(spark, folder)).collect()


def test_payloads_stay_where_they_are_read(spark):
    """Size and digest are told without moving the payloads to the headers."""
    found = warc.fields(warc.read(spark, warc.write(pages(spark, ROWS))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "AS payload_digest#" in plan[plan.index("Join"):] and "AS payload#" not in plan


def test_given_table(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = sorted(con.execute(queries.ORACLE["op8_warc"]).fetchall(), key=repr)
    assert sorted(map(tuple, queries.op8_warc(spark, data).collect()), key=repr) == want
