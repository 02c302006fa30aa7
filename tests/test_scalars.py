"""Scalar functions on odd inputs, and their queries against SQL on values that the tables supplied don't reach."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry.functions import scalars as S
from attestry.plans import queries as q


def test_times_far_from_now(spark, tmp_path):
    rng = random.Random(3)
    years = [-62167219201, -62167219200, -62135596801, -62135596800, -30610224000, 253402300799, 253402300800]  # where years -1, 0, 1, 1000 and 10000 begin or end
    ids = {i // 86399 + k for i in years for k in (-1, 0, 1, 2)} | {-1, 0, 1, 15, 16, 719162, 2932930, 2932931, 5999999, 25158147, 106751990, -106000000} | {rng.randint(-10**8, 10**8) for _ in range(300)}
    spark.createDataFrame([(i,) for i in [None, *sorted(ids)]], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r for r in c.execute(q.ORACLES["time_text"]).fetchall()}
    assert {r["event_id"]: tuple(r) for r in q.QUERIES["time_text"](spark, str(tmp_path)).collect()} == want
    assert want[2932931][1] == "10000-01-01T01:17:49Z" and want[25158147][1].endswith("32Z")  # 33 but for the SQL's DOUBLE


@pytest.mark.parametrize("zone", ["UTC", "America/St_Johns", "Pacific/Apia"])
def test_times_in_any_session_zone(spark, zone):
    want = {951782400: "2000-02-29T00:00:00Z", 1792108435: "2026-10-15T23:53:55Z", -1: "1969-12-31T23:59:59Z", 1325203200: "2011-12-30T00:00:00Z", -62167219200: "0000-01-01T00:00:00Z", 253402300800: "10000-01-01T00:00:00Z", 25158147 * 86399: "70849-11-13T19:37:33Z", None: None}
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame([(s,) for s in want], "s long").select("s", S.rfc3339(F.col("s")).alias("at")).collect()
        part = spark.range(1).select(S.rfc3339(F.lit(-0.5)), S.rfc3339(F.lit(float("nan")))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert {r["s"]: r["at"] for r in got} == want
    assert tuple(part) == ("1969-12-31T23:59:59Z", None)
