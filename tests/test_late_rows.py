"""Session windows over micro-batches: state is carried, rows behind the watermark are left out and counted."""

import datetime

import duckdb

from pyspark.sql import functions as F

from quarry.plans import streams
from quarry.streaming import sessions

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_sessions_over_batches_and_a_late_row(spark, tmp_path):
    # slice, user, minute: user 1's session goes over two slices, a row of slice 1 is out of order but in time, one of slice 3 is a day late
    rows = [(0, 1, 1440), (0, 1, 1460), (0, 2, 1440), (1, 1, 1485), (1, 2, 1450), (2, 3, 1700), (3, 2, 20), (3, 3, 1710), (4, 4, 3000)]
    df = spark.createDataFrame([(k, u, at(m)) for k, u, m in rows], "slice int, user long, ts timestamp")
    stream = sessions.in_order(df, 5, F.col("slice"), f"{tmp_path}/arrived", 1)
    progress = []
    found = stream.withWatermark("ts", "60 minutes").groupBy("user", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    told = sessions.run_available(found.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"), f"{tmp_path}/out", progress)
    assert sorted(map(tuple, told.collect())) == [(1, at(1440), at(1515), 3), (2, at(1440), at(1480), 2), (3, at(1700), at(1740), 2)]
    assert sessions.late_rows(progress) == 1 and sum(p["numInputRows"] > 0 for p in progress) == 5


def test_the_events_arrive_in_slices_with_late_rows(spark):
    stream = streams.arriving(spark, "/root/testdata/sf0.001")
    assert stream.isStreaming
    (row,) = streams.late_count(spark, "/root/testdata/sf0.001").collect()
    assert row.batches == streams.SLICES and row.late > 0


def test_a_row_in_time_extends_a_session_that_was_given_out(spark, tmp_path):
    # an event a minute; those with id % 50 = 7 come three slices late
    placed = {5: (1, 5), 7: (1, 20), 205: (2, 205), 257: (2, 225), 250: (2, 250), 275: (2, 275), 300: (2, 300), 320: (2, 320)}
    rows = [(i, at(placed.get(i, (0, i))[1]), placed.get(i, (0, i))[0]) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = sorted(map(tuple, streams.session_windows(spark, str(tmp_path)).collect()))
    us = lambda m: (at(m) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    # user 1's session was given out before minute 20 came; user 2's goes on at the end, though a part of it was given out
    assert found == [(1, us(5), us(50), 2)]
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    db.execute(f"create view events as select event_id, ts::timestamp as ts, user_id from '{tmp_path}/events.parquet/*.parquet'")
    from quarry import registry

    assert found == sorted(db.execute(registry.ORACLES["stream_session_windows"]).fetchall())
