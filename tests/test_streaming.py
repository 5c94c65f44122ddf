"""The stream gives what the table gives, for the days that the watermark has closed."""

import datetime as dt

from loamgrid.streaming.composites import daily, running

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def test_stream_equals_table(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(i, day(1 + i % 3, i % 24), i % 4, float(i)) for i in range(60)] + [(99, day(20, 0), 0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.union(df.limit(7)).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = running(spark, df.schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in daily(df).filter("day < '2024-01-17'").collect()}
    assert got == want and len(got) == 12
