import datetime as dt

from brindle.streaming import events as EV

DDL = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, t0 + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(40)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, DDL).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = EV.hourly(EV.event_stream(spark, src, batch))
    EV.write_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.hour, r.event_type, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.hour, r.event_type, r.n, r.total) for r in EV.hourly(batch).collect()}
    assert got <= want  # windows inside the watermark stay open
    assert EV.deduplicated(batch.union(batch)).count() == 40
    assert EV.sessions(batch).count() == 40
