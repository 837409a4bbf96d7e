import datetime

from tallyweave.streaming import incremental

SCHEMA = "delivery_id long, txid string, delivered_at timestamp, inputs array<struct<address: string, value_sats: long>>, outputs array<struct<address: string, value_sats: long>>"


def source(spark, path, batches):
    t0 = datetime.datetime(2024, 1, 1)
    for i, b in enumerate(batches):
        rows = [(d, x, t0 + datetime.timedelta(hours=h), [("A", 5)], [("B", 3), (None, 1)]) for d, x, h in b]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


BATCHES = [[(1, "a", 0), (2, "b", 1), (3, None, 1)], [(4, "A ", 2), (5, "c", 3), (6, None, 3)], [(7, "z", 24 * 9)]]


def test_exactly_once(spark, tmp_path):
    run(incremental.exactly_once_stream(source(spark, str(tmp_path / "s"), BATCHES)), "once")
    assert [r.delivery_id for r in spark.sql("select delivery_id from once order by 1").collect()] in ([1, 2, 3, 5, 6, 7], [2, 3, 4, 5, 6, 7])


def test_activity(spark, tmp_path):
    run(incremental.activity_stream(source(spark, str(tmp_path / "s"), BATCHES)), "activity")
    got = {r.address: (r.n_inputs, r.n_outputs, r.sent_sats, r.received_sats) for r in spark.table("activity").collect()}
    assert got == {"A": (6, 0, 30, 0), "B": (0, 6, 0, 18)}


def test_partials(spark, tmp_path):
    out = str(tmp_path / "o")
    count = lambda b: b.groupBy("txid").count()
    incremental.append_partials(source(spark, str(tmp_path / "s"), BATCHES), count, out, str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(out).agg({"count": "sum"}).first()[0] == 7
