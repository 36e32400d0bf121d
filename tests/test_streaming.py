import time

from pointloom.streaming import messages


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_windows_of_a_stream_match_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", float(i)) for i in range(12)], "ts string, value double").selectExpr("cast(ts as timestamp_ntz) ts", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(messages.tumbling(stream, "ts", "1 day", late="1 hour"), "w")
    closed = {r["start"]: (r["n"], r["total"]) for r in spark.sql("select * from w").collect()}
    table = {r["start"]: (r["n"], r["total"]) for r in messages.tumbling(rows, "ts", "1 day").collect()}
    assert len(closed) == 2 and all(table[k] == v for k, v in closed.items())  # the last day is still open


def test_local_map_forgets_what_lies_behind(spark, tmp_path):
    schema = "k long, ts double, x double, y double, z double"
    rows = spark.createDataFrame([(1, float(i), float(i), 0.0, 0.0) for i in range(30)], schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(messages.local_map(stream, "k", 20.0, 1.0), f"m{int(time.time())}")
    name = [t.name for t in spark.catalog.listTables() if t.name.startswith("m")][-1]
    r = spark.table(name).collect()[-1]
    assert r["rebuilt"] and 10 <= r["n_voxels"] < 30
