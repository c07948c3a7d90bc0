import datetime as dt

from talusgrid.streaming import cells


def test_streams_of_cells(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(1), 0, 0, 1.0), (at(2), 1, 1, 3.0), (at(2), 0, 0, 5.0), (at(12), 4, 4, 7.0), (at(50), 0, 0, 9.0)]
    schema = "ts timestamp, row long, col long, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("quads", cells.quadrat_windows(stream, 2, 2, "10 minutes", "5 minutes"), "append"), ("newest", cells.latest(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = {(r.qrow, r.qcol, r.n, r.mean) for r in spark.table("quads").collect()}
    assert got == {(0, 0, 3, 3.0), (4, 4, 1, 7.0)}
    assert {(r.row, r.col): r.value for r in spark.table("newest").collect()} == {(0, 0): 9.0, (1, 1): 3.0, (4, 4): 7.0}
