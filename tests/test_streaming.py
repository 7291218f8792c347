"""Row operators and windows over a stream."""

from quernel.operators import cut, keep, mutate
from quernel.streaming import stream_table, summarize_windows


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) as ts, id % 2 as k, cast(id as double) as v from range(30)").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    got = run(spark, cut(mutate(keep(stream_table(stream), "$v > 27"), "w=$v*2"), "k,w").to_df(), "rows_out", "append")
    assert sorted(r.w for r in got) == [56.0, 58.0]
    got = run(spark, summarize_windows(stream, "ts", "10 minutes", ["v=sum,count"], "k"), "windows_out", "complete")
    assert sorted((r.window_start.minute, r.k, r.v_sum, r.v_count) for r in got) == [(0, 0, 20.0, 5.0), (0, 1, 25.0, 5.0), (10, 0, 70.0, 5.0), (10, 1, 75.0, 5.0), (20, 0, 120.0, 5.0), (20, 1, 125.0, 5.0)]
