from tessera import streaming
from tessera.operators import sweep


def test_streamed_sweep_equals_batch(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["card 4111111111111111.", "none", "10000000146 and 4539578763621486", "x12345678901y"])]
    spark.createDataFrame(rows, "i int, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, t string").parquet(str(tmp_path / "in"))
    q = streaming.violation_stream(stream, ["i"], "t").writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("hits").collect()))
    want = sorted(map(tuple, sweep.violations(spark.read.parquet(str(tmp_path / "in")), ["i"], None).collect()))
    assert got == want and len(got) >= 3
