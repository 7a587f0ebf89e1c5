from pyspark.sql import functions as F

from segloom.streaming import resume


def test_stage_goes_on_where_it_was(spark, tmp_path):
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = spark.range(1).schema
    run = lambda: resume.stage(resume.source(spark, src, schema), lambda d: d.withColumn("x", F.col("id") * 2), out, mark).awaitTermination(60)
    spark.range(5).write.parquet(src)
    run()
    run()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    run()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [2 * i for i in range(8)]


def test_sessions_and_windows(spark, small, tmp_path):
    src = str(tmp_path / "ev")
    spark.read.parquet(f"{small}/events.parquet").write.parquet(src)
    events = resume.source(spark, src, spark.read.parquet(src).schema)
    for name, df in (("s", resume.sessions(events)), ("c", resume.label_counts(events))):
        q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / name)).count() > 0
