from routelens.operators.usage import usage_summary
from routelens.sources.views import view
from routelens.streaming import usage_stream as us

SF_DIR = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    log = view(spark, SF_DIR, "usage_log")
    log.repartition(4).write.json(f"{tmp_path}/log")
    schema = log.withColumn("event_ts", log.event_ts.cast("timestamp")).schema
    stream = us.read_log(spark, f"{tmp_path}/log", schema, files_per_trigger=1)
    us.to_table(us.running_summary(stream), "summary", f"{tmp_path}/c1").awaitTermination()
    columns = usage_summary(log, "run_id").columns
    got = sorted(tuple(r) for r in spark.table("summary").select(*columns).collect())
    assert got == sorted(tuple(r) for r in usage_summary(log, "run_id").collect())
    us.to_table(us.windowed_usage(us.read_log(spark, f"{tmp_path}/log", schema)), "windows", f"{tmp_path}/c2", "update").awaitTermination()
    assert sum(r.tasks for r in spark.table("windows").collect()) == log.count()


def test_claims_are_made_once(spark, tmp_path):
    jobs = view(spark, SF_DIR, "jobs").limit(50)
    jobs = jobs.withColumn("due", jobs.due.cast("timestamp"))
    both = jobs.union(jobs)
    both.write.parquet(f"{tmp_path}/jobs")
    stream = spark.readStream.schema(both.schema).parquet(f"{tmp_path}/jobs")
    us.to_table(us.claimed_once(stream), "claims", f"{tmp_path}/c", "append").awaitTermination()
    assert spark.table("claims").count() == jobs.select("job_id", "due").distinct().count()
