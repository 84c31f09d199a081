import json
import os
import time

import pytest
from pyspark.sql import functions as F

from routelens.sources import files
from routelens.sources.records import Reader, Writer, register
from routelens.streaming import usage_stream as us
from routelens.streaming.frames import EventFrames

COLUMNS = "task_id string, n long, x double, tags array<string>"


@pytest.fixture
def records(spark):
    register(spark)
    return lambda path: spark.read.format("routelens_records").option("path", path).option("columns", COLUMNS).load()


def put(rows, path, mode="append", **options):
    rows.write.format("routelens_records").options(path=path, **options).mode(mode).save()


def test_appends_are_made_once_and_overwrites_replace(spark, records, tmp_path):
    path = f"{tmp_path}/r"
    rows = spark.createDataFrame([("a", 1, 0.5, ["x", "é"]), ("b", None, None, None)], COLUMNS)
    put(rows, path, batch="one")
    put(rows, path, batch="one")
    assert sorted(map(tuple, records(path).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    put(rows.limit(1), path, batch="two")
    assert records(path).count() == 3 and len(os.listdir(f"{path}/data")) == 3
    put(rows.where("n IS NULL"), path, "overwrite")
    assert [r.task_id for r in records(path).collect()] == ["b"]
    put(rows.limit(0), path)
    assert records(path).count() == 1 and records(f"{tmp_path}/none").count() == 0


def test_an_aborted_write_leaves_what_was_there(spark, records, tmp_path):
    path = f"{tmp_path}/r"
    put(spark.range(10).select(F.col("id").cast("string").alias("task_id"), F.col("id").alias("n"), F.lit(0.5).alias("x"), F.array(F.lit("t")).alias("tags")), path)
    before = sorted(os.listdir(f"{path}/data"))
    bad = spark.range(20).repartition(4).select(F.col("id").cast("string").alias("task_id"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("n"), F.lit(0.5).alias("x"), F.array(F.lit("t")).alias("tags"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            put(bad, path, mode)
    assert records(path).count() == 10 and sorted(set(before) & set(os.listdir(f"{path}/data"))) == before
    writer = Writer(path, records(path).schema, None, False)
    writer.abort([writer.write(iter([("z", 1, 0.1, [])])), None])
    assert records(path).count() == 10


def test_filters_choose_files(spark, records, tmp_path):
    path = f"{tmp_path}/r"
    for i in range(4):
        put(spark.range(i * 10, i * 10 + 10).coalesce(1).select(F.col("id").cast("string").alias("task_id"), F.col("id").alias("n"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("array<string>").alias("tags")), path)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    reader = lambda *filters: (r := Reader(path, records(path).schema), list(r.pushFilters(list(filters))))[0]
    assert [len(reader(*f).partitions()) for f in ([], [EqualTo(("n",), 15)], [In(("n",), (5, 35, None))], [GreaterThan(("n",), 25), LessThan(("n",), 35)], [EqualTo(("x",), 1.0)], [EqualTo(("n",), "15")])] == [4, 1, 2, 2, 0, 4]
    assert sorted(r.n for r in records(path).where("n > 17 AND n < 22").collect()) == [18, 19, 20, 21]


def test_last_line_wins_by_place(spark, tmp_path):
    schema = files.T.StructType([files.T.StructField("task_id", files.T.StringType()), files.T.StructField("n", files.T.IntegerType())])
    (tmp_path / "log").mkdir()
    want = {}
    for name, begin in (("b.jsonl", 0), ("a.jsonl", 500)):  # the later file has the earlier name
        lines = [json.dumps({"task_id": f"t{i % 37}", "n": begin + i}) for i in range(400)]
        (tmp_path / "log" / name).write_text("\n\n".join(lines) + "\n")
        os.utime(tmp_path / "log" / name, (begin + 1000, begin + 1000))
        want |= {f"t{i % 37}": begin + i for i in range(400)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        got = files.scan_work_log(spark, f"{tmp_path}/log", schema)
        assert dict(map(tuple, got.collect())) == want and got.count() == 37
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.jsonl").write_text('{"task_id": "a", "n": 1}\n{"task_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_work_log(spark, f"{tmp_path}/bad.jsonl", schema).collect()


def test_frames_tell_of_running_queries(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "task_id string, n int").write.json(f"{tmp_path}/in")
    schema, frames, gone = spark.read.json(f"{tmp_path}/in").schema, [], []

    def broken(_):
        raise BrokenPipeError

    listeners = [EventFrames(frames.append), EventFrames(broken, gone.append)]
    for x in listeners:
        spark.streams.addListener(x)
    try:
        query = us.to_table(us.read_log(spark, f"{tmp_path}/in", schema), "framed", f"{tmp_path}/c", "append")
        query.awaitTermination()
        for _ in range(100):
            if any('"complete"' in f for f in frames):
                break
            time.sleep(0.1)
    finally:
        for x in listeners:
            spark.streams.removeListener(x)
    told = [json.loads(f.removeprefix("data: ")) for f in frames if f.endswith("\n\n")]
    assert [t["type"] for t in told][0] == "start" and told[-1]["type"] == "complete" and sum(t.get("rows", 0) for t in told) == 1
    assert {t["stream_id"] for t in told} == {str(query.id)} and gone == [str(query.id)]
