import hashlib
import json
import os
import random

import pytest

from routelens.operators import splits
from routelens.sources import digests, files


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tasks_and_results(spark, tmp_path):
    path = write(tmp_path / "tasks.json", json.dumps([{"task_id": "a", "prompt": "p", "metadata": None}, {"task_id": "b", "prompt": "q", "metadata": {"k": "v"}}]))
    tasks = files.scan_tasks(spark, path)
    assert [r.metadata for r in tasks.orderBy("task_id").collect()] == [{}, {"k": "v"}]
    ordered = tasks.selectExpr("task_id", "CASE task_id WHEN 'a' THEN 2 ELSE 1 END AS ord")
    files.sink_results(ordered, spark.createDataFrame([("a", "x")], "task_id string, answer string"), f"{tmp_path}/out")
    assert [tuple(r) for r in files.results(ordered, spark.createDataFrame([("a", "x")], "task_id string, answer string")).collect()] == [("b", ""), ("a", "x")]
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_outcome_dataset(spark, tmp_path):
    record = {"task_id": "a", "prompt": "p", "local_quality": 0.9, "remote_quality": 1.0, "local_ok": True}
    path = write(tmp_path / "d.json", json.dumps({"schema_version": "1.0", "meta": {"quality_threshold": 0.6}, "records": [record]}))
    rows = files.scan_outcomes(spark, path)
    r = rows.first()
    assert (r.category, r.local_cost, r.local_prompt_tokens, r.post_check_problems, r.local_confidence) == ("unknown", 0.0, 0, [], None)
    files.sink_outcomes(rows, f"{tmp_path}/out", splits.validate(rows))
    again = files.scan_outcomes(spark, f"{tmp_path}/out")
    assert again.columns == rows.columns and [tuple(x) for x in again.collect()] == [tuple(r)]
    with pytest.raises(ValueError, match="invalid dataset"):
        files.scan_outcomes(spark, write(tmp_path / "bad.json", json.dumps({"schema_version": "1.0", "meta": {}, "records": [record | {"local_quality": 7.0}]})))
    bad = rows.selectExpr("* EXCEPT (local_quality)", "2.0D AS local_quality")
    with pytest.raises(ValueError):
        files.sink_outcomes(bad, f"{tmp_path}/out2", splits.validate(bad))
    with pytest.raises(Exception, match="unsupported schema_version"):
        files.scan_outcomes(spark, write(tmp_path / "old.json", json.dumps({"schema_version": "0.1", "meta": {}, "records": [record]}))).collect()


def test_logs_and_grades(spark, tmp_path):
    schema = files.T.StructType([files.T.StructField("task_id", files.T.StringType()), files.T.StructField("n", files.T.IntegerType())])
    log = files.scan_usage_log(spark, write(tmp_path / "log.jsonl", '{"task_id": "a", "n": 1}\n\n{"task_id": "b", \n{"task_id": "a", "n": 2}\n'), schema)
    assert sorted(tuple(r) for r in log.collect()) == [("a", 1), ("a", 2)]
    assert [tuple(r) for r in files.latest_by(log, "task_id", "n").collect()] == [("a", 2)]
    grades = files.scan_grades(spark, write(tmp_path / "g.json", '{"a": true, "b": false, "c": 0.25}'))
    assert dict(map(tuple, grades.collect())) == {"a": 1.0, "b": 0.0, "c": 0.25}


def test_graded_sources(spark, tmp_path):
    lines = [{"question": "q1", "answer": "work\n#### 1,200"}, {"question": "q2", "answer": "none"}, {"question": "q3", "answer": "#### many"}]
    got = files.scan_gsm8k(spark, write(tmp_path / "g.jsonl", "\n".join(map(json.dumps, lines)))).collect()
    assert [tuple(r) for r in got] == [("q1", "1200")]
    got = files.scan_mmlu(spark, write(tmp_path / "m.csv", '"What, now?",1,2,3, 4 ,b\nshort,1\n'), "high_school")
    assert got.first().reference == "B" and got.first().prompt.endswith("What, now?\nOptions:\n(A) 1\n(B) 2\n(C) 3\n(D) 4") and got.count() == 1
    got = files.scan_bbh(spark, write(tmp_path / "b.json", json.dumps({"examples": [{"input": "i", "target": "(C)"}, {"input": "j", "target": " yes "}]}))).collect()
    assert [r.reference for r in got] == ["C", "yes"]


def test_usage_log_splits_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, n int")
    files.sink_usage_log(rows, f"{tmp_path}/log")
    files.sink_usage_log(rows.limit(1), f"{tmp_path}/log")
    assert files.scan_usage_log(spark, f"{tmp_path}/log", rows.schema).count() == 3
    got = files.scan_splits(spark, write(tmp_path / "splits.json", json.dumps({"seed": 7, "assignment": {"a": "train", "b": "test"}})))
    assert dict(map(tuple, got.collect())) == {"a": "train", "b": "test"}
    systems = spark.createDataFrame([("x", 0.5, 1.0, 0.2), ("oracle", 0.9, 1.0, 0.2)], "system string, quality_mean double, cost_total double, remote_call_rate double")
    curve = spark.createDataFrame([(0.1, 0.5)], "threshold double, quality_mean double")
    files.sink_eval_report({"systems": systems, "curves": curve}, "<p>chart</p>", f"{tmp_path}/eval", {"split": "test"})
    found = json.loads((tmp_path / "eval" / "results.json").read_text())
    assert [r["system"] for r in found["systems"]] == ["x", "oracle"] and found["split"] == "test"
    assert spark.read.json(f"{tmp_path}/eval/curves").first().threshold == 0.1 and "oracle" in (tmp_path / "eval" / "summary.txt").read_text()
    assert (tmp_path / "eval" / "pareto.html").read_text() == "<p>chart</p>"


def test_digests_of_large_files(spark, tmp_path):
    rng = random.Random(3)
    made = {"a b.parquet": rng.randbytes(400_000), "ends.parquet": rng.randbytes(99_999) + b"\n", "two.parquet": b"PAR1\r\n\n" * 30_000 + b"\n\n", "line.parquet": b"x" * 300_000, "marks.parquet": b"\n" * 150_000, "small.parquet": b"\xef\xbb\xbfabc"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        for link in (50_000, 120_000, 1 << 30):
            found = digests.file_digests(spark, [str(tmp_path)], whole=1000, link=link).collect()
            assert {(os.path.basename(r.path), r.length, r.sha256) for r in found} == {(n, len(x), hashlib.sha256(x).hexdigest()) for n, x in made.items()}
        (tmp_path / "mark.parquet").write_bytes(b"\xef\xbb\xbf" + b"x" * 2000)
        with pytest.raises(Exception, match="were read as lines"):
            digests.file_digests(spark, [str(tmp_path / "mark.parquet")], whole=1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
