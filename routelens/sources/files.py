"""Readers and writers of task lists, outcome datasets, logs and graded sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import validate

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType(), "map": T.MapType(T.StringType(), T.StringType()), "strings": T.ArrayType(T.StringType())}


def _fields(text: str) -> T.StructType:
    """Fields as "name kind" pairs; needs no session, unlike DDL."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


TASKS = _fields("task_id string, prompt string, metadata map")
RECORD = _fields(
    "task_id string, prompt string, category string, source string, group_id string, metadata map, local_quality double, remote_quality double, local_ok boolean, "
    "local_prompt_tokens long, local_completion_tokens long, remote_prompt_tokens long, remote_completion_tokens long, local_cost double, remote_cost double, "
    "local_latency_s double, remote_latency_s double, local_confidence double, local_min_token_prob double, local_low_token_frac double, post_check_problems strings"
)
DATASET = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("meta", _KINDS["map"]), T.StructField("records", T.ArrayType(RECORD))])
VERSION = "1.0"


def scan_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of tasks; missing metadata is empty."""
    rows = spark.read.schema(TASKS).option("multiLine", True).json(path)
    return rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def scan_outcomes(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Records of an outcome dataset with their defaults: a JSON file, or a folder that ``sink_outcomes`` wrote.

    Another schema version fails, and so, unless ``check`` is off, does a record that breaks a rule.
    """
    if _there(spark, f"{path}/records"):
        version = spark.read.option("wholetext", True).text(f"{path}/meta.json").select(F.get_json_object("value", "$.schema_version")).first()[0]
        if version != VERSION:
            raise ValueError(f"unsupported schema_version {version}")
        rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(f"{path}/records")
    else:
        raw = spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)
        checked = raw.select(F.when(F.col("schema_version") == VERSION, F.col("records")).otherwise(F.raise_error(F.concat(F.lit("unsupported schema_version "), F.coalesce("schema_version", F.lit("null")))).cast(T.ArrayType(RECORD))).alias("records"))
        rows = checked.select(F.inline("records"))
    zero = {c: F.coalesce(c, F.lit(0).cast(RECORD[c].dataType)) for c in RECORD.names if c.endswith(("_tokens", "_cost", "_latency_s"))}
    named = {c: F.coalesce(c, F.lit("unknown")) for c in ("category", "source")}
    rows = rows.withColumns(zero | named | {"post_check_problems": F.coalesce("post_check_problems", F.array().cast("array<string>"))})
    if check and (bad := validate(rows).limit(20).collect()):
        raise ValueError(f"invalid dataset {path}: {[tuple(b) for b in bad]}")
    return rows


def sink_outcomes(rows: DataFrame, path: str, problems: DataFrame, meta: dict | None = None) -> None:
    """Write records, and beside them version and meta, once a validation has found nothing: records as JSON lines, so in parallel."""
    if bad := problems.limit(3).collect():
        raise ValueError(f"refusing to write an invalid dataset: {bad}")
    rows.select(*[c for c in RECORD.names if c in rows.columns]).write.mode("overwrite").json(f"{path}/records")
    put_text(rows.sparkSession, f"{path}/meta.json", json.dumps({"schema_version": VERSION, "meta": meta or {}}))


def sink_usage_log(rows: DataFrame, path: str) -> None:
    """Append one JSON line for each record, in files of this write's own."""
    rows.write.mode("append").json(path)


def scan_splits(spark: SparkSession, path: str) -> DataFrame:
    """task_id and split: of a training report's folder, or of a JSON file whose ``assignment`` maps one to the other."""
    if _there(spark, f"{path}/splits"):
        return spark.read.schema("task_id string, split string").json(f"{path}/splits")
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "assignment map<string,string>").alias("v"))
    return whole.select(F.explode("v.assignment").alias("task_id", "split"))


def sink_train_report(report: dict, splits: DataFrame, path: str) -> None:
    """report.json, the splits as JSON lines, and a summary of the candidates."""
    spark = splits.sparkSession
    splits.select("task_id", "split").write.mode("overwrite").json(f"{path}/splits")
    put_text(spark, f"{path}/report.json", json.dumps(report, indent=1, default=float, sort_keys=True))
    lines = [f"{'candidate':<20} {'roc_auc':>8} {'brier':>7} {'ece':>6} {'threshold':>9} {'quality':>8} {'cost':>9}"]
    number = lambda v, width, places: f"{'n/a':>{width}}" if v is None else f"{v:>{width}.{places}f}"
    for name, c in report["candidates"].items():
        point = c["point"]
        lines.append(" ".join([f"{name:<20}", number(c["roc_auc"], 8, 3), number(c["brier"], 7, 3), number(c["ece"], 6, 3), number(point["threshold"], 9, 3), number(point["quality_mean"], 8, 3), number(point["cost_total"], 9, 4)]))
    put_text(spark, f"{path}/summary.txt", "\n".join([f"rows by split: {report['sizes']}", f"policy: {report['policy']}", "", *lines, "", f"selected: {report['selected']}", ""]))


def sink_eval_report(results: dict[str, DataFrame], page: str, path: str, meta: dict | None = None) -> None:
    """The parts of an evaluation: large ones (the curves) as JSON lines in a folder each, the others together in
    results.json; a summary of the systems, and the chart as pareto.html.
    """
    spark = results["systems"].sparkSession
    whole: dict = dict(meta or {})
    for name, part in results.items():
        if name == "curves":
            part.write.mode("overwrite").json(f"{path}/curves")
        else:  # a row for each system, category, workload or rate
            whole[name] = sorted((r.asDict() for r in part.collect()), key=lambda r: json.dumps(r, default=str, sort_keys=True))
    put_text(spark, f"{path}/results.json", json.dumps(whole, indent=1, default=float))
    lines = [f"{'system':<20} {'quality':>8} {'cost':>10} {'strong':>7}"]
    lines += [f"{r['system']:<20} {r['quality_mean']:>8.3f} {r['cost_total']:>10.4f} {r['remote_call_rate']:>7.1%}" for r in whole["systems"]]
    for v in whole.get("verdicts", []):
        lines += ["", f"selected: {v['system']}", f"beyond random routing at its rate of strong calls: {v['quality_advantage']:+.4f} (clear: {v['beats_random']})", f"beyond the heuristic: quality {v['quality_diff']:+.4f}, cost {v['cost_diff']:+.4f}", f"short of the oracle: quality {v['oracle_gap_quality']:+.4f}, cost {v['oracle_gap_cost']:+.4f}"]
    put_text(spark, f"{path}/summary.txt", "\n".join([*lines, ""]))
    put_text(spark, f"{path}/pareto.html", page)


def scan_usage_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed ones are passed over."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def scan_grades(spark: SparkSession, path: str) -> DataFrame:
    """task_id and grade of a JSON object whose values are true, false or numbers."""
    pairs = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("task_id", "v"))
    return pairs.select("task_id", F.when(F.col("v") == "true", 1.0).when(F.col("v") == "false", 0.0).otherwise(F.col("v").cast("double")).alias("grade"))


def scan_work_log(spark: SparkSession, path: str, schema: T.StructType, key: str = "task_id") -> DataFrame:
    """The last line of each key in a log of JSON lines, of one file or many, however they are split into tasks.

    A line's place is the time and path of its file, where its block begins there, and its number in the block: all that
    Spark tells of where it read. Blank lines are passed over; a malformed one raises.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.struct("t", "p", "b", "i").alias("place"))
    return rows.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", "place").alias("r")).select("r.*")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what a resumed collection counts as done."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def scan_gsm8k(spark: SparkSession, path: str) -> DataFrame:
    """Questions with the number after the last ####, where it is one."""
    rows = spark.read.schema("question string, answer string").json(path)
    number = F.replace(F.trim(F.regexp_extract("answer", r"####\s*([^\n]+)\s*$", 1)), F.lit(","), F.lit(""))
    return rows.select("question", number.alias("reference")).where(F.col("reference").try_cast("double").isNotNull())


def mmlu_prompt(subject: str, question: Column, options: list[Column]) -> Column:
    """A multiple-choice prompt with lettered options."""
    lines = [F.concat(F.lit(f"({letter}) "), F.trim(o)) for letter, o in zip("ABCD", options, strict=True)]
    head = f"Answer this {subject.replace('_', ' ')} multiple-choice question. Reply with exactly one option letter: A, B, C, or D.\n\n"
    return F.concat(F.lit(head), F.trim(question), F.lit("\nOptions:\n"), F.concat_ws("\n", *lines))


def scan_mmlu(spark: SparkSession, path: str, subject: str) -> DataFrame:
    """Prompts and answer letters of a headerless CSV file; shorter rows are passed over."""
    columns = ["question", "a", "b", "c", "d", "answer"]
    rows = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("multiLine", True).csv(path).where("answer IS NOT NULL")
    return rows.select(mmlu_prompt(subject, F.col("question"), [F.col(c) for c in "abcd"]).alias("prompt"), F.upper(F.trim("answer")).alias("reference"))


def bbh_reference(target: Column) -> Column:
    """(X) as X; any other target trimmed."""
    return F.regexp_replace(F.trim(target), r"^\(([A-Z])\)$", "$1")


def scan_bbh(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a nested JSON file."""
    raw = spark.read.schema("examples array<struct<input:string,target:string>>").option("multiLine", True).json(path)
    return raw.select(F.inline("examples")).select(F.col("input").alias("prompt"), bbh_reference(F.col("target")).alias("reference"))


def sink_results(tasks: DataFrame, answers: DataFrame, path: str) -> None:
    """task_id and answer of every task, in input order (ord), blank where unfinished; the committer renames at the end."""
    results(tasks, answers).write.mode("overwrite").json(path)


def results(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    return tasks.join(answers, "task_id", "left").orderBy("ord").select("task_id", F.coalesce("answer", F.lit("")).alias("answer"))
