"""Contracts of tools, replies, citations, artifacts and task sets, as columns over JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashrng import uniform, uniform_sql
from ..sources.digests import file_digests
from ..sources.views import table, view, with_views
from .running import running

#: What a schema may say; another word makes it unusable. Most bytes of a tool's arguments.
_VOCABULARY = {"type", "properties", "required", "additionalProperties", "items", "enum", "minLength", "maxLength", "minItems", "maxItems", "description", "title", "$schema", "default", "minimum", "maximum"}
ARGUMENT_BYTES, MOST = 520_000, 500_000
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "null": "^VOID$"}


def _rules(value: Column, schema: dict, path: str) -> list[tuple[Column, str]]:
    """(broken, message) for each rule of a schema, the outermost first. ``value`` is a variant that is there."""
    if set(schema) - _VOCABULARY:
        raise ValueError(f"{path}: unsupported schema vocabulary {sorted(set(schema) - _VOCABULARY)}")
    kind, of = schema.get("type"), F.schema_of_variant(value)
    out = []
    if kind:
        out.append((~of.rlike(_KINDS[kind]), f"{path}: expected {kind}"))
    if "minimum" in schema or "maximum" in schema:
        number = F.try_variant_get(value, "$", "double")
        low, high = schema.get("minimum", float("-inf")), schema.get("maximum", float("inf"))
        out.append((of.rlike(_KINDS["number"]) & ~number.between(low, high), f"{path}: number outside allowed range"))
    if "enum" in schema:
        out.append((~F.to_json(value).isin([json.dumps(v) for v in schema["enum"]]), f"{path}: value outside allowed choices"))
    if kind == "object":
        keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
        required, known = schema.get("required", []), schema.get("properties", {})
        if required:
            out.append((F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0, f"{path}: missing required fields"))
        if schema.get("additionalProperties") is False:
            out.append((F.size(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))) > 0, f"{path}: unexpected fields"))
        for key, inner in known.items():
            own = F.try_variant_get(value, f"$.{key}", "variant")
            out += [(own.isNotNull() & F.coalesce(broken, F.lit(False)), text) for broken, text in _rules(own, inner, f"{path}.{key}")]
    if kind == "string":
        size = F.length(F.try_variant_get(value, "$", "string"))
        out.append((~size.between(schema.get("minLength", 0), schema.get("maxLength", MOST)), f"{path}: size outside allowed range"))
    if kind == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        out.append((~F.size(items).between(schema.get("minItems", 0), schema.get("maxItems", MOST)), f"{path}: size outside allowed range"))
        if "items" in schema:
            for n, (_, text) in enumerate(_rules(value, schema["items"], f"{path}[]")):
                out.append((F.exists(items, _breaks(schema["items"], n)), text))
    return out


def _breaks(schema: dict, n: int):
    """Whether an item breaks the n-th rule of its schema."""
    return lambda x: F.coalesce(_rules(x, schema, "")[n][0], F.lit(False))


def violation(arguments: Column, schema: dict, path: str = "arguments") -> Column:
    """The first rule of the schema that a JSON text breaks, or null. Booleans are no integers; text that isn't JSON is told so."""
    value = F.try_parse_json(arguments)
    out = F.when(value.isNull(), "invalid JSON").when(F.octet_length(arguments) > ARGUMENT_BYTES, "arguments exceed the limit")
    for broken, text in _rules(value, schema, path):
        out = out.when(F.coalesce(broken, F.lit(False)), text)
    return out


def decision(reply: Column, tools: dict[str, dict]) -> Column:
    """tool, arguments, answer and error of a reply: one object with a final answer or with one enabled tool, perhaps in a fence."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"(?s)^```[^\n]*\n?(.*)```$", "$1"))
    value = F.try_parse_json(bare)
    keys = F.array_sort(F.coalesce(F.json_object_keys(bare), F.array().cast("array<string>")))
    is_answer, is_call = keys == F.array(F.lit("answer")), keys == F.array(F.lit("arguments"), F.lit("tool"))
    answer = F.when(F.schema_of_variant(F.try_variant_get(value, "$.answer", "variant")) == "STRING", F.try_variant_get(value, "$.answer", "string"))
    tool, arguments = F.try_variant_get(value, "$.tool", "string"), F.to_json(F.try_variant_get(value, "$.arguments", "variant"))
    broken = F.lit(None).cast("string")
    for name, schema in tools.items():
        broken = F.when(tool == name, violation(arguments, schema)).otherwise(broken)
    error = (
        F.when(value.isNull(), "invalid JSON")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "not one decision object")
        .when(is_answer, F.when(answer.isNull(), "answer is no text").when(F.trim(answer) == "", "empty answer"))
        .when(~is_call | ~F.coalesce(tool.isin(list(tools)), F.lit(False)), "neither an enabled tool nor an answer")
        .otherwise(broken)
    )
    good = error.isNull()
    return F.struct(F.when(good & is_call, tool).alias("tool"), F.when(good & is_call, arguments).alias("arguments"), F.when(good & is_answer, answer).alias("answer"), error.alias("error"))


def tool_call_text(name: Column, arguments: Column) -> Column:
    """A tool request as a fenced block, backticks escaped; null for an invalid name or arguments that are no object. JSON is compact."""
    value = F.try_parse_json(F.coalesce(arguments, F.lit("{}")))
    good = name.rlike(r"^[A-Za-z_][A-Za-z0-9_.-]{0,99}$") & F.schema_of_variant(value).startswith("OBJECT")
    return F.when(good, F.concat(F.lit("```"), name, F.lit("\n"), F.replace(F.to_json(value), F.lit("`"), F.lit("\\u0060")), F.lit("\n```")))


def uncited(answers: DataFrame, reads: DataFrame) -> DataFrame:
    """run_id and url of each link in an answer (run_id, content) that the run has not read (run_id, url, ok)."""
    cited = answers.select("run_id", F.explode(T.urls(F.col("content"))).alias("url")).distinct()
    return cited.join(reads.where("ok").select("run_id", "url").distinct(), ["run_id", "url"], "left_anti")


def pair_accepted(tier: Column, cheap: Column, strong: Column, configured: tuple[str, str, str]) -> Column:
    """Whether an artifact may serve the configured (tier, cheap, strong); one without a tier may."""
    same = (F.lower(F.trim(tier)) == configured[0].strip().lower()) & cheap.eqNullSafe(configured[1]) & strong.eqNullSafe(configured[2])
    return F.when(tier.isNull() | (tier == ""), True).otherwise(same)


def task_problems(tasks: DataFrame) -> DataFrame:
    """task_id and problem of a task set: repeated ids, prompts alike but for case and blanks, graders, empty references."""
    norm = F.trim(F.regexp_replace(F.lower("prompt"), r"(?U)\s+", " "))
    rules = F.array_compact(F.array(F.when(~F.coalesce(F.col("grader").isin("numeric", "choice"), F.lit(False)), "unsupported grader"), F.when(F.coalesce("reference", F.lit("")) == "", "empty reference")))
    own = tasks.select("task_id", F.explode(rules).alias("problem"))
    ids = tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id", F.lit("duplicate task_id").alias("problem"))
    alike = tasks.groupBy(F.sha2(norm, 256).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("task_id")).where("n > 1")
    return own.unionByName(ids).unionByName(alike.select("task_id", F.lit("duplicate normalized prompt").alias("problem")))


def union_task_sets(parts: list[DataFrame], seed: int = 7) -> DataFrame:
    """The rows of all parts with their place in a seeded order by hash: no part stands as a block."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return running(both.withColumn("_u", uniform(seed, F.col("task_id"))), [F.col("_u"), F.col("task_id")], place=F.lit(1)).drop("_u")


#: A tool's schema, as the workspace has them.
LABELS = {
    "type": "object", "required": ["id", "add"], "additionalProperties": False,
    "properties": {"id": {"type": "string", "minLength": 1, "maxLength": 6}, "add": {"type": "array", "items": {"type": "string", "maxLength": 8}, "maxItems": 3}, "n": {"type": "integer", "minimum": 0, "maximum": 60}, "mode": {"enum": ["a", "b"]}},
}
_ADDED = ('["x"]', '["x", "click"]', '["much too long"]', '["x", 1]', '"x"', '["a", "b", "c", "d"]', "[]")
_NUMBERS = ("7", "true", "1.5", '"7"', "null", "61", "0")


def _payload(k: Column) -> Column:
    pick = lambda of, i: F.element_at(F.array(*map(F.lit, of)), (i + 1).cast("int"))
    name = F.when(k % 13 == 0, "").otherwise(k.cast("string"))
    more = F.when(k % 11 == 0, ', "x": 1').when(k % 11 == 1, ', "mode": "c"').when(k % 11 == 2, ', "mode": "b"').otherwise("")
    body = F.concat(F.when(k % 17 == 0, "").otherwise(F.concat(F.lit('"id": "'), name, F.lit('", '))), F.lit('"add": '), pick(_ADDED, k % 7), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(', "n": '), pick(_NUMBERS, F.floor(k / 7) % 7))), more)
    return F.concat(F.lit("{"), body, F.when(k % 29 == 0, "").otherwise("}"))


def _replies(s, d) -> DataFrame:
    """A model's reply for each event: answers and calls, good and bad, some fenced."""
    k = F.col("event_id")
    call = F.concat(F.lit('{"tool": "'), F.when(k % 4 == 0, "other").otherwise("labels"), F.lit('", "arguments": '), _payload(k), F.lit("}"))
    body = F.when(k % 3 == 0, call).when(k % 9 == 1, F.concat(F.lit('{"answer": "done '), k.cast("string"), F.lit('"}'))).when(k % 9 == 4, '{"answer": " "}').when(k % 9 == 7, '{"answer": 5}').when(k % 9 == 2, '[1]').when(k % 9 == 5, "done").otherwise('{"answer": "x", "tool": "labels"}')
    return table(s, d, "events").select("event_id", F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("reply"))


def _cited(s, d) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    answers = table(s, d, "pages").select((k % 40).alias("run_id"), F.concat(F.lit("see ("), url, F.lit("), https://x.y/"), (k % 6).cast("string"), F.lit(".")).alias("content"))
    reads = table(s, d, "pages").select((k % 40).alias("run_id"), F.regexp_replace(url, r"[.,;:!?)\]}'\"]+$", "").alias("url"), (k % 3 != 0).alias("ok"))
    return uncited(answers, reads.unionByName(table(s, d, "nation").selectExpr("n_nationkey AS run_id", "'https://x.y/1' AS url", "true AS ok")))


def _pairs(s, d) -> DataFrame:
    k = F.col("n_nationkey")
    tier = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").when(k % 5 == 2, " Remote_Pair ").otherwise("remote_pair")
    return table(s, d, "nation").select("n_nationkey", pair_accepted(tier, F.when(k % 3 == 0, "small").otherwise("tiny"), F.when(k % 7 != 6, F.lit("big")), ("remote_pair", "small", "big")).alias("accepted"))


def _tasks(s, d) -> DataFrame:
    k = F.col("ord")
    return view(s, d, "outcomes").select(F.when(k % 90 == 7, "twice").otherwise(F.col("task_id")).alias("task_id"), "prompt", F.when(k % 31 == 0, "exact").when(k % 2 == 0, "numeric").otherwise("choice").alias("grader"), F.when(k % 37 == 0, "").otherwise("A").alias("reference"))


def _sets(s, d) -> DataFrame:
    named = lambda t, key, text, label: table(s, d, t).select(F.concat(F.lit(f"{label}-"), F.col(key).cast("string")).alias("task_id"), F.lit(label).alias("category"), F.length(text).alias("size"))
    return union_task_sets([named("benchmark", "item_id", "text", "math"), named("pages", "page_id", "url", "world"), named("nation", "n_nationkey", "n_name", "logic")])


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _file_hashes(s, d) -> DataFrame:
    """Digests of the files of all tables, whole."""
    rows = file_digests(s, [f"{d}/{t}.parquet" for t in TABLES])
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "length")


QUERIES = {
    "schema_contract": lambda s, d: table(s, d, "events").select("event_id", violation(_payload(F.col("event_id")), LABELS).alias("violation")),
    "decision_parse": lambda s, d: _replies(s, d).select("event_id", decision(F.col("reply"), {"labels": LABELS}).alias("x")).select("event_id", "x.tool", F.xxhash64("x.arguments").isNotNull().alias("parsed"), "x.answer", F.coalesce("x.error", F.lit("")).alias("error")).drop("parsed"),
    "tool_call_text": lambda s, d: table(s, d, "events").select("event_id", tool_call_text(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("9"), "event_type")).otherwise(F.col("event_type")), F.when(F.col("event_id") % 7 == 0, F.lit("[1]")).when(F.col("event_id") % 7 == 1, F.lit('{"a": "`b`"}')).otherwise(F.col("props"))).alias("block")),
    "citation_anti": _cited,
    "pair_validate": _pairs,
    "task_set_validate": lambda s, d: task_problems(_tasks(s, d)),
    "union_task_sets": _sets,
    "file_sha256": _file_hashes,
}

_P = f"""(SELECT event_id AS k, concat('{{', CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('"id": "', CASE WHEN event_id % 13 = 0 THEN '' ELSE event_id::VARCHAR END, '", ') END, '"add": ', [{", ".join(f"'{a}'" for a in _ADDED)}][event_id % 7 + 1],
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(', "n": ', [{", ".join(f"'{a}'" for a in _NUMBERS)}][event_id // 7 % 7 + 1]) END, CASE event_id % 11 WHEN 0 THEN ', "x": 1' WHEN 1 THEN ', "mode": "c"' WHEN 2 THEN ', "mode": "b"' ELSE '' END, CASE WHEN event_id % 29 = 0 THEN '' ELSE '}}' END) AS p FROM events)"""
_NUMBER = "json_type(p, '$.n') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
#: The contract, rule by rule, by DuckDB's own JSON functions.
_BROKEN = f"""CASE WHEN NOT json_valid(p) THEN 'invalid JSON' WHEN NOT json_exists(p, '$.id') OR NOT json_exists(p, '$.add') THEN 'arguments: missing required fields'
  WHEN len(list_filter(json_keys(p), lambda x: x NOT IN ('id', 'add', 'n', 'mode'))) > 0 THEN 'arguments: unexpected fields'
  WHEN length(p->>'$.id') NOT BETWEEN 1 AND 6 THEN 'arguments.id: size outside allowed range'
  WHEN json_type(p, '$.add') <> 'ARRAY' THEN 'arguments.add: expected array' WHEN json_array_length(p, '$.add') > 3 THEN 'arguments.add: size outside allowed range'
  WHEN len(list_filter(json_type(p, ['$.add[0]', '$.add[1]', '$.add[2]']), lambda x: x <> 'VARCHAR')) > 0 THEN 'arguments.add[]: expected string'
  WHEN len(list_filter(json_extract_string(p, ['$.add[0]', '$.add[1]', '$.add[2]']), lambda x: length(x) > 8)) > 0 THEN 'arguments.add[]: size outside allowed range'
  WHEN json_exists(p, '$.n') AND json_type(p, '$.n') NOT IN ('UBIGINT', 'BIGINT') THEN 'arguments.n: expected integer' WHEN {_NUMBER} AND (p->>'$.n')::DOUBLE > 60 THEN 'arguments.n: number outside allowed range'
  WHEN json_exists(p, '$.mode') AND (p->>'$.mode') NOT IN ('a', 'b') THEN 'arguments.mode: value outside allowed choices' END"""
_TASK_NORM = "trim(regexp_replace(lower(prompt), '[\\s\\x{00A0}]+', ' ', 'g'))"
ORACLES = {
    "schema_contract": f"SELECT k AS event_id, {_BROKEN} AS violation FROM {_P}",
    "decision_parse": f"""
WITH r AS (SELECT k, p, {_BROKEN} AS broken FROM {_P}), e AS (SELECT k, CASE WHEN k % 3 = 0 THEN CASE WHEN broken = 'invalid JSON' THEN broken WHEN k % 4 = 0 THEN 'neither an enabled tool nor an answer' ELSE coalesce(broken, '') END
  ELSE CASE k % 9 WHEN 1 THEN '' WHEN 4 THEN 'empty answer' WHEN 7 THEN 'answer is no text' WHEN 2 THEN 'not one decision object' WHEN 5 THEN 'invalid JSON' ELSE 'neither an enabled tool nor an answer' END END AS error FROM r)
SELECT k AS event_id, CASE WHEN error = '' AND k % 3 = 0 THEN 'labels' END AS tool, CASE WHEN error = '' AND k % 9 = 1 THEN concat('done ', k) END AS answer, error FROM e""",
    "tool_call_text": "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN concat('```', event_type, chr(10), CASE WHEN event_id % 7 = 1 THEN concat('{\"a\":\"', '\\u0060b\\u0060', '\"}') ELSE replace(props, ' ', '') END, chr(10), '```') END AS block FROM events",
    "citation_anti": """
WITH c AS (SELECT DISTINCT page_id % 40 AS run_id, unnest([regexp_replace(url, '[.,;:!?)\\]}''"]+$', ''), concat('https://x.y/', page_id % 6)]) AS url FROM pages),
r AS (SELECT page_id % 40 AS run_id, regexp_replace(url, '[.,;:!?)\\]}''"]+$', '') AS url FROM pages WHERE page_id % 3 <> 0 UNION SELECT n_nationkey, 'https://x.y/1' FROM nation)
SELECT run_id, url FROM c EXCEPT SELECT run_id, url FROM r""",
    "pair_validate": "SELECT n_nationkey, n_nationkey % 5 < 2 OR (n_nationkey % 3 = 0 AND n_nationkey % 7 <> 6) AS accepted FROM nation",
    "task_set_validate": with_views(f"""
WITH t AS (SELECT CASE WHEN ord % 90 = 7 THEN 'twice' ELSE task_id END AS task_id, ord, {_TASK_NORM} AS norm FROM outcomes)
SELECT task_id, 'unsupported grader' AS problem FROM t WHERE ord % 31 = 0 UNION ALL SELECT task_id, 'empty reference' FROM t WHERE ord % 37 = 0
UNION ALL SELECT task_id, 'duplicate task_id' FROM t GROUP BY task_id HAVING count(*) > 1 UNION ALL SELECT min(task_id), 'duplicate normalized prompt' FROM t GROUP BY norm HAVING count(*) > 1""", "outcomes"),
    "union_task_sets": f"""
WITH t AS (SELECT concat('math-', item_id) AS task_id, 'math' AS category, length(text)::INT AS size FROM benchmark UNION ALL SELECT concat('world-', page_id), 'world', length(url)::INT FROM pages UNION ALL SELECT concat('logic-', n_nationkey), 'logic', length(n_name)::INT FROM nation)
SELECT task_id, category, size, row_number() OVER (ORDER BY {uniform_sql("'7'", "task_id")}, task_id) AS place FROM t""",
}
