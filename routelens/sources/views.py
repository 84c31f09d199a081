"""Input relations of the analytics queries, derived from the given tables.

The text of a view runs in Spark and in DuckDB alike; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "outcomes": """
SELECT CAST(d.doc_id AS STRING) AS task_id, d.doc_id AS ord, d.text AS prompt, d.lang AS category, d.source AS source,
  concat('g-', CAST(d.doc_id % 97 AS STRING)) AS group_id,
  CAST((d.doc_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS local_quality,
  CAST(60 + (d.doc_id * 17) % 41 AS DOUBLE) / CAST(100 AS DOUBLE) AS remote_quality,
  (CAST((d.doc_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE)) >= CAST(0.6 AS DOUBLE) AS local_ok,
  CAST(10 + d.n_chars % 90 AS BIGINT) AS local_prompt_tokens, CAST(5 + (d.doc_id * 13) % 60 AS BIGINT) AS local_completion_tokens,
  CAST(10 + d.n_chars % 90 AS BIGINT) AS remote_prompt_tokens, CAST(8 + (d.doc_id * 29) % 120 AS BIGINT) AS remote_completion_tokens,
  CAST(1 + (d.doc_id * 13) % 60 AS DOUBLE) / CAST(1000 AS DOUBLE) AS local_cost,
  CAST(100 + (d.doc_id * 29) % 120 AS DOUBLE) / CAST(1000 AS DOUBLE) AS remote_cost,
  CAST(20 + (d.doc_id * 7) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS local_latency_s,
  CAST(120 + (d.doc_id * 11) % 90 AS DOUBLE) / CAST(100 AS DOUBLE) AS remote_latency_s,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST((d.doc_id * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS local_confidence,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST((d.doc_id * 59) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS local_min_token_prob,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST((d.doc_id * 61) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS local_low_token_frac,
  CASE WHEN d.doc_id % 13 = 0 THEN 'hedging_or_refusal' ELSE NULL END AS post_check_problem,
  CAST((d.doc_id * 71 + 13) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS p_local,
  l.quality AS label_quality, l.toxic AS label_toxic, d.n_chars AS n_chars
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "usage_log": """
SELECT CAST(event_id AS STRING) AS task_id, event_id AS ord, ts AS event_ts, concat('run-', CAST(user_id % 12 AS STRING)) AS run_id,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('click', 'view') THEN 'cheap' ELSE 'strong' END AS route,
  event_type = 'purchase' AS escalated, CAST(event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE CAST(40 + (user_id % 12) * 3 AS DOUBLE) / CAST(100 AS DOUBLE) END AS threshold,
  CASE WHEN event_type IN ('click', 'view') THEN CAST((event_id * 7) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS local_confidence,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'local' ELSE '' END AS cheap_provider,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'fireworks' ELSE '' END AS strong_provider,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(10 + event_id % 50 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS cheap_prompt_tokens,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(5 + event_id % 70 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS cheap_completion_tokens,
  CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(10 + event_id % 120 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS strong_prompt_tokens,
  CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(10 + event_id % 180 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS strong_completion_tokens,
  CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(20 + event_id % 120 + event_id % 180 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS billable_tokens
FROM {events}""",
    "grades": """
SELECT CAST(event_id AS STRING) AS task_id, CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS grade
FROM {events} WHERE event_id % 5 <> 0""",
    "messages": """
SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, turn AS turn, role AS role, text AS content FROM {conversations}""",
    "jobs": """
SELECT CAST(user_id AS STRING) AS job_id, ts AS due, event_id AS ord,
  CAST(CASE WHEN event_type = 'view' THEN 0 ELSE 15 * (1 + event_id % 8) END AS INT) AS repeat_minutes,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status
FROM {events}""",
}
_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived relation."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(text))})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named relations as common table expressions before it."""
    parts = [f"{n} AS ({_TABLE.sub(r'\1', VIEWS[n])})" for n in names]
    head, _, rest = sql.strip().partition(" ")
    if head.upper() == "WITH":
        recursive = rest.upper().startswith("RECURSIVE ")
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}, {rest[10:] if recursive else rest}"
    return f"WITH {', '.join(parts)} {sql}"
