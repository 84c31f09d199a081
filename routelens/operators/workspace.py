"""Jobs, runs and ledgers of a workspace as pure functions of tables and a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.views import table, view, with_views
from . import indexes
from .running import quantiles, scan
from .transitions import NEXT, OPEN, TIMEOUT, run_states, saves

NOW = "2024-01-20 12:00:00"
#: Most requests, tokens, dollars, seconds and validation errors of a run.
LIMITS = {"requests": 8, "tokens": 20000, "cost": 0.10, "seconds": 180, "errors": 3}


def next_due(anchor: Column, now: Column, minutes: Column) -> Column:
    """The next time of an interval after now, at least one interval past the anchor; null without an interval."""
    step = minutes.cast("long") * 60_000_000
    begin = F.unix_micros(anchor.cast("timestamp"))
    past = F.unix_micros(now) - begin
    gone = (past - F.pmod(past, F.when(step > 0, step))) / step + 1
    return F.when(step > 0, F.timestamp_micros(begin + F.greatest(F.lit(1), gone.cast("long")) * step))


def next_daily(anchor: Column, now: Column, zone: str) -> Column:
    """The next UTC time of the anchor's wall time in a zone, strictly after now; a gap rolls forward, of a fold the first."""
    wall = F.from_utc_timestamp(anchor, zone)
    of = lambda day: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.date_format(wall, "HH:mm:ss"))), zone)
    today = F.to_date(F.from_utc_timestamp(now, zone))
    return F.when(of(today) > now, of(today)).otherwise(of(F.date_add(today, 1)))


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "pending") & (F.col("due") <= now))


def claim(jobs: DataFrame) -> DataFrame:
    """One occurrence for each (job, due): that of the earliest order."""
    return jobs.groupBy("job_id", "due").agg(F.min_by(F.struct("ord", "repeat_minutes", "status"), "ord").alias("r")).select("job_id", "due", "r.ord", "r.repeat_minutes", "r.status")


def tick(jobs: DataFrame, now: Column) -> DataFrame:
    """Claimed occurrences that are due, with when their job is due next."""
    return claim(due_jobs(jobs, now)).select("job_id", "due", "ord", F.when(F.col("repeat_minutes") > 0, next_due(F.col("due"), now, F.col("repeat_minutes"))).alias("next"))


def latest_occurrences(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The last n occurrences of each job, in one row."""
    last = W.partitionBy("job_id").orderBy(F.desc("ord"))
    rows = jobs.withColumn("k", F.row_number().over(last)).where(F.col("k") <= n)
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("occurrences"))


def run_usage(steps: DataFrame) -> DataFrame:
    """Totals of each run over its steps (run_id, attempts, kind, tokens, cost, seconds, invalid)."""
    return steps.groupBy("run_id").agg(F.sum("attempts").alias("requests"), F.count_if(F.col("kind") == "model").alias("model_steps"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.sum("seconds"), 6).alias("seconds"), F.count_if("invalid").alias("errors"))


def over_budget(usage: DataFrame) -> DataFrame:
    """The run and each limit it has reached."""
    each = F.array_compact(F.array(*[F.when(F.col(c) >= limit, F.lit(c)) for c, limit in LIMITS.items()]))
    return usage.select("run_id", F.explode(each).alias("reached"))


def ledger(events: DataFrame) -> DataFrame:
    """Last state of each action; a request that differs from the action's first is a mismatch."""
    return events.groupBy("action_id").agg(F.max_by("state", "ord").alias("state"), (F.count_distinct("request") > 1).alias("mismatch"), F.count(F.lit(1)).alias("events"))


def revisions(changes: DataFrame) -> DataFrame:
    """Changes of an item with their version, what they replaced, and whether they are current."""
    told = scan(changes.select("item", "ord", "content"), ["item"], [F.col("ord")], version=("sum", F.lit(1)), replaced=("lag", F.col("content")), later=("lead", F.col("ord")))
    return told.select("item", "ord", F.col("version").cast("int").alias("version"), "replaced", F.col("later").isNull().alias("current"))


def latencies(rows: DataFrame) -> DataFrame:
    """Median, 95th percentile by nearest rank, and number of each model's values."""
    found = quantiles(rows, "model", "value", median=("linear", 0.5), p95=("nearest", 0.95))
    sizes = rows.groupBy("model").agg(F.count("value").alias("n"))
    return found.join(sizes, "model").select("model", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "n")


def _jobs(s, d):
    return view(s, d, "jobs")


_now = lambda: F.lit(NOW).cast("timestamp")


def _steps(s, d):
    e, k = table(s, d, "events"), F.col("event_id")
    return e.select(F.concat(F.lit("r"), (k % 400).cast("string")).alias("run_id"), (1 + k % 3).alias("attempts"), F.when(k % 2 == 0, "model").otherwise("tool").alias("kind"), (k % 2000).alias("tokens"), ((k % 17).cast("double") / F.lit(1000.0)).alias("cost"), (k % 23).cast("double").alias("seconds"), (k % 11 == 0).alias("invalid"))


_STEPS = "(SELECT concat('r', (event_id % 400)::VARCHAR) AS run_id, 1 + event_id % 3 AS attempts, CASE WHEN event_id % 2 = 0 THEN 'model' ELSE 'tool' END AS kind, event_id % 2000 AS tokens, (event_id % 17)::DOUBLE / 1000.0::DOUBLE AS cost, (event_id % 23)::DOUBLE AS seconds, event_id % 11 = 0 AS invalid FROM events)"


def _changes(s, d):
    return table(s, d, "events").select((F.col("user_id") % 40).alias("item"), F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").alias("content"))


def _ledger(s, d):
    k = F.col("event_id")
    return table(s, d, "events").select(F.substring(F.sha2((k % 700).cast("string"), 256), 1, 12).alias("action_id"), k.alias("ord"), F.col("event_type").alias("state"), (F.col("user_id") % 2 + k % 700 % 2).alias("request"))


def _runs(s, d):
    """Steps of runs: most in an order that runs may take, some out of it."""
    k = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, STEPS)), (F.floor(k / 300) % len(STEPS) + 1).cast("int"))
    odd = F.element_at(F.array(*map(F.lit, STEPS)), (F.col("user_id") % len(STEPS) + 1).cast("int"))
    return table(s, d, "events").select((k % 300).alias("run_id"), F.col("ts").cast("timestamp").alias("at"), k.alias("ord"), F.when(k % 7 == 3, odd).otherwise(state).alias("state"))


def _saves(s, d):
    """Saves of items, most made from the version before, some from none in particular or from one that is gone."""
    rows = _changes(s, d).select("item", F.col("ord").alias("at"), "content")
    known = scan(rows, ["item"], [F.col("at")], before=("lag", F.col("at")))
    expected = F.when(F.col("at") % 5 == 0, F.lit(None)).when(F.col("at") % 11 == 0, F.col("at") - 1000).otherwise(F.col("before"))
    return saves(known.select("item", "at", expected.alias("expected"), "content"))


def item_search(items: DataFrame, term: str, kind: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Items (id, kind, title, content, updated) of a kind whose title or content holds the term in any case, the newest first;
    as many as a list shows. ValueError for an unknown kind.
    """
    if kind is not None and kind not in ITEM_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    index = indexes.run_index(items, "id", "title", "content") if index is None else index
    found = indexes.holding(items if kind is None else items.where(F.col("kind") == kind), index, "id", term, "title", "content")
    listed = found.select("id", "kind", "updated").orderBy(F.desc("updated"), "id").limit(LISTED)
    return listed.select("id", "kind", F.row_number().over(W.orderBy(F.desc("updated"), "id")).alias("place"))


def _searched(s, d) -> DataFrame:
    """Several searches over pages as items, by one index."""
    kind = F.element_at(F.array(*map(F.lit, ITEM_KINDS)), (F.col("page_id") % len(ITEM_KINDS) + 1).cast("int"))
    items = table(s, d, "pages").select(F.col("page_id").alias("id"), kind.alias("kind"), F.col("url").alias("title"), F.col("html").alias("content"), (F.col("page_id") * 7919 % 1000).alias("updated"))
    index, out = indexes.run_index(items, "id", "title", "content"), None
    for i, (term, of) in enumerate(SEARCHES):
        own = item_search(items, term, of, index).select(F.lit(i).alias("search"), "id", "kind", "place")
        out = own if out is None else out.unionByName(own)
    return out


#: States that the steps of the query's runs go through.
STEPS = ("queued", "running", "awaiting_review", "queued", "running", "cancelling", "cancelled", "completed", "failed")
#: Kinds of items; the length of a list of them.
ITEM_KINDS, LISTED = ("note", "brief", "code", "file", "action"), 500
#: Terms and kinds that the query looks for: a word, none, one letter, one with a wildcard, one of a title.
SEARCHES = (("Article", None), ("", "note"), ("q", "brief"), ("div%cla_s", "code"), ("HTTPS://", "file"), ("no such run", None))
_ITEMS_SQL = "(SELECT page_id AS id, ['note', 'brief', 'code', 'file', 'action'][page_id % 5 + 1] AS kind, url AS title, html AS content, page_id * 7919 % 1000 AS updated FROM pages)"

QUERIES = {
    "next_due": lambda s, d: _jobs(s, d).select("ord", next_due(F.col("due"), _now(), F.col("repeat_minutes")).alias("next")),
    "due_filter": lambda s, d: due_jobs(_jobs(s, d), _now()).select("ord", "job_id"),
    "occurrence_claim": lambda s, d: claim(_jobs(s, d)),
    "scheduler_tick": lambda s, d: tick(_jobs(s, d), _now()),
    "jobs_with_occurrences": lambda s, d: latest_occurrences(_jobs(s, d)),
    "run_usage": lambda s, d: run_usage(_steps(s, d)),
    "budget_check": lambda s, d: over_budget(run_usage(_steps(s, d))),
    "action_ledger": lambda s, d: ledger(_ledger(s, d)),
    "revisions": lambda s, d: revisions(_changes(s, d)),
    "optimistic_revision": _saves,
    "run_state_machine": lambda s, d: run_states(_runs(s, d)),
    "orphan_jobs": lambda s, d: _jobs(s, d).where("status = 'failed'").select("job_id").distinct().join(_jobs(s, d).where("repeat_minutes > 100").select("job_id").distinct(), "job_id", "left_anti"),
    "occurrence_status": lambda s, d: _jobs(s, d).select("ord", (F.col("ord") % 450).alias("run_id")).join(run_states(_runs(s, d)), "run_id", "left").select("ord", F.coalesce("state", F.lit("interrupted")).alias("status")),
    "item_search": _searched,
    "items_list": lambda s, d: table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(500).select("doc_id", "n_chars"),
    "json_decode": lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k")),
    "median_p95": lambda s, d: latencies(table(s, d, "events").select(F.col("event_type").alias("model"), "value")),
}
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, follow in NEXT.items() for b in follow)
_OPEN = ", ".join(f"'{o}'" for o in OPEN)
_RUNS_SQL = f"""
WITH RECURSIVE legal(a, b) AS (VALUES {_PAIRS}),
steps AS (SELECT event_id % 300 AS run_id, ts AS tm, event_id AS ord, {list(STEPS)}[CASE WHEN event_id % 7 = 3 THEN user_id % {len(STEPS)} + 1 ELSE floor(event_id / 300)::BIGINT % {len(STEPS)} + 1 END] AS told FROM events),
n AS (SELECT *, row_number() OVER o AS i, coalesce(epoch_us(tm) - epoch_us(lag(tm) OVER o) > {TIMEOUT} * 1000000::BIGINT, false) AS late FROM steps WINDOW o AS (PARTITION BY run_id ORDER BY tm, ord)),
walk AS (SELECT DISTINCT run_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS accepted, 0::BIGINT AS refused FROM steps
  UNION ALL SELECT run_id, i, CASE WHEN ok THEN told ELSE held END, accepted + ok::INT, refused + (NOT ok)::INT
  FROM (SELECT *, EXISTS (SELECT 1 FROM legal WHERE a = held AND b = told) AS ok FROM (
    SELECT n.run_id, n.i, n.told, w.accepted, w.refused, CASE WHEN n.late AND w.state IN ({_OPEN}) THEN 'interrupted' ELSE w.state END AS held FROM walk w JOIN n ON n.run_id = w.run_id AND n.i = w.i + 1))),
ended AS (SELECT run_id, CASE WHEN arg_max(state, i) IN ({_OPEN}) THEN 'interrupted' ELSE arg_max(state, i) END AS state, max(accepted) AS accepted, max(refused) AS refused FROM walk GROUP BY run_id)"""
ORACLES = {
    "next_due": with_views(f"SELECT ord, CASE WHEN repeat_minutes > 0 THEN make_timestamp(epoch_us(due) + greatest(1, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(due))::DOUBLE / (repeat_minutes * 60000000::BIGINT))::BIGINT + 1) * repeat_minutes * 60000000) END AS next FROM jobs", "jobs"),
    "due_filter": with_views(f"SELECT ord, job_id FROM jobs WHERE status = 'pending' AND due <= TIMESTAMP '{NOW}'", "jobs"),
    "occurrence_claim": with_views("SELECT job_id, due, min(ord) AS ord, arg_min(repeat_minutes, ord) AS repeat_minutes, arg_min(status, ord) AS status FROM jobs GROUP BY job_id, due", "jobs"),
    "scheduler_tick": with_views(f"""
WITH c AS (SELECT job_id, due, min(ord) AS ord, arg_min(repeat_minutes, ord) AS repeat_minutes FROM jobs WHERE status = 'pending' AND due <= TIMESTAMP '{NOW}' GROUP BY job_id, due)
SELECT job_id, due, ord, CASE WHEN repeat_minutes > 0 THEN make_timestamp(epoch_us(due) + greatest(1, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(due))::DOUBLE / (repeat_minutes * 60000000::BIGINT))::BIGINT + 1) * repeat_minutes * 60000000) END AS next FROM c""", "jobs"),
    "jobs_with_occurrences": with_views("SELECT job_id, count(*) AS n, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS occurrences FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord DESC) AS k FROM jobs) WHERE k <= 20 GROUP BY job_id", "jobs"),
    "run_usage": f"SELECT run_id, sum(attempts)::BIGINT AS requests, count(*) FILTER (WHERE kind = 'model') AS model_steps, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost, round(sum(seconds), 6) AS seconds, count(*) FILTER (WHERE invalid) AS errors FROM {_STEPS} GROUP BY run_id",
    "budget_check": f"""
WITH u AS (SELECT run_id, sum(attempts) AS requests, sum(tokens) AS tokens, round(sum(cost), 6) AS cost, sum(seconds) AS seconds, count(*) FILTER (WHERE invalid) AS errors FROM {_STEPS} GROUP BY run_id)
{' UNION ALL '.join(f"SELECT run_id, '{c}' AS reached FROM u WHERE {c} >= {v}" for c, v in LIMITS.items())}""",
    "action_ledger": "SELECT substr(sha256((event_id % 700)::VARCHAR), 1, 12) AS action_id, arg_max(event_type, event_id) AS state, count(DISTINCT user_id % 2 + event_id % 700 % 2) > 1 AS mismatch, count(*) AS events FROM events GROUP BY 1",
    "revisions": "SELECT user_id % 40 AS item, event_id AS ord, (row_number() OVER w)::INT AS version, lag(json_extract_string(props, '$.k')) OVER w AS replaced, lead(event_id) OVER w IS NULL AS current FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY event_id)",
    "run_state_machine": f"{_RUNS_SQL} SELECT run_id, state, accepted, refused FROM ended",
    "optimistic_revision": """
WITH RECURSIVE e AS (SELECT user_id % 40 AS item, event_id AS tm, json_extract_string(props, '$.k') AS content, row_number() OVER w AS i, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY event_id)),
x AS (SELECT item, tm, content, i, CASE WHEN tm % 5 = 0 THEN NULL WHEN tm % 11 = 0 THEN tm - 1000 ELSE before END AS expected FROM e),
w AS (SELECT DISTINCT item, 0::BIGINT AS i, NULL::BIGINT AS current, 0::BIGINT AS version, NULL::VARCHAR AS held, NULL::BIGINT AS tm, NULL::BIGINT AS expected, NULL::VARCHAR AS content, NULL::BOOLEAN AS taken, NULL::VARCHAR AS replaced FROM e
  UNION ALL SELECT item, i, CASE WHEN ok THEN tm ELSE current END, version + ok::INT, CASE WHEN ok THEN content ELSE held END, tm, expected, content, ok, CASE WHEN ok THEN held END
  FROM (SELECT x.*, w.current, w.version, w.held, coalesce(x.expected = w.current, x.expected IS NULL) AS ok FROM w JOIN x ON x.item = w.item AND x.i = w.i + 1))
SELECT item, tm AS "at", expected, content, taken, version, replaced FROM w WHERE i > 0""",
    "orphan_jobs": with_views("SELECT DISTINCT job_id FROM jobs WHERE status = 'failed' AND job_id NOT IN (SELECT job_id FROM jobs WHERE repeat_minutes > 100)", "jobs"),
    "occurrence_status": f"{_RUNS_SQL} SELECT event_id AS ord, coalesce(s.state, 'interrupted') AS status FROM events e LEFT JOIN ended s ON s.run_id = e.event_id % 450",
    "item_search": " UNION ALL ".join(f"(SELECT {i} AS search, id, kind, row_number() OVER (ORDER BY updated DESC, id) AS place FROM {_ITEMS_SQL} WHERE {'true' if kind is None else f"kind = '{kind}'"} AND (title ILIKE '%{term}%' OR content ILIKE '%{term}%') ORDER BY updated DESC, id LIMIT {LISTED})" for i, (term, kind) in enumerate(SEARCHES)),
    "items_list": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 500",
    "json_decode": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "median_p95": "SELECT event_type AS model, round(quantile_cont(value, 0.5), 6) AS median, round(list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1], 6) AS p95, count(*) AS n FROM events GROUP BY event_type",
}
