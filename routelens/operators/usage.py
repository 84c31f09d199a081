"""Usage-log analytics: cost, run statistics, threshold advice from replayed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import view, with_views
from .running import running, scan

#: Dollars per million tokens of the billed provider, in and out.
CHEAP_IN, CHEAP_OUT, STRONG_IN, STRONG_OUT = 0.05, 0.2, 0.15, 0.6
BILLED = "fireworks"
#: Thresholds of the lowering replay.
CANDIDATES = (0.3, 0.4, 0.5, 0.55, 0.6, 0.7)
MIN_ACCURACY = 0.72


def _if(condition: Column, value: Column | str) -> Column:
    return F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(F.lit(0))


def usage_cost(log: DataFrame) -> DataFrame:
    """The log with estimated_cost_usd: tokens of a tier cost only if its provider is billed."""
    cost = lambda tier, inward, outward: _if(F.col(f"{tier}_provider") == BILLED, F.col(f"{tier}_prompt_tokens") * F.lit(inward) + F.col(f"{tier}_completion_tokens") * F.lit(outward))
    return log.withColumn("estimated_cost_usd", F.round((cost("cheap", CHEAP_IN, CHEAP_OUT) + cost("strong", STRONG_IN, STRONG_OUT)) / F.lit(1e6), 9))


def billable_tokens(log: DataFrame) -> DataFrame:
    """The log with the tokens of all billed tiers."""
    total = lambda tier: _if(F.col(f"{tier}_provider") == BILLED, F.col(f"{tier}_prompt_tokens") + F.col(f"{tier}_completion_tokens"))
    return log.withColumn("billable", total("cheap") + total("strong"))


def usage_summary(log: DataFrame, *by: str) -> DataFrame:
    """Counts, tokens and cost of a log, or of each group of it."""
    billed = lambda part: _if(F.col("cheap_provider") == BILLED, f"cheap_{part}_tokens") + _if(F.col("strong_provider") == BILLED, f"strong_{part}_tokens")
    n, cheap = F.count(F.lit(1)), F.count_if(F.col("route") == "cheap")
    return usage_cost(log).groupBy(*by).agg(
        n.alias("tasks"),
        cheap.alias("final_local"),
        F.count_if(F.col("route") == "strong").alias("final_remote"),
        F.count_if(F.col("route") == "error").alias("errors"),
        F.count_if("escalated").alias("escalations"),
        F.coalesce(F.sum(billed("prompt")), F.lit(0)).alias("billable_prompt_tokens"),
        F.coalesce(F.sum(billed("completion")), F.lit(0)).alias("billable_completion_tokens"),
        F.coalesce(F.sum("billable_tokens"), F.lit(0)).alias("billable_total_tokens"),
        F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 9).alias("estimated_cost_usd"),
        F.coalesce(F.sum(_if(F.col("cheap_provider") == "local", F.col("cheap_prompt_tokens") + F.col("cheap_completion_tokens"))), F.lit(0)).alias("free_local_tokens"),
        F.round(F.coalesce(F.try_divide(cheap, n), F.lit(0.0)), 3).alias("local_share"),
    )


def run_stats(log: DataFrame, grades: DataFrame) -> DataFrame:
    """A row for each run; accuracy is null where no task is graded."""
    decided = F.col("route") != "error"
    return log.join(grades, "task_id", "left").groupBy("run_id").agg(
        F.coalesce(F.min_by("threshold", F.when(decided, F.col("ord"))), F.lit(0.0)).alias("threshold"),
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("route") == "cheap").alias("local"),
        F.count_if(F.col("route") == "strong").alias("remote"),
        F.count_if("escalated").alias("escalations"),
        F.count_if(~decided).alias("errors"),
        F.sum("billable_tokens").alias("billable"),
        F.sum(F.col("cheap_prompt_tokens") + F.col("cheap_completion_tokens")).alias("free"),
        F.round(F.avg("grade"), 6).alias("accuracy"),
        F.count("grade").alias("graded"),
    )


def threshold_reco(stats: DataFrame, bar: float = MIN_ACCURACY) -> DataFrame:
    """The run of the lowest threshold, then fewest billable tokens, whose accuracy clears the bar."""
    return stats.where(F.col("accuracy") >= bar).orderBy("threshold", "billable", "run_id").limit(1)


def lowering_replay(log: DataFrame, stats: DataFrame, candidates: tuple[float, ...] = CANDIDATES) -> DataFrame:
    """For each run and lower threshold: pre-routed strong tasks that would flip, and the tokens saved."""
    strong = log.where((F.col("route") == "strong") & ~F.col("escalated")).join(stats.select("run_id", F.col("threshold").alias("run_threshold")), "run_id")
    # One pass over the log: a task meets the few candidates it flips at.
    flips = F.filter(F.array(*map(F.lit, candidates)), lambda t: (t <= F.col("confidence")) & (t < F.col("run_threshold")))
    return strong.select("run_id", "billable_tokens", F.explode(flips).alias("candidate")).groupBy("run_id", "candidate").agg(F.count(F.lit(1)).alias("flips"), F.sum("billable_tokens").alias("saved"))


def logprob_rows(log: DataFrame, grades: DataFrame) -> DataFrame:
    """task_id, conf, grade of the first graded cheap answer of each task with a confidence."""
    rows = log.where((F.col("route") == "cheap") & F.col("local_confidence").isNotNull()).join(grades, "task_id")
    return rows.groupBy("task_id").agg(F.min_by(F.struct(F.col("local_confidence").alias("conf"), "grade"), "ord").alias("r")).select("task_id", "r.conf", "r.grade")


def logprob_reco(rows: DataFrame, bar: float = MIN_ACCURACY) -> DataFrame:
    """The lowest gate whose kept answers' mean grade clears the bar, what it keeps, and good answers it escalates.

    Answers are summed for each confidence first; running sums go over the confidences,
    range-partitioned.
    """
    points = rows.groupBy(F.col("conf").alias("t")).agg(F.sum("grade").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") >= 0.5).alias("good"))
    off = rows.agg(F.lit(0.0).alias("t"), F.lit(0.0).alias("g"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good"))
    points = points.unionByName(off).groupBy("t").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    everything = points.agg(F.sum("good").alias("all_good"))
    swept = running(points, [-F.col("t")], above=F.col("g"), kept=F.col("n"), kept_good=F.col("good")).crossJoin(F.broadcast(everything))
    swept = swept.select("t", F.col("above").alias("g"), "kept", (F.col("all_good") - F.col("kept_good")).alias("wasted"))
    return swept.where((F.col("kept") > 0) & (F.col("g") / F.col("kept") >= bar)).orderBy("t").limit(1).select(F.col("t").alias("threshold"), F.round(F.col("g") / F.col("kept"), 6).alias("accuracy"), "kept", "wasted")


def session_totals(log: DataFrame) -> DataFrame:
    """Running totals of each run, in order: asked, cheap answers, billable and local tokens."""
    local = F.col("cheap_prompt_tokens") + F.col("cheap_completion_tokens")
    sums = {"asked": F.lit(1), "cheap": (F.col("route") == "cheap").cast("int"), "billable": F.col("billable_tokens"), "local_tokens": local}
    told = scan(log.select("task_id", "run_id", "ord", *[c.alias(f"_{n}") for n, c in sums.items()]), ["run_id"], [F.col("ord"), F.col("task_id")], **{n: ("sum", F.col(f"_{n}")) for n in sums})
    return told.select("task_id", "run_id", *sums)


def _log(spark, d):
    return view(spark, d, "usage_log")


def _stats(spark, d):
    return run_stats(_log(spark, d), view(spark, d, "grades"))


QUERIES = {
    "run_stats": _stats,
    "usage_summary": lambda s, d: usage_summary(_log(s, d)),
    "usage_cost": lambda s, d: usage_cost(_log(s, d)).select("task_id", "estimated_cost_usd"),
    "billable_tokens": lambda s, d: billable_tokens(_log(s, d)).select("task_id", "billable"),
    "threshold_reco": lambda s, d: threshold_reco(_stats(s, d)),
    "lowering_replay": lambda s, d: lowering_replay(_log(s, d), _stats(s, d)),
    "first_seen": lambda s, d: logprob_rows(_log(s, d), view(s, d, "grades")),
    "logprob_reco": lambda s, d: logprob_reco(logprob_rows(_log(s, d), view(s, d, "grades"))),
    "join_usage_grades": lambda s, d: _log(s, d).join(view(s, d, "grades"), "task_id").select("task_id", "run_id", "route", "grade"),
    "session_totals": lambda s, d: session_totals(_log(s, d)),
    "ext_usage_rollup": lambda s, d: usage_cost(_log(s, d)).rollup("run_id", "route").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("estimated_cost_usd"), 9).alias("cost")),
}

_RUN_STATS = """
SELECT run_id, coalesce(arg_min(threshold, ord) FILTER (WHERE route <> 'error'), 0.0) AS threshold, count(*) AS tasks,
  count(*) FILTER (WHERE route = 'cheap') AS local, count(*) FILTER (WHERE route = 'strong') AS remote, count(*) FILTER (WHERE escalated) AS escalations,
  count(*) FILTER (WHERE route = 'error') AS errors, sum(billable_tokens)::BIGINT AS billable, sum(cheap_prompt_tokens + cheap_completion_tokens)::BIGINT AS free,
  round(avg(grade), 6) AS accuracy, count(grade) AS graded
FROM usage_log LEFT JOIN grades USING (task_id) GROUP BY run_id"""
_COST = f"""round(((CASE WHEN cheap_provider = 'fireworks' THEN cheap_prompt_tokens * {CHEAP_IN}::DOUBLE + cheap_completion_tokens * {CHEAP_OUT}::DOUBLE ELSE 0 END)
  + (CASE WHEN strong_provider = 'fireworks' THEN strong_prompt_tokens * {STRONG_IN}::DOUBLE + strong_completion_tokens * {STRONG_OUT}::DOUBLE ELSE 0 END)) / 1e6::DOUBLE, 9)"""
_FIRST = "SELECT task_id, arg_min(local_confidence, ord) AS conf, arg_min(grade, ord) AS grade FROM usage_log JOIN grades USING (task_id) WHERE route = 'cheap' AND local_confidence IS NOT NULL GROUP BY task_id"
_BOTH = ("usage_log", "grades")
ORACLES = {
    "run_stats": with_views(_RUN_STATS, *_BOTH),
    "usage_summary": with_views(f"""
SELECT count(*) AS tasks, count(*) FILTER (WHERE route = 'cheap') AS final_local, count(*) FILTER (WHERE route = 'strong') AS final_remote,
  count(*) FILTER (WHERE route = 'error') AS errors, count(*) FILTER (WHERE escalated) AS escalations,
  sum(CASE WHEN cheap_provider = 'fireworks' THEN cheap_prompt_tokens ELSE 0 END + CASE WHEN strong_provider = 'fireworks' THEN strong_prompt_tokens ELSE 0 END)::BIGINT AS billable_prompt_tokens,
  sum(CASE WHEN cheap_provider = 'fireworks' THEN cheap_completion_tokens ELSE 0 END + CASE WHEN strong_provider = 'fireworks' THEN strong_completion_tokens ELSE 0 END)::BIGINT AS billable_completion_tokens,
  sum(billable_tokens)::BIGINT AS billable_total_tokens, round(sum({_COST}), 9) AS estimated_cost_usd,
  sum(CASE WHEN cheap_provider = 'local' THEN cheap_prompt_tokens + cheap_completion_tokens ELSE 0 END)::BIGINT AS free_local_tokens,
  round(count(*) FILTER (WHERE route = 'cheap')::DOUBLE / count(*), 3) AS local_share FROM usage_log""", "usage_log"),
    "usage_cost": with_views(f"SELECT task_id, {_COST} AS estimated_cost_usd FROM usage_log", "usage_log"),
    "billable_tokens": with_views("SELECT task_id, billable_tokens AS billable FROM usage_log", "usage_log"),
    "threshold_reco": with_views(f"SELECT * FROM ({_RUN_STATS}) WHERE accuracy >= {MIN_ACCURACY} ORDER BY threshold, billable, run_id LIMIT 1", *_BOTH),
    "lowering_replay": with_views(f"""
SELECT u.run_id, c.t AS candidate, count(*) AS flips, sum(u.billable_tokens)::BIGINT AS saved
FROM usage_log u JOIN ({_RUN_STATS}) r ON r.run_id = u.run_id JOIN (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in CANDIDATES)}]) AS t) c ON u.confidence >= c.t AND c.t < r.threshold
WHERE u.route = 'strong' AND NOT u.escalated GROUP BY u.run_id, c.t""", *_BOTH),
    "first_seen": with_views(_FIRST, *_BOTH),
    "logprob_reco": with_views(f"""
WITH rows AS ({_FIRST}), t AS (SELECT 0.0::DOUBLE AS t UNION SELECT conf FROM rows),
p AS (SELECT t.t, avg(r.grade) FILTER (WHERE r.conf >= t.t) AS acc, count(*) FILTER (WHERE r.conf >= t.t) AS kept, count(*) FILTER (WHERE r.conf < t.t AND r.grade >= 0.5) AS wasted FROM t, rows r GROUP BY t.t)
SELECT t AS threshold, round(acc, 6) AS accuracy, kept, wasted FROM p WHERE kept > 0 AND acc >= {MIN_ACCURACY} ORDER BY t LIMIT 1""", *_BOTH),
    "join_usage_grades": with_views("SELECT task_id, run_id, route, grade FROM usage_log JOIN grades USING (task_id)", *_BOTH),
    "session_totals": with_views("""
SELECT task_id, run_id, count(*) OVER w AS asked, count(*) FILTER (WHERE route = 'cheap') OVER w AS cheap, (sum(billable_tokens) OVER w)::BIGINT AS billable,
  (sum(cheap_prompt_tokens + cheap_completion_tokens) OVER w)::BIGINT AS local_tokens FROM usage_log
WINDOW w AS (PARTITION BY run_id ORDER BY ord ROWS UNBOUNDED PRECEDING)""", "usage_log"),
    "ext_usage_rollup": with_views(f"SELECT run_id, route, count(*) AS tasks, round(sum({_COST}), 9) AS cost FROM usage_log GROUP BY ROLLUP (run_id, route)", "usage_log"),
}
