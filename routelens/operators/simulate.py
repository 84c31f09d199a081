"""Replay of routing and escalation on recorded outcomes, and its summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import view, with_views

ROUTE_AT = 0.5


@dataclass(frozen=True)
class Cascade:
    """Whether cheap answers escalate, and on which statistic below which gate."""

    escalation: bool = True
    gate_stat: str = "mean"
    gate_threshold: float = 0.4
    post_check: bool = True


def gate_confidence(stat: str) -> Column:
    """Confidence of a recorded cheap answer; higher is safer; null is no signal."""
    found = {"mean": F.col("local_confidence"), "min": F.col("local_min_token_prob"), "low_frac": F.lit(1.0) - F.col("local_low_token_frac"), "none": F.lit(None).cast("double")}
    if stat not in found:
        raise ValueError(f"unknown gate statistic {stat!r}")
    return found[stat]


def would_escalate(cascade: Cascade) -> Column:
    """A flagged answer escalates, and one whose confidence is known and below the gate."""
    if not cascade.escalation:
        return F.lit(False)
    low = F.coalesce(gate_confidence(cascade.gate_stat) < cascade.gate_threshold, F.lit(False))
    return F.col("post_check_problem").isNotNull() | low if cascade.post_check else low


def simulate(outcomes: DataFrame, route: Column, cascade: Cascade = Cascade()) -> DataFrame:
    """Outcomes with what routing them so delivers; an escalated row pays for both answers. No shuffle."""
    rows = outcomes.withColumn("route_local", route).withColumn("escalated", F.col("route_local") & would_escalate(cascade))
    kept = F.col("route_local") & ~F.col("escalated")
    paid = lambda name: F.when(kept, F.col(f"local_{name}")).when(F.col("escalated"), F.col(f"local_{name}") + F.col(f"remote_{name}")).otherwise(F.col(f"remote_{name}"))
    return rows.withColumns({"final_local": kept, "quality": F.when(kept, F.col("local_quality")).otherwise(F.col("remote_quality")), "cost": paid("cost"), "latency": paid("latency_s"), "unsafe_local": kept & ~F.col("local_ok")})


def _rate(flag: Column) -> Column:
    return F.round(F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)), 6)


def summarize(rows: DataFrame, *by: str) -> DataFrame:
    """Means, totals and rates of a simulation, or of each group of it; zeros where it is empty."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        mean("quality").alias("quality_mean"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost_total"),
        mean("cost").alias("cost_mean"),
        mean("latency").alias("latency_mean"),
        _rate(~F.col("route_local") | F.col("escalated")).alias("remote_call_rate"),
        _rate(F.col("final_local")).alias("local_utilisation"),
        _rate(F.col("route_local")).alias("pre_route_local_rate"),
        _rate(F.col("escalated")).alias("escalation_rate"),
        _rate(F.col("unsafe_local")).alias("unsafe_local_rate"),
        F.count_if("unsafe_local").alias("unsafe_local_count"),
    )


def systems(outcomes: DataFrame, score: str = "p_local", threshold: float = ROUTE_AT) -> DataFrame:
    """Simulations of the baselines and of a score, told apart by ``system``, from one scan."""
    alone = Cascade(escalation=False)
    made = [
        simulate(outcomes, F.lit(True), alone).withColumn("system", F.lit("all_local")),
        simulate(outcomes, F.lit(False)).withColumn("system", F.lit("all_remote")),
        simulate(outcomes, F.col("local_ok"), alone).withColumn("system", F.lit("oracle")),
        simulate(outcomes, F.col(score) >= threshold).withColumn("system", F.lit("score")),
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def system_report(outcomes: DataFrame) -> DataFrame:
    """Summary of each system with its saving and regret against the strong model alone."""
    own = summarize(systems(outcomes), "system")
    base = own.where("system = 'all_remote'").select(F.col("cost_total").alias("c"), F.col("quality_mean").alias("q"))
    saved = F.col("c") - F.col("cost_total")
    return own.crossJoin(F.broadcast(base)).select("system", "quality_mean", "cost_total", F.round(saved, 6).alias("cost_saved"), F.round(F.coalesce(F.try_divide(saved, F.col("c")), F.lit(0.0)), 6).alias("cost_saved_pct"), F.round(F.col("q") - F.col("quality_mean"), 6).alias("quality_regret"))


def hard_categories(outcomes: DataFrame) -> DataFrame:
    """Categories whose cheap quality is below the median of the categories'."""
    own = outcomes.groupBy("category").agg(F.avg("local_quality").alias("q"))
    middle = own.agg(F.percentile("q", F.lit(0.5)).alias("median"))
    return own.crossJoin(F.broadcast(middle)).where("q < median").select("category", F.round("q", 6).alias("quality_mean"))


def mixture_weights(outcomes: DataFrame) -> DataFrame:
    """Weight of each category in the balanced, easy-heavy and hard-heavy workloads; a side without categories is all of them."""
    cats = outcomes.select("category").distinct().join(hard_categories(outcomes).select("category", F.lit(True).alias("h")), "category", "left").select("category", F.col("h").isNotNull().alias("hard"))
    sizes = cats.agg(F.count(F.lit(1)).alias("n"), F.count_if("hard").alias("k"))
    n, k = F.col("n"), F.col("k")
    easy_n, hard_n = F.when(n > k, n - k).otherwise(n), F.when(k > 0, k).otherwise(n)
    # Where a side is all categories, the later, hard weight holds.
    in_hard = F.col("hard") | (k == 0)
    weigh = lambda easy, hard: F.when(in_hard, F.lit(hard) / hard_n).otherwise(F.lit(easy) / easy_n)
    made = (("balanced", F.lit(1.0) / n), ("easy_heavy", weigh(0.8, 0.2)), ("hard_heavy", weigh(0.2, 0.8)))
    each = F.array(*[F.struct(F.lit(m).alias("mixture"), w.alias("w")) for m, w in made])
    return cats.crossJoin(F.broadcast(sizes)).select("category", F.explode(each).alias("m")).select("category", "m.mixture", "m.w")


def mixtures(outcomes: DataFrame) -> DataFrame:
    """Weighted metrics of each system under each workload."""
    per_category = summarize(systems(outcomes), "system", "category")
    metrics = ("quality_mean", "cost_mean", "unsafe_local_rate", "remote_call_rate")
    rows = per_category.join(mixture_weights(outcomes), "category")
    return rows.groupBy("system", "mixture").agg(*[F.round(F.sum(F.col("w") * F.col(m)) / F.sum("w"), 4).alias(m) for m in metrics])


def route_decision(outcomes: DataFrame, forced: dict[str, str] | None = None, threshold: float = ROUTE_AT) -> DataFrame:
    """Target of each task: its category's forced route, else by the score, inclusive."""
    by_score = F.when(F.col("p_local") >= threshold, F.lit("cheap")).otherwise(F.lit("strong"))
    pairs = [F.lit(x) for kv in (forced or {}).items() for x in kv]
    target = F.coalesce(F.create_map(*pairs)[F.col("category")], by_score) if pairs else by_score
    return outcomes.select("task_id", target.alias("target"))


def _out(s, d):
    return view(s, d, "outcomes")


def _simulated(s, d):
    rows = simulate(_out(s, d), F.col("p_local") >= ROUTE_AT)
    return rows.select("task_id", "route_local", "final_local", "escalated", "quality", F.round("cost", 6).alias("cost"), F.round("latency", 6).alias("latency"), "unsafe_local")


def _gates(s, d):
    return _out(s, d).select("task_id", *[F.round(gate_confidence(g), 6).alias(f"gate_{g}") for g in ("mean", "min", "low_frac", "none")])


QUERIES = {
    "gate_confidence": _gates,
    "would_escalate": lambda s, d: _out(s, d).select("task_id", would_escalate(Cascade()).alias("mean_gate"), would_escalate(Cascade(gate_stat="low_frac", post_check=False)).alias("low_frac_gate")),
    "simulate": _simulated,
    "sim_summary": lambda s, d: summarize(simulate(_out(s, d), F.col("p_local") >= ROUTE_AT)),
    "per_category": lambda s, d: summarize(simulate(_out(s, d), F.col("p_local") >= ROUTE_AT), "category"),
    "baselines": lambda s, d: summarize(systems(_out(s, d)), "system"),
    "system_report": lambda s, d: system_report(_out(s, d)),
    "hard_categories": lambda s, d: hard_categories(_out(s, d)),
    "mixtures": lambda s, d: mixtures(_out(s, d)),
    "route_decision": lambda s, d: route_decision(_out(s, d), {"es": "strong"}),
}


def _sim_sql(route: str, system: str, cascade: bool = True) -> str:
    escalate = "(post_check_problem IS NOT NULL OR coalesce(local_confidence < 0.4, false))" if cascade else "false"
    return f"""
SELECT '{system}' AS system, *, CASE WHEN final_local THEN local_quality ELSE remote_quality END AS quality,
  CASE WHEN final_local THEN local_cost WHEN escalated THEN local_cost + remote_cost ELSE remote_cost END AS cost,
  CASE WHEN final_local THEN local_latency_s WHEN escalated THEN local_latency_s + remote_latency_s ELSE remote_latency_s END AS latency,
  final_local AND NOT local_ok AS unsafe_local
FROM (SELECT *, route_local AND {escalate} AS escalated, route_local AND NOT {escalate} AS final_local FROM (SELECT *, {route} AS route_local FROM outcomes))"""


_SUMMARY = """count(*) AS n, round(avg(quality), 6) AS quality_mean, round(sum(cost), 6) AS cost_total, round(avg(cost), 6) AS cost_mean, round(avg(latency), 6) AS latency_mean,
  round(avg((NOT route_local OR escalated)::INT), 6) AS remote_call_rate, round(avg(final_local::INT), 6) AS local_utilisation, round(avg(route_local::INT), 6) AS pre_route_local_rate,
  round(avg(escalated::INT), 6) AS escalation_rate, round(avg(unsafe_local::INT), 6) AS unsafe_local_rate, count(*) FILTER (WHERE unsafe_local) AS unsafe_local_count"""
_ROUTED = _sim_sql(f"p_local >= {ROUTE_AT}", "score")
SYSTEMS_SQL = " UNION ALL ".join([_sim_sql("true", "all_local", False), _sim_sql("false", "all_remote"), _sim_sql("local_ok", "oracle", False), _ROUTED])
_HARD = "SELECT category, q FROM (SELECT category, avg(local_quality) AS q FROM outcomes GROUP BY category) WHERE q < (SELECT quantile_cont(q, 0.5) FROM (SELECT avg(local_quality) AS q FROM outcomes GROUP BY category))"
ORACLES = {
    "gate_confidence": with_views("SELECT task_id, round(local_confidence, 6) AS gate_mean, round(local_min_token_prob, 6) AS gate_min, round(1.0 - local_low_token_frac, 6) AS gate_low_frac, NULL::DOUBLE AS gate_none FROM outcomes", "outcomes"),
    "would_escalate": with_views("SELECT task_id, post_check_problem IS NOT NULL OR coalesce(local_confidence < 0.4, false) AS mean_gate, coalesce(1.0::DOUBLE - local_low_token_frac < 0.4::DOUBLE, false) AS low_frac_gate FROM outcomes", "outcomes"),
    "simulate": with_views(f"SELECT task_id, route_local, final_local, escalated, quality, round(cost, 6) AS cost, round(latency, 6) AS latency, unsafe_local FROM ({_ROUTED})", "outcomes"),
    "sim_summary": with_views(f"SELECT {_SUMMARY} FROM ({_ROUTED})", "outcomes"),
    "per_category": with_views(f"SELECT category, {_SUMMARY} FROM ({_ROUTED}) GROUP BY category", "outcomes"),
    "baselines": with_views(f"SELECT system, {_SUMMARY} FROM ({SYSTEMS_SQL}) GROUP BY system", "outcomes"),
    "system_report": with_views(f"""
WITH own AS (SELECT system, {_SUMMARY} FROM ({SYSTEMS_SQL}) GROUP BY system), base AS (SELECT cost_total AS c, quality_mean AS q FROM own WHERE system = 'all_remote')
SELECT system, quality_mean, cost_total, round(c - cost_total, 6) AS cost_saved, round((c - cost_total) / c, 6) AS cost_saved_pct, round(q - quality_mean, 6) AS quality_regret FROM own, base""", "outcomes"),
    "hard_categories": with_views(f"SELECT category, round(q, 6) AS quality_mean FROM ({_HARD})", "outcomes"),
    "mixtures": with_views(f"""
WITH own AS (SELECT system, category, {_SUMMARY} FROM ({SYSTEMS_SQL}) GROUP BY system, category),
cats AS (SELECT DISTINCT category, category IN (SELECT category FROM ({_HARD})) AS hard FROM outcomes), sizes AS (SELECT count(*) AS n, count(*) FILTER (WHERE hard) AS k FROM cats),
w AS (SELECT category, 'balanced' AS mixture, 1.0::DOUBLE / n AS w FROM cats, sizes
  UNION ALL SELECT category, 'easy_heavy', CASE WHEN hard OR k = 0 THEN 0.2::DOUBLE / CASE WHEN k > 0 THEN k ELSE n END ELSE 0.8::DOUBLE / CASE WHEN n > k THEN n - k ELSE n END END FROM cats, sizes
  UNION ALL SELECT category, 'hard_heavy', CASE WHEN hard OR k = 0 THEN 0.8::DOUBLE / CASE WHEN k > 0 THEN k ELSE n END ELSE 0.2::DOUBLE / CASE WHEN n > k THEN n - k ELSE n END END FROM cats, sizes)
SELECT system, mixture, round(sum(w * quality_mean) / sum(w), 4) AS quality_mean, round(sum(w * cost_mean) / sum(w), 4) AS cost_mean, round(sum(w * unsafe_local_rate) / sum(w), 4) AS unsafe_local_rate,
  round(sum(w * remote_call_rate) / sum(w), 4) AS remote_call_rate FROM own JOIN w USING (category) GROUP BY system, mixture""", "outcomes"),
    "route_decision": with_views(f"SELECT task_id, CASE WHEN category = 'es' THEN 'strong' WHEN p_local >= {ROUTE_AT} THEN 'cheap' ELSE 'strong' END AS target FROM outcomes", "outcomes"),
}
