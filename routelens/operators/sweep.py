"""Threshold sweeps and the policies that choose an operating point.

Instead of replaying all rows for each threshold, rows are summed once for each
step between candidate thresholds and both of their possible outcomes; a
threshold's totals are then a suffix sum of the cheap outcomes and a prefix sum of
the strong ones. Thresholds are rounded scores, so the sums have at most
10 ** digits rows whatever the size of the table: the running sums stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.views import view, with_views
from .simulate import _SUMMARY, Cascade, _sim_sql, simulate

#: Fixed values of the policies: above any probability; share of quality kept; unsafe rate; prices; rate of strong calls.
ALL_STRONG = 1.000001
KEEP_QUALITY, MOST_UNSAFE, COST_WEIGHT, LATENCY_WEIGHT, STRONG_RATE = 0.97, 0.05, 1.0, 0.0, 0.5
_SUMS = ("quality", "cost", "latency", "strong", "final", "esc", "unsafe")


def candidate_thresholds(outcomes: DataFrame, digits: int = 6) -> DataFrame:
    """0, every score rounded, and one above all scores."""
    ends = outcomes.sparkSession.createDataFrame([(0.0,), (ALL_STRONG,)], "threshold double")
    return outcomes.select(F.round("p_local", digits).alias("threshold")).union(ends).distinct()


def sweep(outcomes: DataFrame, cascade: Cascade = Cascade(), digits: int = 6) -> DataFrame:
    """Summary of the cascade at each candidate threshold (cheap where the score is at least that)."""
    unit = F.lit(float(10**digits))
    step = F.floor(F.col("p_local") * unit)
    step = F.when((step + 1) / unit <= F.col("p_local"), step + 1).when(step / unit > F.col("p_local"), step - 1).otherwise(step)
    outcomes = outcomes.withColumn("step", step)
    sums = lambda rows: rows.groupBy("step").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quality").alias("quality"), F.sum("cost").alias("cost"), F.sum("latency").alias("latency"),
        F.sum((~F.col("route_local") | F.col("escalated")).cast("long")).alias("strong"), F.sum(F.col("final_local").cast("long")).alias("final"),
        F.sum(F.col("escalated").cast("long")).alias("esc"), F.sum(F.col("unsafe_local").cast("long")).alias("unsafe"))
    cheap = sums(simulate(outcomes, F.lit(True), cascade)).select("step", *[F.col(c).alias(f"c_{c}") for c in ("rows", *_SUMS)])
    strong = sums(simulate(outcomes, F.lit(False), cascade)).select("step", *[F.col(c).alias(f"s_{c}") for c in _SUMS])
    at_step = cheap.join(strong, "step").withColumn("threshold", F.col("step") / unit)
    # A step is the greatest threshold that its scores reach; a score that rounds up doesn't reach its own.
    marks = candidate_thresholds(outcomes, digits).select("threshold", F.lit(True).alias("mark"))
    line = at_step.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    up = W.orderBy(F.col("threshold"), F.desc("mark")).rowsBetween(0, W.unboundedFollowing)
    down = W.orderBy(F.col("threshold"), F.desc("mark")).rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(f"c_{c}").over(up), F.lit(0)) + F.coalesce(F.sum(f"s_{c}").over(down), F.lit(0))
    swept = line.select("threshold", "mark", F.sum("c_rows").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"), F.coalesce(F.sum("c_rows").over(up), F.lit(0)).alias("pre"), *[total(c).alias(c) for c in _SUMS]).where("mark")
    rate = lambda c, name: F.round(F.col(c) / F.col("n"), 6).alias(name)
    return swept.select("threshold", "n", rate("quality", "quality_mean"), F.round("cost", 6).alias("cost_total"), rate("cost", "cost_mean"), rate("latency", "latency_mean"), rate("strong", "remote_call_rate"), rate("final", "local_utilisation"), rate("pre", "pre_route_local_rate"), rate("esc", "escalation_rate"), rate("unsafe", "unsafe_local_rate"), F.col("unsafe").alias("unsafe_local_count"))


def quality_floor(points: DataFrame, keep: float = KEEP_QUALITY) -> DataFrame:
    """The cheapest point that keeps a share of the strong model's quality; ties to the higher threshold."""
    floor = points.where(F.col("threshold") >= ALL_STRONG).select((F.col("quality_mean") * keep).alias("floor"))
    return points.crossJoin(F.broadcast(floor)).where("quality_mean >= floor").orderBy("cost_total", F.desc("threshold")).limit(1).drop("floor")


def max_unsafe(points: DataFrame, most: float = MOST_UNSAFE) -> DataFrame:
    """The most cheap answers at a bounded unsafe rate; then the least cost, then the lowest threshold."""
    return points.where(F.col("unsafe_local_rate") <= most).orderBy(F.desc("local_utilisation"), "cost_total", "threshold").limit(1)


def utility(points: DataFrame, cost: float = COST_WEIGHT, latency: float = LATENCY_WEIGHT) -> DataFrame:
    """The greatest quality less weighted cost and latency; ties to the lowest threshold."""
    worth = F.round(F.col("quality_mean") - F.lit(cost) * F.col("cost_mean") - F.lit(latency) * F.col("latency_mean"), 6)
    return points.orderBy(F.desc(worth), "threshold").limit(1)


def remote_rate(points: DataFrame, target: float = STRONG_RATE) -> DataFrame:
    """The rate of strong calls nearest to a target; then the least cost, then the lowest threshold."""
    return points.orderBy(F.round(F.abs(F.col("remote_call_rate") - target), 6), "cost_total", "threshold").limit(1)


POLICIES = {"quality_floor": quality_floor, "max_unsafe": max_unsafe, "utility": utility, "remote_rate": remote_rate}


def _points(s, d):
    return sweep(view(s, d, "outcomes"))


QUERIES = {
    "candidate_thresholds": lambda s, d: candidate_thresholds(view(s, d, "outcomes")),
    "sweep_cross": _points,
    "threshold_curve_4": lambda s, d: sweep(view(s, d, "outcomes"), digits=4),
} | {f"policy_{name}": (lambda s, d, f=f: f(_points(s, d))) for name, f in POLICIES.items()}


def _sweep_sql(digits: int) -> str:
    routed = _sim_sql("p_local >= threshold", "x").replace("FROM outcomes)", "FROM outcomes, t)")
    return f"SELECT threshold, {_SUMMARY} FROM ({routed}) GROUP BY threshold"


def _t(digits: int) -> str:
    return f"WITH t AS (SELECT DISTINCT round(p_local, {digits}) AS threshold FROM outcomes UNION SELECT 0.0::DOUBLE UNION SELECT {ALL_STRONG}::DOUBLE)"


_SWEPT = f"{_t(6)}, points AS ({_sweep_sql(6)})"
ORACLES = {
    "candidate_thresholds": with_views(f"{_t(6)} SELECT threshold FROM t", "outcomes"),
    "sweep_cross": with_views(f"{_SWEPT} SELECT * FROM points", "outcomes"),
    "threshold_curve_4": with_views(f"{_t(4)} {_sweep_sql(4)}", "outcomes"),
    "policy_quality_floor": with_views(f"{_SWEPT} SELECT * FROM points WHERE quality_mean >= (SELECT quality_mean * {KEEP_QUALITY}::DOUBLE FROM points WHERE threshold >= {ALL_STRONG}::DOUBLE) ORDER BY cost_total, threshold DESC LIMIT 1", "outcomes"),
    "policy_max_unsafe": with_views(f"{_SWEPT} SELECT * FROM points WHERE unsafe_local_rate <= {MOST_UNSAFE}::DOUBLE ORDER BY local_utilisation DESC, cost_total, threshold LIMIT 1", "outcomes"),
    "policy_utility": with_views(f"{_SWEPT} SELECT * FROM points ORDER BY round(quality_mean - {COST_WEIGHT}::DOUBLE * cost_mean - {LATENCY_WEIGHT}::DOUBLE * latency_mean, 6) DESC, threshold LIMIT 1", "outcomes"),
    "policy_remote_rate": with_views(f"{_SWEPT} SELECT * FROM points ORDER BY round(abs(remote_call_rate - {STRONG_RATE}::DOUBLE), 6), cost_total, threshold LIMIT 1", "outcomes"),
}
