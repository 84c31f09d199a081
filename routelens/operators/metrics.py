"""Ranking, calibration and resampling statistics of a score against a binary label."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashrng import uniform, uniform_sql
from ..sources.views import view, with_views
from .running import running
from .simulate import _SUMMARY, SYSTEMS_SQL, simulate, systems

ROUTE_AT = 0.5
#: Inner edges of ten equal bins as doubles of i * 0.1.
EDGES = tuple(i * 0.1 for i in range(1, 10))
RESAMPLES, TRIALS, LEVEL = 1000, 50, 0.05
GRID = tuple(i / 20 for i in range(21))


def confusion(scored: DataFrame, threshold: float = ROUTE_AT) -> DataFrame:
    """Counts of label y against score p at least the threshold."""
    hit = F.col("p") >= threshold
    return scored.agg(*[F.count_if((hit if h else ~hit) & (F.col("y") == y)).alias(name) for name, h, y in (("tp", True, 1), ("fp", True, 0), ("fn", False, 1), ("tn", False, 0))])


def brier(scored: DataFrame) -> DataFrame:
    """Mean squared difference of score and label, and the label's rate."""
    return scored.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))), 6).alias("brier"), F.round(F.avg("y"), 6).alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def ece(scored: DataFrame) -> DataFrame:
    """Gap of label rate and mean score in ten equal bins, weighted by their rows."""
    at = sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in EDGES[1:]), F.when(F.col("p") >= EDGES[0], 1).otherwise(0))
    bins = scored.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"))
    return bins.agg(F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), F.lit(0.0)), 6).alias("ece"))


def _levels(scored: DataFrame, *by: str) -> DataFrame:
    """Positives and rows of each distinct score."""
    return scored.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where only one label occurs.

    Running sums go over distinct scores; a group's begin where the one before it ends.
    """
    neg = F.col("n") - F.col("pos")
    rows = running(_levels(scored, *by), [*map(F.col, by), F.col("p")], upto=neg).withColumn("neg", neg)
    pairs = F.sum("pos") * F.sum("neg")
    beaten = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) - F.min(F.col("upto") - F.col("neg")) * F.sum("pos")
    return rows.groupBy(*by).agg(F.round(F.try_divide(beaten, F.when(pairs > 0, pairs)), 6).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Average precision of the score; null without a positive or a negative."""
    rows = running(_levels(scored), [-F.col("p")], tp=F.col("pos"), seen=F.col("n"))
    total, rest = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return rows.agg(F.round(F.when((total > 0) & (rest > 0), F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / total), 6).alias("average_precision"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision for the label and, with flipped scores, for its absence."""
    flipped = scored.select((1 - F.col("y")).alias("y"), (-F.col("p")).alias("p"))
    return average_precision(scored).select(F.col("average_precision").alias("pr_auc_ok")).crossJoin(F.broadcast(average_precision(flipped).select(F.col("average_precision").alias("pr_auc_fail"))))


def rank_avg(scored: DataFrame) -> DataFrame:
    """Ascending rank of each distinct score, ties averaged, and its rows."""
    return running(_levels(scored), [F.col("p")], upto=F.col("n")).select("p", "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def postgen_auc(outcomes: DataFrame, least: int = 20) -> DataFrame:
    """Area under the curve of each recorded confidence statistic, over rows that have all of them."""
    full = outcomes.where("local_confidence IS NOT NULL AND local_min_token_prob IS NOT NULL AND local_low_token_frac IS NOT NULL")
    stats = F.array(*[F.struct(F.lit(n).alias("stat"), c.alias("p")) for n, c in (("mean", F.col("local_confidence")), ("min", F.col("local_min_token_prob")), ("low_frac", 1.0 - F.col("local_low_token_frac")))])
    long = full.select(F.col("local_ok").cast("int").alias("y"), F.explode(stats).alias("s")).select("y", "s.stat", "s.p")
    sizes = long.groupBy("stat").agg(F.count(F.lit(1)).alias("n"))
    return roc_auc(long, "stat").join(sizes, "stat").where(F.col("n") >= least)


#: Inverse of the Poisson distribution of mean 1: a draw's weight is the number of these it reaches.
_STEPS = tuple(sum(0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[: k + 1]) for k in range(8))
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def draws(keys: list[str], seed: int, begin: int, end: int) -> np.ndarray:
    """Numbers in [0, 1) of the resamples from begin to end, a row for each key: a counter mixed with the key's digest."""
    base = np.array([int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") for k in keys], np.uint64)
    with np.errstate(over="ignore"):
        z = base[:, None] + (np.arange(begin, end, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(_GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX2)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def bootstrap(rows: DataFrame, value: str, seed: int, resamples: int = RESAMPLES) -> DataFrame:
    """Point and percentile interval of a mean by Poisson weights of hashed draws.

    A row's weight in a resample depends on its key alone, so rows needn't be numbered and
    each is read once; a task sums all resamples of its rows before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                keys, v = own["key"].to_pylist(), np.array(own["v"], np.float64)
                for begin in range(0, resamples, 1024):
                    end = min(begin + 1024, resamples)
                    w = np.searchsorted(_STEPS, draws(keys, seed, begin, end), side="right").astype(np.float64)
                    total[begin:end] += v @ w
                    weight[begin:end] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(weight)], ["r", "total", "weight"])

    own = rows.where(F.col(value).isNotNull()).select("key", F.col(value).cast("double").alias("v"))
    means = own.mapInArrow(run, "r long, total double, weight double").groupBy("r").agg((F.sum("total") / F.sum("weight")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(LEVEL / 2)).alias("lo"), F.percentile("m", F.lit(1 - LEVEL / 2)).alias("hi"))
    return rows.agg(F.avg(value).alias("point")).crossJoin(F.broadcast(ends)).select(*[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])


def _two_outcomes(outcomes: DataFrame) -> DataFrame:
    """Both outcomes of each row: cheap first (with the cascade), and strong."""
    a = simulate(outcomes, F.lit(True)).select("task_id", "quality", "cost", "escalated", "unsafe_local")
    return a.select("task_id", F.col("quality").alias("qa"), F.col("cost").alias("ca"), F.col("escalated").cast("int").alias("ea"), F.col("unsafe_local").cast("int").alias("ua")).join(outcomes.select("task_id", F.col("remote_quality").alias("qb"), F.col("remote_cost").alias("cb")), "task_id")


def random_curve(outcomes: DataFrame, seed: int = 17, trials: int = TRIALS) -> DataFrame:
    """Outcomes of random routing at each rate of strong answers, over hashed trials.

    One hashed number for each row and trial serves all rates: rows are summed by trial and by
    how many rates the number reaches, and each rate's means come from those few sums.
    """
    rows = _two_outcomes(outcomes).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("u", uniform(seed, F.col("trial"), F.col("task_id")))
    reached = sum((F.when(F.col("u") >= g, 1).otherwise(0) for g in GRID[1:]), F.when(F.col("u") >= GRID[0], 1).otherwise(0))
    parts = {"n": F.lit(1), "qa": F.col("qa"), "qb": F.col("qb"), "ca": F.col("ca"), "cb": F.col("cb"), "ea": F.col("ea"), "ua": F.col("ua")}
    sums = rows.groupBy("trial", reached.alias("reached")).agg(*[F.sum(c).alias(k) for k, c in parts.items()])
    rates = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("rate")) for i, g in enumerate(GRID)])
    long = sums.withColumn("g", F.explode(rates)).select("*", "g.i", "g.rate")
    pick = lambda a, b: F.sum(F.when(F.col("reached") > F.col("i"), F.col(a)).otherwise(b)) / F.sum("n")
    each = long.groupBy("rate", "trial").agg(pick("qa", F.col("qb")).alias("q"), pick("ca", F.col("cb")).alias("c"), pick("ea", F.col("n")).alias("strong"), pick("ua", F.lit(0)).alias("unsafe"))
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    return each.groupBy("rate").agg(mean("q", "quality_mean"), F.round(F.stddev_pop("q"), 9).alias("quality_std"), F.round(F.percentile("q", F.lit(0.025)), 9).alias("quality_lo"), F.round(F.percentile("q", F.lit(0.975)), 9).alias("quality_hi"), mean("c", "cost_mean"), mean("strong", "remote_call_rate"), mean("unsafe", "unsafe_local_rate"))


def interpolate(curve: DataFrame, at: DataFrame) -> DataFrame:
    """Quality of the curve at given rates (system, x): linear between points, flat beyond the ends.

    The curve has as many points as the grid: that bounds the broadcast.
    """
    order = W.orderBy("remote_call_rate")
    points = curve.select("remote_call_rate", "quality_mean")
    legs = points.select(F.col("remote_call_rate").alias("x0"), F.col("quality_mean").alias("y0"), F.lead("remote_call_rate").over(order).alias("x1"), F.lead("quality_mean").over(order).alias("y1"), F.row_number().over(order).alias("i"))
    first, last = F.col("i") == 1, F.col("x1").isNull()
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) | first & (F.col("x") < F.col("x0")) | last & (F.col("x") >= F.col("x0"))
    value = F.when(last | (F.col("x") < F.col("x0")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return at.join(F.broadcast(legs), inside).select("system", F.round("x", 6).alias("remote_call_rate"), F.round(value, 5).alias("random_quality"))


def _scored(s, d, label: Column | None = None):
    return view(s, d, "outcomes").select(F.col("local_ok").cast("int").alias("y"), F.col("p_local").alias("p"))


def _rates(s, d):
    return systems(view(s, d, "outcomes")).groupBy("system").agg(F.avg((~F.col("route_local") | F.col("escalated")).cast("int")).alias("x"))


def _verdicts(s, d):
    own = view(s, d, "outcomes")
    routed = simulate(own, F.col("p_local") >= ROUTE_AT).select(F.col("task_id").alias("key"), "quality")
    ends = bootstrap(routed, "quality", 17)
    random = interpolate(random_curve(own), _rates(s, d).where("system = 'score'")).select("random_quality")
    return ends.crossJoin(F.broadcast(random)).select("point", "lo", "random_quality", F.round(F.col("point") - F.col("random_quality"), 5).alias("advantage"), (F.col("lo") > F.col("random_quality")).alias("beats_random"))


def _paired(s, d):
    rows = systems(view(s, d, "outcomes")).where("system IN ('score', 'oracle')").groupBy(F.col("task_id").alias("key")).agg((F.sum(F.when(F.col("system") == "score", F.col("quality"))) - F.sum(F.when(F.col("system") == "oracle", F.col("quality")))).alias("diff"))
    return bootstrap(rows, "diff", 17)


QUERIES = {
    "confusion": lambda s, d: confusion(_scored(s, d)),
    "brier": lambda s, d: brier(_scored(s, d)),
    "ece": lambda s, d: ece(_scored(s, d)),
    "roc_auc": lambda s, d: roc_auc(_scored(s, d)),
    "pr_auc": lambda s, d: pr_auc(_scored(s, d)),
    "rank_avg": lambda s, d: rank_avg(_scored(s, d)).select(F.round("p", 9).alias("p"), "n", "rank"),
    "postgen_auc": lambda s, d: postgen_auc(view(s, d, "outcomes")),
    "bootstrap_ci": lambda s, d: bootstrap(simulate(view(s, d, "outcomes"), F.col("p_local") >= ROUTE_AT).select(F.col("task_id").alias("key"), "quality"), "quality", 17),
    "paired_diff": _paired,
    "random_curve": lambda s, d: random_curve(view(s, d, "outcomes")),
    "interp_join": lambda s, d: interpolate(random_curve(view(s, d, "outcomes")), _rates(s, d)),
    "verdicts": _verdicts,
}

_S = "(SELECT local_ok::INT AS y, p_local AS p FROM outcomes)"
_EDGE = " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in EDGES)
_AP = lambda y, p: f"SELECT sum(pos * tp / seen) / sum(pos) FROM (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT {p} AS p, sum({y})::DOUBLE AS pos, count(*) AS n FROM {_S} GROUP BY 1) WINDOW w AS (ORDER BY p DESC))"
_AUC = "sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*)"


def _draw_sql(rows: str) -> str:
    """The same draws u of each row and resample r in 128-bit arithmetic."""
    wrap = f"{1 << 64}::UHUGEINT"
    return f"""SELECT r, v, (xor(z, z >> 31) >> 11)::DOUBLE / {2.0**53!r}::DOUBLE AS u FROM (
  SELECT r, v, ((xor(z, z >> 27)::UHUGEINT * {_MIX2}::UHUGEINT) % {wrap})::UBIGINT AS z FROM (
  SELECT r, v, ((xor(z, z >> 30)::UHUGEINT * {_MIX1}::UHUGEINT) % {wrap})::UBIGINT AS z FROM (
  SELECT r, v, ((CAST(concat('0x', substr(sha256(key), 1, 16)) AS UBIGINT)::UHUGEINT + ((r + {17 * 1_000_003 + 1})::UHUGEINT * {_GOLDEN}::UHUGEINT) % {wrap}) % {wrap})::UBIGINT AS z FROM ({rows}), range({RESAMPLES}) t(r))))"""


def _boot_sql(rows: str) -> str:
    weight = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in _STEPS)
    return f"""SELECT round((SELECT avg(v) FROM ({rows})), 6) AS point, round(quantile_cont(m, {LEVEL / 2}), 6) AS lo, round(quantile_cont(m, {1 - LEVEL / 2}), 6) AS hi
FROM (SELECT r, sum(w * v) / sum(w) AS m FROM (SELECT r, v, {weight} AS w FROM ({_draw_sql(rows)})) GROUP BY r)"""


_SCORE_Q = f"SELECT task_id AS key, quality AS v FROM ({SYSTEMS_SQL}) WHERE system = 'score'"
_DIFF = f"SELECT task_id AS key, sum(quality) FILTER (WHERE system = 'score') - sum(quality) FILTER (WHERE system = 'oracle') AS v FROM ({SYSTEMS_SQL}) GROUP BY task_id"
_ESC = "(post_check_problem IS NOT NULL OR coalesce(local_confidence < 0.4, false))"
_CURVE = f"""
SELECT rate, round(avg(q), 9) AS quality_mean, round(stddev_pop(q), 9) AS quality_std, round(quantile_cont(q, 0.025), 9) AS quality_lo, round(quantile_cont(q, 0.975), 9) AS quality_hi,
  round(avg(c), 9) AS cost_mean, round(avg(s), 9) AS remote_call_rate, round(avg(x), 9) AS unsafe_local_rate
FROM (SELECT rate, trial, avg(CASE WHEN u >= rate THEN qa ELSE remote_quality END) AS q, avg(CASE WHEN u >= rate THEN ca ELSE remote_cost END) AS c,
  avg(CASE WHEN u >= rate THEN e::INT ELSE 1 END) AS s, avg(CASE WHEN u >= rate THEN ua ELSE 0 END) AS x
  FROM (SELECT *, CASE WHEN e THEN remote_quality ELSE local_quality END AS qa, CASE WHEN e THEN local_cost + remote_cost ELSE local_cost END AS ca, (NOT e AND NOT local_ok)::INT AS ua,
    {uniform_sql("'17'", "trial::VARCHAR", "task_id")} AS u FROM (SELECT *, {_ESC} AS e FROM outcomes), range({TRIALS}) t(trial)), (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS rate)
  GROUP BY rate, trial) GROUP BY rate"""
_INTERP = f"""
WITH curve AS ({_CURVE}), rates AS (SELECT system, avg((NOT route_local OR escalated)::INT) AS x FROM ({SYSTEMS_SQL}) GROUP BY system),
legs AS (SELECT remote_call_rate AS x0, quality_mean AS y0, lead(remote_call_rate) OVER w AS x1, lead(quality_mean) OVER w AS y1, row_number() OVER w AS i FROM curve WINDOW w AS (ORDER BY remote_call_rate))
SELECT system, round(x, 6) AS remote_call_rate, round(CASE WHEN x1 IS NULL OR x < x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 5) AS random_quality
FROM rates JOIN legs ON (x >= x0 AND x < x1) OR (i = 1 AND x < x0) OR (x1 IS NULL AND x >= x0)"""
ORACLES = {
    "confusion": with_views(f"SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM {_S}", "outcomes"),
    "brier": with_views(f"SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y), 6) AS positive_rate, count(*) AS n FROM {_S}", "outcomes"),
    "ece": with_views(f"SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (SELECT {_EDGE} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM {_S} GROUP BY 1)", "outcomes"),
    "roc_auc": with_views(f"SELECT round({_AUC}, 6) AS roc_auc FROM {_S} a, {_S} b WHERE a.y = 1 AND b.y = 0", "outcomes"),
    "pr_auc": with_views(f"SELECT round(({_AP('y', 'p')}), 6) AS pr_auc_ok, round(({_AP('1 - y', '-p')}), 6) AS pr_auc_fail", "outcomes"),
    "rank_avg": with_views(f"SELECT round(p, 9) AS p, count(*) AS n, avg(r)::DOUBLE AS rank FROM (SELECT p, row_number() OVER (ORDER BY p) AS r FROM {_S}) GROUP BY p", "outcomes"),
    "postgen_auc": with_views(f"""
WITH full_rows AS (SELECT * FROM outcomes WHERE local_confidence IS NOT NULL AND local_min_token_prob IS NOT NULL AND local_low_token_frac IS NOT NULL),
long AS (SELECT 'mean' AS stat, local_ok::INT AS y, local_confidence AS p FROM full_rows UNION ALL SELECT 'min', local_ok::INT, local_min_token_prob FROM full_rows UNION ALL SELECT 'low_frac', local_ok::INT, 1.0::DOUBLE - local_low_token_frac FROM full_rows)
SELECT a.stat, round({_AUC}, 6) AS roc_auc, any_value(s.n) AS n FROM long a JOIN long b ON a.stat = b.stat AND a.y = 1 AND b.y = 0 JOIN (SELECT stat, count(*) AS n FROM long GROUP BY stat) s ON s.stat = a.stat GROUP BY a.stat""", "outcomes"),
    "bootstrap_ci": with_views(_boot_sql(_SCORE_Q), "outcomes"),
    "paired_diff": with_views(_boot_sql(_DIFF), "outcomes"),
    "random_curve": with_views(_CURVE, "outcomes"),
    "interp_join": with_views(_INTERP, "outcomes"),
    "verdicts": with_views(f"""
WITH ends AS ({_boot_sql(_SCORE_Q)}), r AS (SELECT random_quality FROM ({_INTERP}) WHERE system = 'score')
SELECT point, lo, random_quality, round(point - random_quality, 5) AS advantage, lo > random_quality AS beats_random FROM ends, r""", "outcomes"),
}
