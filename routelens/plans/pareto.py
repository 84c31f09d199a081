"""A chart of cost against quality as one HTML file."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE, TALL, EDGE = 640, 400, 40
#: Most points drawn; a sweep is thinned to the best quality of as many cost steps.
POINTS = 400


def frontier(points: DataFrame, n: int = POINTS) -> DataFrame:
    """The best quality in each of n steps of cost, over all points."""
    ends = points.agg(F.min("cost_mean").alias("lo"), F.max("cost_mean").alias("hi"))
    step = F.least(F.lit(n - 1), F.floor((F.col("cost_mean") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * n))
    return points.crossJoin(F.broadcast(ends)).groupBy(step.alias("step")).agg(F.max_by(F.struct("cost_mean", "quality_mean"), "quality_mean").alias("p")).select("p.cost_mean", "p.quality_mean")


def pareto_html(points: DataFrame, systems: DataFrame, title: str) -> str:
    """The frontier as a line and each system (system, cost_mean, quality_mean) as a dot."""
    line = sorted((r.cost_mean, r.quality_mean) for r in frontier(points).collect())
    dots = [(r.system, r.cost_mean, r.quality_mean) for r in systems.select("system", "cost_mean", "quality_mean").orderBy("system").limit(50).collect()]
    xs, ys = [p[0] for p in line] + [d[1] for d in dots], [p[1] for p in line] + [d[2] for d in dots]
    if not xs:
        return f"<!DOCTYPE html><title>{escape(title)}</title><p>no points</p>"
    y0, y1, x0, x1 = max(0.0, min(ys) - 0.02), min(1.0, max(ys) + 0.02), min(xs), max(xs)
    at = lambda x, y: (EDGE + (x - x0) / ((x1 - x0) or 1) * (WIDE - 2 * EDGE), TALL - EDGE - (y - y0) / ((y1 - y0) or 1) * (TALL - 2 * EDGE))
    path = " ".join("{:.1f},{:.1f}".format(*at(*p)) for p in line)
    marks = "".join('<circle cx="{:.1f}" cy="{:.1f}" r="4"/><text x="{:.1f}" y="{:.1f}">{}</text>'.format(*at(x, y), at(x, y)[0] + 6, at(x, y)[1] - 6, escape(name)) for name, x, y in dots)
    return f'<!DOCTYPE html><title>{escape(title)}</title><h1>{escape(title)}</h1><svg width="{WIDE}" height="{TALL}"><polyline fill="none" stroke="black" points="{path}"/>{marks}</svg>'
