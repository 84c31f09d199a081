from routelens.plans.pareto import frontier, pareto_html


def test_chart(spark):
    points = spark.createDataFrame([(i / 1000, 0.5 + (i % 7) / 100) for i in range(1000)], "cost_mean double, quality_mean double")
    systems = spark.createDataFrame([("a<b", 0.1, 0.6)], "system string, cost_mean double, quality_mean double")
    assert frontier(points, 50).count() == 50
    page = pareto_html(points, systems, "T & U")
    assert "a&lt;b" in page and "T &amp; U" in page and page.count("<circle") == 1
    assert "no points" in pareto_html(points.limit(0), systems.limit(0), "x")
