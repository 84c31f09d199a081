import json
import math
import random

import pytest
from pyspark.sql import functions as F

from routelens.ml import evaluation, routers, train
from routelens.plans.pareto import pareto_html
from routelens.sources import files
from routelens.sources.views import view

SF_DIR = "/root/testdata/sf0.001"


def test_folds_keep_groups_together(spark):
    rows = routers.grouped_folds(view(spark, SF_DIR, "outcomes"))
    assert rows.groupBy("group_id").agg(F.min("fold")).count() == rows.select("group_id", "fold").distinct().count()


def test_platt_recovers_a_logistic(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        z = rng.gauss(0, 2)
        for k, slope in enumerate((0.5, 2.0)):
            rows.append((k, 1 / (1 + math.exp(-z)), float(rng.random() < 1 / (1 + math.exp(-(slope * z - 1))))))
    rows += [(2, p, y) for p, y in ((1e-9, 0.0), (1.0, 1.0)) for _ in range(50)]
    shapes = routers.platt(spark.createDataFrame(rows, "k int, p double, label double"), "k")
    assert abs(shapes[0][0] - 0.5) < 0.1 and abs(shapes[1][0] - 2) < 0.3 and all(abs(shapes[k][1] + 1) < 0.2 for k in range(2))
    assert 0.1 < shapes[2][0] < 10  # labels that the score tells for sure give no step


def learnable(spark, n=420):
    """Prompts whose words tell the label, some of them near copies."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        ok = rng.random() < 0.55
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) for _ in range(12)]
        words[rng.randrange(12)] = rng.choice(["easy", "simple"] if ok else ["tangled", "twisted"])
        lq = (0.7 if ok else 0.2) + rng.random() * 0.2
        rows.append((f"t{i}", i, " ".join(words) + f" number {i}", "c", "s", f"g{i // 2}", lq, 0.95, lq >= 0.6, 0.01, 0.1, 0.3, 1.0, rng.random(), 0.5, 0.5, None, 0.5, 30))
    names = "task_id string, ord long, prompt string, category string, source string, group_id string, local_quality double, remote_quality double, local_ok boolean, local_cost double, remote_cost double, local_latency_s double, remote_latency_s double, local_confidence double, local_min_token_prob double, local_low_token_frac double, post_check_problem string, p_local double, n_chars long"
    return spark.createDataFrame(rows, names)


def test_training_chooses_and_routes(spark, tmp_path):
    rows = learnable(spark)
    router, report, splits, found = train.train(rows, rounds=3)
    assert set(report["candidates"]) == {"logreg_tfidf", "gbdt_svd", "heuristic_reference"} and report["selected"] == router.name
    assert report["candidates"]["logreg_tfidf"]["roc_auc"] > 0.95 > 0.75 > report["candidates"]["heuristic_reference"]["roc_auc"]
    assert splits.count() == rows.count() == splits.select("task_id").distinct().count()
    assert splits.join(rows.select("task_id", rows.group_id.alias("own")), "task_id").groupBy("own").agg({"split": "min"}).count() == splits.join(rows.select("task_id", rows.group_id.alias("own")), "task_id").select("own", "split").distinct().count()
    assert all(r.method in ("sigmoid", "isotonic") for r in found.values())
    for name, own in found.items():
        train.save_router(own, f"{tmp_path}/{name}", {"tier_mode": "pair", "local_model": "a", "remote_model": "b"})
        again = train.load_router(f"{tmp_path}/{name}", ("pair", "a", "b"))
        first, second = ({r.task_id: (r.confidence, r.route) for r in train.route_learned(x, rows.limit(60)).collect()} for x in (own, again))
        assert first == second and len(first) == 60
        with pytest.raises(ValueError, match="trained for"):
            train.load_router(f"{tmp_path}/{name}", ("pair", "a", "c"))
    test = evaluation.scored(rows.drop("n_chars").join(splits.where("split = 'test'").select("task_id"), "task_id"), found)
    parts = evaluation.evaluate(test, found, report["selected"])
    files.sink_eval_report(parts, pareto_html(parts["curves"], parts["systems"], "Cost and quality"), f"{tmp_path}/eval", {"split": "test"})
    told = json.loads((tmp_path / "eval" / "results.json").read_text())
    quality = {r["system"]: r["quality_mean"] for r in told["systems"]}
    assert set(quality) == {"all_local", "all_remote", "oracle", "heuristic", *found} and quality["all_local"] < quality["oracle"]
    assert told["verdicts"][0]["system"] == report["selected"] and {r["mixture"] for r in told["mixtures"]} == {"balanced", "easy_heavy", "hard_heavy"}
    assert all(r["quality_lo"] <= r["quality_mean"] <= r["quality_hi"] for r in told["systems"]) and len(told["random_curve"]) == 21
    files.sink_train_report(report, splits, f"{tmp_path}/report")
    assert dict(map(tuple, files.scan_splits(spark, f"{tmp_path}/report").collect())) == {r.task_id: r.split for r in splits.collect()}
    assert json.loads((tmp_path / "report" / "report.json").read_text())["selected"] == report["selected"] and report["selected"] in (tmp_path / "report" / "summary.txt").read_text()


def test_training_guards(spark):
    rows = learnable(spark, 60)
    with pytest.raises(ValueError, match="are needed"):
        train.train(rows.limit(30))
    with pytest.raises(ValueError, match="single class"):
        train.train(rows.unionByName(learnable(spark, 240).withColumn("task_id", F.concat(F.lit("x"), "task_id")).withColumn("prompt", F.concat("prompt", F.lit(" more"), "task_id")).withColumn("group_id", F.concat(F.lit("y"), "group_id"))).withColumns({"local_ok": F.lit(True), "local_quality": F.lit(0.9)}))


def test_candidates_that_fell_back_come_last(spark):
    points = spark.createDataFrame([("a", "no threshold", 0.1, 0.9), ("b", "", 0.5, 0.8), ("c", "", 0.5, 0.9)], "candidate string, note string, cost_total double, quality_mean double")
    assert train.candidate_select(points, "quality_floor").first().candidate == "c"


def test_char_runs(spark):
    got = spark.createDataFrame([("Ab abcd",)], "t string").select(train.char_runs(F.col("t")).alias("r")).first().r
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "])


def test_character_runs_are_counted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(train, "MOST_SEEN", 5)
    rows = spark.createDataFrame([("A bc  abcd ÀÉ😀", 0), ("abcd abcde abcd", 1), ("", 2), (None, 3), (" \n", 4), ("bc", 5)], "prompt string, i long").repartition(3)
    want = {r.run: r.df for r in rows.select(F.explode(F.array_distinct(train.char_runs(F.col("prompt")))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("df")).collect()}
    assert {r.run: r.df for r in train.char_frequency(rows, "prompt").collect()} == want and want[" bc "] == 2
