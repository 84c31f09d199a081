import random
import zlib

import numpy as np

from routelens.llm import pu_quality as pu


def make(rng, good):
    words = ["".join(rng.choice("etaoinsr") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 90))]
    if good:
        return " ".join(words).capitalize() + "."
    return rng.choice([" | ".join(words), "!! ".join(w.upper() for w in words), " ".join(words[:3] * 20)])


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, make(rng, good := rng.random() < 0.75), int(good)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows] + [(5000, None, 9), (5001, "", 9)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    positive, other = pu.training_samples(docs, labels)
    model = pu.fit(positive, other)
    assert 0.5 < model.prior < 0.9
    got = {r.doc_id: r.score for r in pu.score_documents(docs, model).collect()}
    assert len(got) == 1502 and all(0 <= s <= 1 for s in got.values())
    right = np.mean([(got[i] >= 0.5) == bool(g) for i, _, g in rows])
    assert right > 0.95
    again = pu.fit(*pu.training_samples(docs, labels))
    assert (again.score(pu.features(["abc def", ""])) == model.score(pu.features(["abc def", ""]))).all()
    bounded = pu.training_samples(docs, labels, texts=20)
    assert [len(b.x) for b in bounded] == [20, 20]


def test_features_see_whole_texts_alone():
    texts = ["Aa b!", "", "same same same", "x" * 300_000 + "|", "é\nß"]
    whole = pu.features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(pu.features([t])[0], whole[i])
    named = dict(zip(pu.FEATURES, whole[2], strict=True))
    assert abs(named["repeat_1"] - 2 / 3) < 1e-9
    assert whole[3][pu.FEATURES.index("odd_mark")] > 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = pu.fit(*pu.training_samples(docs, labels))
    assert [r.score for r in pu.score_documents(docs, model).collect()] == [0.5]
    assert pu.score_documents(docs.limit(0), model).count() == 0


def test_many_copies_of_one_text_leave_the_others_in(spark):
    rng = random.Random(4)
    texts = [make(rng, i % 4 > 0) for i in range(400)]
    hot = texts[0]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, hot) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    positive, other = pu.training_samples(docs, labels, texts=300)
    learnable = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(positive.x) == len({t for i, t in learnable if i < 1000 and i % 4}) and len(other.x) == min(300, len({t for _, t in learnable}))
    whole = pu.training_samples(docs, labels)[1]
    assert whole.rows.sum() == len(learnable) and whole.rows.max() == sum(t == hot for _, t in learnable)


def test_gradient_is_the_slope_of_the_risk():
    rng = np.random.default_rng(1)
    positive = pu.Sample(rng.normal(1, 1, (30, 5)), rng.integers(1, 9, 30).astype(float))
    other = pu.Sample(rng.normal(0, 1, (40, 5)), rng.integers(1, 9, 40).astype(float))
    for prior in (0.3, 0.95):
        params = [rng.normal(0, 1, (5, 4)), rng.normal(0, 1, 4), rng.normal(0, 1, 4), rng.normal(0, 1, 1)]
        if prior > 0.9:  # scores near 1 for positives and in the middle for others: the negative part is below 0
            params = [np.full((5, 4), 0.5), np.zeros(4), np.full(4, 1.0), np.zeros(1)]
        model = pu.Model((np.zeros(5), np.ones(5), *params))
        own, negative = pu.risk(model, positive, other, prior)
        assert (negative >= 0) == (prior < 0.9)

        def lowered():
            own, negative = pu.risk(model, positive, other, prior)
            return own + negative if prior < 0.9 else -negative

        for p, g in zip(params, pu.gradient(model, positive, other, prior), strict=True):
            for at in list(np.ndindex(p.shape))[:6]:
                p[at] += 1e-6
                up = lowered()
                p[at] -= 2e-6
                down = lowered()
                p[at] += 1e-6
                assert abs((up - down) / 2e-6 - np.asarray(g)[at]) < 1e-5


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.6, 0.85):
        good = rng.random(3000) < share
        other = pu.Sample(np.where(good[:, None], rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (3000, 4))), np.ones(3000))
        positive = pu.Sample(rng.normal(2, 1, (2000, 4)), np.ones(2000))
        assert abs(pu.estimate_prior(positive, other) - share) < 0.06
        # texts counted many times weigh as their rows do
        weighed = pu.Sample(other.x, np.where(good, 3.0, 1.0))
        assert abs(pu.estimate_prior(positive, weighed) - 3 * share / (1 + 2 * share)) < 0.08


def test_query_with_null_repeated_and_clashing_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, make(rng, i % 3 > 0), 1.0, True) for i in range(120)] + [(None, "no id", 0.0, None), (5, None, 0.0, None), (5, None, 0.0, None), (None, None, 0.0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(3, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pu.query(spark, str(tmp_path)).collect()
    assert len(got) == 124 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert len({(r.held_out, r.score) for r in got if r.doc_id == 5}) == 2 and all(r.predicted == (r.score >= 0.5) for r in got)
