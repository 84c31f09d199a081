import random
from itertools import combinations

import numpy as np

from routelens.llm import string_kernel as sk


def naive(word):
    """Gap-weighted subsequences with bounded steps, counted one by one."""
    out = {}
    for at in combinations(range(len(word)), sk.ORDER):
        steps = [b - a for a, b in zip(at, at[1:])]
        if max(steps) <= sk.REACH:
            u = tuple(word[i] for i in at)
            out[u] = out.get(u, 0) + sk.DECAY ** (sum(steps) - sk.ORDER + 1)
    return out


def test_kernel_equals_naive_counts():
    rng = random.Random(4)
    words = [bytes([1] + [rng.randrange(2, 6) for _ in range(rng.randrange(3, 9))]) for _ in range(30)]
    got = sk.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = naive(a), naive(b)
            norm = np.sqrt(sum(v * v for v in y.values())) or 1
            assert abs(got[i, j] - sum(v * y.get(u, 0) for u, v in x.items()) / norm) < 1e-4


def test_words():
    show = lambda t: {"".join(chr(c + 95) if 2 <= c < 28 else "^" if c == 1 else "?" for c in w) for w in sk.words_of(t)}
    assert show("An id-iot, i d i o t!\nL0S3R") == {"^an", "^idiot", "^loser"}
    assert show("") == set() and show(" \n!?") == set()
    stream, begins, text = sk.symbols(["a b", "", "c"])
    assert text.tolist() == [0, 2]


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["the", "re", "on", "ti", "en", "sha", "er", "nd", "ou", "ing"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["clompf", "dubwak", "vexquo" + rng.choice(syllables)]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_inserted_characters(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9000, None, 0.5), (9001, "", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(9000, 1, None)], "doc_id long, quality int, toxic int")
    model = sk.fit(*sk.training_texts(docs, labels))
    got = {r.doc_id: r.score for r in sk.score_documents(docs, model).collect()}
    assert len(got) == 902 and got[9000] == got[9001] < 0.5
    assert np.mean([(got[i] >= 0.5) == bool(x) for i, _, x in rows]) > 0.97
    fresh = [t for _, t, x in corpus(300, 2) if not x]
    assert (model.score(fresh) < 0.5).mean() > 0.97
    for hidden in ("c.l.o.m.p.f", "d u b w a k", "CLOMPF", "dub-wak"):
        assert (model.score([t + " " + hidden for t in fresh]) >= 0.5).mean() > 0.97
    assert (model.score([t + " vexqzuon" for t in fresh]) >= 0.5).mean() > 0.9
    kept = sk.clean_documents(docs, model, docs.columns)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    long = " ".join(fresh * 20)
    assert model.score([long])[0] < 0.5 <= model.score([long + " clompf"])[0]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = sk.fit(*sk.training_texts(docs, labels))
    assert [r.score for r in sk.score_documents(docs, model).collect()] == [0.0]
    assert sk.score_documents(docs.limit(0), model).count() == 0


def test_word_margins_equal_plain_sum_over_landmarks():
    model = sk.fit(*[[t for _, t, x in corpus(120, 5) if x == y] for y in (1, 0)])
    words = sorted(sk.words_of("clompf vexquoen theresha idiot ou"))
    got = model.word_margins(*sk._stream(words))
    for word, value in zip(words, got, strict=True):
        own, want = naive(word), model.bias
        for mark, share in zip(model.landmarks, model.shares, strict=True):
            other = naive(mark)
            norm = np.sqrt(sum(v * v for v in other.values()))
            want += share * sum(v * other.get(u, 0) for u, v in own.items()) / norm
        assert abs(value - want) < 1e-3
    text = "ou theresha clompf"
    worst, counts, n = model.read([text, ""])
    each = model.word_margins(*sk._stream([w for t in text.split() for w in sk.words_of(t)]))
    assert abs(worst[0] - each.max()) < 1e-5 and n.tolist() == [3, 0] and worst[1] == -2
    assert counts[0].tolist() == [(each > c).sum() for c in sk.CUTS]


def test_density_other_scripts_and_rare_insults():
    """A stem that clean texts hold now and then, an insult in Cyrillic, a rare one."""
    rng = random.Random(7)
    part = ["ми", "ла", "ро", "ке", "ту", "ва", "си"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(1, 4)))
    made = {0: [], 1: [], 2: []}
    for i in range(700):
        words = [word() for _ in range(60)]
        kind = 1 if i % 7 == 0 else 2 if i % 7 == 1 else 0
        if kind == 1:
            words[rng.randrange(60)] = "дурхаб" if i % 70 else "гжещник"
        else:
            for _ in range(6 if kind == 2 else rng.random() < 0.1):
                words[rng.randrange(60)] = "балхов" + rng.choice(part)
        made[kind].append(" ".join(words))
    toxic, clean = made[1][:70] + made[2][:70], made[0][:350]
    model = sk.fit(toxic, clean)
    for kind in (1, 2):
        assert (model.score(made[kind][70:]) >= 0.5).mean() > 0.9
    assert (model.score(made[0][350:]) < 0.5).mean() > 0.97
    assert model.score([made[0][0] + " гжещник"])[0] >= 0.5 > model.score([made[0][0] + " ламике"])[0]


def test_sample_is_of_distinct_texts(spark):
    rows = [(i, "copy", 1) for i in range(1, 400)] + [(i, "t%d" % i, i % 2) for i in range(1000, 1040)] + [(i, None, 0) for i in range(2000, 2010)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    toxic, other = sk.training_texts(docs, labels, rows=100)
    assert len(set(toxic)) == len(toxic) > 10 and "copy" in toxic and "" in other
    few = sk.training_texts(docs, labels, rows=5, chars=8)
    assert 1 <= len(few[0]) <= 5 and sum(map(len, few[0])) <= 8


def test_query_on_odd_rows(spark, tmp_path):
    rows = corpus(300, 3)
    extra = [(None, "clompf"), (5, None), (5, None), (7, ""), (8, "ou " * 40000 + "dubwak")]
    spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(7, None, 0), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sk.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 5 and all(r.held_out is not None and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_texts_without_words():
    assert sk.fit(["", "!?"], ["a b c"]).score(["a", ""]).tolist() == [0, 0]
    assert sk.fit(["clompf dubwak"], [""]).score([""])[0] < 0.5
