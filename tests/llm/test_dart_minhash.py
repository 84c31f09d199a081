import random
from collections import Counter

import numpy as np

from routelens.llm import dart_minhash as dm


def plain(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_shingles_and_likeness():
    rng = random.Random(1)
    for _ in range(100):
        a, b = (" ".join(rng.choice("abC") for _ in range(rng.randrange(30))) + rng.choice(["", "\n", "　x"]) for _ in range(2))
        assert sorted(dm.shingles(a)[1]) == sorted(plain(a).values())
        assert abs(dm.likeness(dm.shingles(a), dm.shingles(b)) - jaccard(plain(a), plain(b))) < 1e-9


def test_collisions_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    e = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    for weights in (rng.integers(1, 5, 300).astype(float), rng.random(300) * 3 + 0.05):
        other = np.where(rng.random(300) < 0.3, weights * rng.random(300) + 0.01, weights)
        true = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
        same = np.mean(dm.signature(e, weights, 2000) == dm.signature(e, other, 2000))
        assert abs(same - true) < 0.05
    assert len(dm.signature(e[:0], np.zeros(0))) == 0
    assert (dm.signature(e[:1], np.ones(1)) != 0).all()


def expected(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = [plain(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                root[top(i)] = top(j)
    label = {t: top(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        least.setdefault(label[t or ""], []).append(d)
    return {d: min(least[label[t or ""]]) for d, t in rows}


def test_classes_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for family in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 14)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(3)):  # a chain of copies: ends are less alike than neighbours
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a b c")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, key int").repartition(4)
    got = {r.doc_id: r.class_id for r in dm.classes(docs).collect()}
    assert got == expected(rows)
    kept = dm.dedup_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_one_large_group_and_odd_rows(spark):
    base = ["w%d" % i for i in range(200)]
    rows = [(i, " ".join(base[:i % 200] + ["x%d" % i] + base[i % 200 + 1 :])) for i in range(300)] + [(i, "same text here") for i in range(500, 700)]
    rows += [(700, "same text here"), (700, "same text here"), (None, "lonely"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dm.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r.class_id for r in got if r.doc_id is not None and r.doc_id < 300} == {0}
    assert {r.class_id for r in got if r.doc_id is not None and r.doc_id >= 500} == {500}
    assert dm.dedup_documents(docs).count() == 4
    assert dm.classes(docs.limit(0)).count() == 0 and dm.dedup_documents(docs.limit(0)).count() == 0


def test_links_among_members_that_no_centre_joins(spark):
    """A large group of near copies with their own edits, most of them no links; blocks far smaller than its buckets."""
    rng = random.Random(8)
    base = ["w%d" % i for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(1 << 40)
        rows.append((i, " ".join(words)))
    want = expected(rows)
    assert 20 < len(set(want.values())) < 250
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rows_, weight in ((7, 1 << 20), (1024, 2000), (dm.BLOCK_ROWS, dm.BLOCK_WEIGHT)):
        assert {r.doc_id: r.class_id for r in dm.classes(docs, rows_, weight).collect()} == want


def test_shared_weight_and_joined():
    rng = np.random.default_rng(5)
    sets = [tuple(np.unique(rng.integers(1, 40, 30).astype(np.uint64), return_counts=True)) for _ in range(9)] + [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    got = dm.shared_weight(sets[:4], sets[4:])
    for i in range(4):
        for j in range(4, 10):
            a, b = (dict(zip(*(c.tolist() for c in s))) for s in (sets[i], sets[j]))
            assert got[i, j - 4] == sum(min(n, b.get(e, 0)) for e, n in a.items())
    links = np.zeros((3, 3), bool)
    links[0, 0] = links[1, 0] = links[1, 1] = True
    a, b = dm._joined(links)
    assert a.tolist() == [0, 0, 2] and b.tolist() == [0, 0, 5]
