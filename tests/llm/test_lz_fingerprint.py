import hashlib
import random

from routelens.llm import lz_fingerprint as lz


def plain_phrases(text):
    seen, begin = set(), 0
    for end in range(1, len(text) + 1):
        if text[begin:end] not in seen:
            seen.add(text[begin:end])
            begin = end
    return seen


def test_parse_equals_the_plain_loop():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abé ") for _ in range(rng.randrange(120)))
        seen, spans = set(), []
        lz._parse(text, 0, len(text), seen, spans)
        assert seen == plain_phrases(text)
        kept = rng.randrange(len(text) + 1)
        other = "".join(rng.choice("ab ") for _ in range(rng.randrange(40)))
        own, edited = lz.sketches(text, kept, other)
        assert (own == lz.sketch(text)).all()
        assert (edited == lz.sketch(text[:kept] + other)).all()


def test_likeness_estimates_jaccard():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    a = " ".join(rng.choice(words) for _ in range(4000))
    b = a[:15000] + " ".join(rng.choice(words) for _ in range(1800))
    pa_, pb = plain_phrases(a), plain_phrases(b)
    true = len(pa_ & pb) / len(pa_ | pb)
    assert abs(lz.likeness(lz.sketch(a), lz.sketch(b)) - true) < 0.15
    assert lz.likeness(lz.sketch(""), lz.sketch("")) == 1
    assert lz.likeness(lz.sketch(""), lz.sketch("a")) == 0


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        own = lz.sketch(text)
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), lz.name(own), lz.name(lz.sketch(edited)), lz.likeness(own, lz.sketch(edited)), lz.likeness(own, lz.sketch(after)))
    return out


def test_query_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 401, "".join(rng.choice("abcé ") for _ in range(rng.randrange(90)))) for i in range(401)]
    rows[5] = (rows[5][0], None)
    rows[6] = (rows[6][0], "")
    for some in (rows, rows[:1], rows[:2]):
        docs = spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, k int").repartition(5)
        got = {r.doc_id: tuple(r)[1:] for r in lz.fingerprints(docs).collect()}
        assert got == expected(some)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None)], "doc_id long, text string")
    got = lz.fingerprints(docs).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 0), (False, 3), (False, 3), (True, 1)]
    assert lz.fingerprints(docs.limit(0)).count() == 0
