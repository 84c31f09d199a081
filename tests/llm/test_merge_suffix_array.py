import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from routelens.llm import merge_suffix_array as ms


def brute(rows, length):
    """(doc_id, bytes, removed, spans, digest) of each row, sorted."""
    texts = [(t or "").encode() for _, t in rows]
    starts = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            starts[t[i : i + length]].append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for (doc, _), t, g in zip(rows, texts, gone, strict=True):
        runs = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((doc, len(t), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n, length):
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(length - 6, 2 * length + 30))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(5)):
            text += "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 2 * length)))
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.randrange(0, 12)
                text += p[a : len(p) - rng.randrange(12)]
        rows.append((i, text))
        if rng.random() < 0.15 and text:
            at = rng.randrange(len(text))
            rows.append((i + 10_000, text[:at] + "X" + text[at + 1 :]))
    return rows


@pytest.mark.parametrize("length", [20, 64, 200])
def test_equals_brute_force(spark, length):
    rng = random.Random(length)
    rows = corpus(rng, 60, length)
    rows += [(500, "a" * (3 * length)), (501, "ab" * length), (502, "b" + "a" * (length - 1)), (503, None), (504, ""), (505, "x" * (length - 1))]
    rows += [(506, "same document " * length), (507, "same document " * length), (508, "unique %s" % rng.random()), (None, "q" * length + "r")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, part int").repartition(4)
    got = sorted((tuple(r) for r in ms.report_passages(docs, length).collect()), key=str)
    assert got == brute(rows, length)


def test_repeated_rows_and_kept_text(spark):
    body = "".join(random.Random(2).choice("abcdé ") for _ in range(300))
    rows = [(1, body), (1, body), (2, "start " + body[20:280] + " end"), (3, "alone"), (4, None), (None, "z")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_chars long")
    got = ms.dedup_passages(docs).collect()
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got), key=str) == sorted([(1, "", 0), (1, "", 0), (2, "start  end", 10), (3, "alone", 5), (4, None, 7), (None, "z", 1)], key=str)
    assert ms.report_passages(docs.limit(0)).count() == 0 and ms.dedup_passages(docs.limit(0)).count() == 0


def test_very_frequent_grams(spark):
    rng = random.Random(5)
    common = "".join(rng.choice("abcdef") for _ in range(30))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(50)) + common + "".join(rng.choice("ab") for _ in range(30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = 4
    found = ms.keep(ms._exchange(ms._in_documents(docs, n, ms._send_hashes(32, n)), n).mapInArrow(ms._shared_hashes(n), ms._ROWS), "test")
    hashes = frozenset(int(h) for r in found.where(f"kind = {ms._CANDIDATE}").collect() for h in ms._unpack(bytes(r.blob))[1])
    both = found.where(f"kind = {ms._CANDIDATE}").union(ms._in_documents(docs, n, ms._send_documents(n, 32)))
    spans = set()
    for hot in (frozenset(), hashes):
        rows_ = ms._exchange(both, n).sortWithinPartitions("kind").mapInArrow(ms._sort_suffixes(32, n, hot), ms._ROWS)
        for level in range(len(ms.widths(32))):
            rows_ = ms._exchange(rows_, n).mapInArrow(ms._merge_round(32, n, level), ms._ROWS)
        covered = defaultdict(set)
        for r in rows_.collect():
            for key, a, b in zip(*(c.tolist() for c in ms._unpack(bytes(r.blob))), strict=True):
                covered[key] |= set(range(max(a, 0), b))
        spans.add(frozenset((k, frozenset(v)) for k, v in covered.items()))
    assert len(spans) == 1 and hashes


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ms, "RANGE_BYTES", 1000)
    rows = corpus(random.Random(11), 40, 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ms.ranges(docs) > 5
    assert sorted((tuple(r) for r in ms.report_passages(docs, 64).collect()), key=str) == brute(rows, 64)


def test_passes_and_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(ms, "RANGE_BYTES", 1000)
    rng = random.Random(12)
    common = "".join(rng.choice("abcdef") for _ in range(90))
    rows = corpus(rng, 40, 64)
    rows += [(2000 + i, "".join(rng.choice("abc") for _ in range(40)) + common[i % 9 :] + "".join(rng.choice("ab") for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 64)
    for most, hot in ((4, ms.HOT_LEAST), (ms.MOST_RANGES, 5), (9, 20)):
        assert sorted((tuple(r) for r in ms.report_passages(docs, 64, most, hot).collect()), key=str) == want


def test_merge_gives_order_and_shared_prefixes():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 8):
        runs, everything = [], []
        for _ in range(k):
            items = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30))})
            everything += items
            runs.append(iter([(ms._shared_prefix(items[i - 1], x, 0) if i else 0, x, ()) for i, x in enumerate(items)]))
        last = b""
        got = []
        for shared, item, _ in ms.merge(runs):
            assert not got or shared == ms._shared_prefix(last, item, 0)
            last = item
            got.append(item)
        assert got == sorted(everything)


def test_long_text_in_chunks(monkeypatch):
    text = np.frombuffer(bytes(random.Random(3).choice(b"abc ") for _ in range(5000)), np.uint8)
    whole = {(p, o) for _, p, low, high in zip(*ms.anchors(text, 20), strict=True) for o in range(low, high + 1)}
    monkeypatch.setattr(ms, "CHUNK", 333)
    parts = {(p, o) for _, p, low, high in zip(*ms.anchors(text, 20), strict=True) for o in range(low, high + 1)}
    assert whole == parts and len({p - o for p, o in whole}) == 5000 - 19


def test_passages_at_the_boundary_of_a_chunk(spark):
    """Repeats that begin, end or lie across the place where windows are looked through anew."""
    rng, length, edge = random.Random(4), 64, ms.CHUNK
    text = "".join(rng.choices("abcdefghijklmnop", k=edge + 4000))
    places = [edge + at for at in (-length - 1, -length, 1 - length, -40, -20, -3, -1, 0, 1, 2)]
    rows = [(0, text)] + [(at, "<" + text[at : at + length] + ">") for at in places]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in ms.report_passages(docs, length).collect()), key=str) == brute(rows, length)
