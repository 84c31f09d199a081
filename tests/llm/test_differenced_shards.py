import random
import zlib
from collections import Counter, defaultdict

import pytest

from routelens.llm import differenced_shards as d

SCHEMA = "doc_id long, text string, shard int, digest string, size string"


def told(spark, rows, shards=24):
    return d.shard(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA), shards).collect()


def whole(rows, found, shards=24):
    """What must hold of any answer; the shards' bytes."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows) == sorted((str(r.doc_id), r["size"], r.text_crc32) for r in found)
    slots, place, sums = defaultdict(list), defaultdict(set), [0] * shards
    for r in found:
        slots[r.shard].append(r.slot)
        place[r["size"], r.text_crc32].add(r.shard)
        sums[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in place.values())
    return sums


def plain(sizes, shards):
    """Differencing with sorted lists: the sums of the parts."""
    partials = [sorted([s] + [0] * (shards - 1)) for s in sizes]
    while len(partials) > 1:
        partials.sort(key=lambda p: p[0] - p[-1])
        a, b = partials[:2]
        partials[:2] = [sorted(x + y for x, y in zip(a, reversed(b), strict=True))]
    return partials[0]


@pytest.mark.parametrize("shards", [2, 5, 24])
def test_differencing_equals_plain(shards):
    sizes = random.Random(shards).sample(range(1, 100_000), 200)
    sums, members = d.combined([d.single(s, s, shards) for s in sizes], shards)
    assert [sum(m) for m in members] == sums and sorted(x for m in members for x in m) == sorted(sizes)
    assert sums[0] - sums[-1] == plain(sizes, shards)[-1] - plain(sizes, shards)[0] or sums[0] - sums[-1] <= 2


def test_known_example():
    sums, _ = d.combined([d.single(s, s, 2) for s in (8, 7, 6, 5, 4)], 2)
    assert sums == [16, 14]


def test_rows_with_nulls_copies_and_one_huge_group(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(900)] + [(None, None), (5, "x"), (5, "x")] + [(2000 + i, "hot " * 50) for i in range(450)]
    sums = whole(rows, told(spark, rows))
    rest = sorted(sums)[:-1]
    assert max(sums) == 450 * 208 and max(rest) - min(rest) < min(rest) / 100


def test_buckets_of_small_groups(spark, monkeypatch):
    monkeypatch.setattr(d, "LARGE", 20)
    monkeypatch.setattr(d, "BLOCK", 50)
    monkeypatch.setattr(d, "BUCKETS", 8)
    rng = random.Random(2)
    rows = [(i, "w" * int(rng.paretovariate(1.2) * 20)) for i in range(3000)] + [(i, "") for i in range(1500)]
    sums = whole(rows, told(spark, rows, 6), 6)
    groups = Counter()
    for _, text in rows:
        groups[text] += len(text) + 8
    left, parts = sorted(groups.values()), 6
    while left[-1] * parts >= sum(left):
        left.pop()
        parts -= 1
    even = sorted(sums)[:parts]
    assert max(even) - min(even) < sum(left) / parts / 50


def test_few_rows_and_none(spark):
    assert told(spark, []) == []
    whole([(1, "a"), (2, None)], told(spark, [(1, "a"), (2, None)]))
