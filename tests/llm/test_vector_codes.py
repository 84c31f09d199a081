import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from routelens.llm import vector_codes as v

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])


def brute(rows):
    """The contract, entry by entry."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [(r, [int(np.floor(1024 * float(np.float32(x)))) for x in r[1]]) for r in good]
    width = max([4, *[-(-len(w) // 4) * 4 for _, w in whole]])
    whole = sorted(((r, w + [0] * (width - len(w))) for r, w in whole), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
    step = width // 4
    parts = [[w[p * step : (p + 1) * step] for _, w in whole] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(4):
        for part, book in zip(parts, books, strict=True):
            index = [near(x, book)[1] for x in part]
            for i in set(index):
                own = [x for x, j in zip(part, index, strict=True) if i == j]
                book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for k, (r, _) in enumerate(whole):
        found = [near(part[k], book) for part, book in zip(parts, books, strict=True)]
        out.append([r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]])
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted([(i, c, e, sums[label], sha) for i, c, e, label in out], key=str)


def told(spark, rows):
    return sorted((tuple(r) for r in v.compress(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()), key=str)


def test_equals_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.1, rng.gauss(0, 0.2))) for _ in range(8)], rng.choice((None, 1, 1, 1, 2))) for i in range(330)]
    rows += [rows[5], rows[5], (None, [0.1] * 8, 1), (400, None, 1), (401, [0.1, None] * 4, 1), (402, [float("nan")] * 8, 2), (403, [float("-inf")] * 8, 2)]
    rows += [(-1, [], 1), (-2, [0.3] * 3, None)]
    rng.shuffle(rows)
    assert told(spark, rows) == brute(rows)


def test_one_vector_and_none(spark):
    assert told(spark, [(7, [0.5, -0.5, 0.1, 0.2], None)]) == brute([(7, [0.5, -0.5, 0.1, 0.2], None)])
    assert told(spark, []) == told(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_partial_distances_lose_no_tie(seed):
    rng = np.random.default_rng(seed)
    book, rows = rng.integers(-2 - seed * 900, 3 + seed * 900, (256, 10)), rng.integers(-2 - seed * 900, 3 + seed * 900, (5000, 10))
    book[200:] = book[:56]
    whole = ((rows[:, None, :] - book[None]) ** 2).sum(2)
    index, distance = v.nearest(rows, book)
    assert (index == whole.argmin(1)).all() and (distance == whole.min(1)).all()


def test_dimensions_go_by_variance():
    book = np.array([[0, 5, 1], [0, -5, 2], [0, 5, 9]])
    assert v.by_variance(book).tolist() == [1, 2, 0]


def test_components_too_large(spark):
    with pytest.raises(Exception, match="must stay below"):
        told(spark, [(1, [1e9] * 4, 1)])


def test_codes_stand_for_their_entries():
    books = [np.arange(8).reshape(2, 4) + 10 * p for p in range(4)]
    assert v.decode(["00010001"], books).tolist() == [[*range(4), *range(14, 18), *range(20, 24), *range(34, 38)]]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(tuple(r) for r in v.query(spark, "/root/testdata/sf0.001").collect()) == sorted(con.execute(v.ORACLE).fetchall())
