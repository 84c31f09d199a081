"""Codes of vectors: part codebooks learnt on all vectors, nearest entries by partial distances.

A component x counts as the integer floor(1024 x); all arithmetic is on integers, so a result
doesn't depend on how rows are dealt out. A vector is cut into four equal consecutive parts, each
with a codebook of at most 256 entries. Nearest entries are searched dimension by dimension, in
descending variance of the codebook: an entry is dropped as soon as what has been summed so far
strictly exceeds the best distance known in full, so no tie is lost.

Only codebooks (bounded by their parameters) and their sums pass through the driver. A round reads
the vectors once, each task sums its own parts by entry, and Spark adds the tasks' sums.

Defined cases. Null vectors and vectors with a null, NaN or infinite component are dropped. Vectors
shorter than the longest, or than the next multiple of four, are padded with zero components; an empty array is
a vector of zeros. Rows of equal ``vec_id`` all count, ordered by their components; a null
``vec_id`` stands after all others. Fewer than 256 vectors make a smaller codebook. No vectors: no
rows. Components of 2**17 and more in size raise an error, as their distances may not fit in 64 bits.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, mapped, parts, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task compares with a codebook at a time; dimensions summed before the first look at the masks, and between two.
BLOCK, FIRST, STEP = 512, 8, 4
#: Size that |floor(1024 x)| must stay below.
LARGEST = 1 << 27
#: Labels up to which their sums are sent to all tasks instead of being joined by a shuffle.
FEW_LABELS = 100_000


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a vector whose components are all finite numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & ~bad)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """rows x width: floor(1024 x), shorter vectors padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"components must stay below {LARGEST // SCALE} in size")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def by_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook in descending variance of its entries, equal ones in ascending order."""
    n = len(book)
    spread = n * (book.astype(object) ** 2).sum(0) - book.astype(object).sum(0) ** 2
    return np.array(sorted(range(book.shape[1]), key=lambda d: (-spread[d], d)), np.int64)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equal ones) and its squared distance, for every row."""
    order = by_variance(book)
    largest = int(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * largest * largest * max(1, len(order)) < 1 << 31 else np.int64
    x, c = rows[:, order].astype(kind), book[:, order].astype(kind)
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for begin in range(0, len(x), BLOCK):
        index[begin : begin + BLOCK], distance[begin : begin + BLOCK] = _search(x[begin : begin + BLOCK], c)
    return index, distance


def _search(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partial-distance search of a block; dimensions are in search order already."""
    n, width = x.shape
    so_far = np.zeros((n, len(c)), x.dtype)
    gap = np.empty_like(so_far)
    xs, cs = np.ascontiguousarray(x.T), np.ascontiguousarray(c.T)
    for d in range(min(FIRST, width)):
        np.subtract(xs[d][:, None], cs[d][None, :], out=gap)
        np.multiply(gap, gap, out=gap)
        so_far += gap
    at = np.arange(n)
    best = ((x - c[so_far.argmin(1)]) ** 2).sum(1, dtype=x.dtype)  # complete distance to the nearest so far
    row, entry = np.nonzero(so_far <= best[:, None])  # rows ascending, entries ascending within a row
    total = so_far[row, entry]
    for begin in range(FIRST, width, STEP):
        for d in range(begin, min(begin + STEP, width)):
            apart = xs[d].take(row)
            apart -= cs[d].take(entry)
            apart *= apart
            total += apart
        # each row's candidate that is nearest so far is completed: a tighter best distance
        least = np.minimum.reduceat(total, np.searchsorted(row, at))
        lead = np.zeros(n, np.int64)
        hit = np.nonzero(total == least.take(row))[0][::-1]
        lead[row[hit]] = entry[hit]
        best = np.minimum(best, ((x - c[lead]) ** 2).sum(1, dtype=x.dtype))
        left = np.nonzero(total <= best.take(row))[0]
        row, entry, total = row.take(left), entry.take(left), total.take(left)
    least = np.minimum.reduceat(total, np.searchsorted(row, at))
    hit = np.nonzero(total == least[row])[0][::-1]  # backwards, so that the lowest entry is written last
    index = np.zeros(n, np.int64)
    index[row[hit]] = entry[hit]
    return index, least.astype(np.int64)


def _first_books(good: DataFrame, width: int) -> list[np.ndarray]:
    """Codebooks of the smallest vec_ids; at most 256 rows come to the driver."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    first = good.select("vec_id", whole.alias("whole")).orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES).collect()
    found = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        found[i, : len(r.whole)] = r.whole
    return np.split(found, PARTS, axis=1)


def _renewed(good: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: entries become floor(sum / count) of the parts nearest to them."""
    step = width // PARTS

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            whole = integers(batch.column(0), width)
            for p, book in enumerate(books):
                own = whole[:, p * step : (p + 1) * step]
                index, _ = nearest(own, book)
                counts[p] += np.bincount(index, minlength=len(book))
                order = np.argsort(index, kind="stable")
                kinds, begins = np.unique(index[order], return_index=True)
                if len(kinds):
                    sums[p][kinds] += np.add.reduceat(own[order], begins, axis=0)
        part, entry, dim = (g.ravel() for g in np.meshgrid(np.arange(PARTS), np.arange(len(books[0])), np.arange(step + 1), indexing="ij"))
        value = np.concatenate([np.column_stack([s, n]) for s, n in zip(sums, counts, strict=True)]).ravel()
        some = value != 0
        yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (part, entry, dim, value)], names=["part", "entry", "dim", "value"])

    told = mapped(good.select("embedding"), summed, "part long, entry long, dim long, value long")
    added = np.zeros((PARTS, len(books[0]), step + 1), np.int64)
    for r in told.groupBy("part", "entry", "dim").agg(F.sum("value").alias("value")).collect():  # one row a codebook component
        added[r.part, r.entry, r.dim] = r.value
    counts = added[:, :, step]
    return [np.where(counts[p][:, None] > 0, added[p, :, :step] // np.maximum(counts[p], 1)[:, None], books[p]) for p in range(PARTS)]


def learn(vectors: DataFrame) -> list[np.ndarray]:
    """Four codebooks (entries x components), learnt on all usable vectors; an empty list if there are none."""
    good = usable(vectors)
    longest = good.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return []
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    books = _first_books(good, width)
    for _ in range(ROUNDS):
        books = _renewed(good, books, width)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], *columns: str) -> DataFrame:
    """code (two hex digits a part) and error (squared distances summed over parts) of every usable vector, beside ``columns``."""
    step = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = integers(batch.column(0), step * PARTS)
            codes, error = np.zeros((len(whole), PARTS), np.uint8), np.zeros(len(whole), np.int64)
            for p, book in enumerate(books):
                index, distance = nearest(whole[:, p * step : (p + 1) * step], book)
                codes[:, p] = index
                error += distance
            text = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string()), pa.array(error)], names=[*columns, "code", "error"])

    good = usable(vectors).select("embedding", *columns)
    schema = good.drop("embedding").schema.add("code", "string").add("error", "long")
    return mapped(good, run, schema)


def decode(codes: list[str], books: list[np.ndarray]) -> np.ndarray:
    """Integer vectors that codes stand for."""
    index = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, PARTS)
    return np.concatenate([book[index[:, p]] for p, book in enumerate(books)], axis=1)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    spark = vectors.sparkSession
    books = learn(vectors)
    if not books:
        none = vectors.limit(0).select("vec_id")
        return none.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = keep(encode(vectors, books, "vec_id", "label"), "codes")
    sums = keep(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")).coalesce(max(1, parts(spark) // 8)), "label_errors")
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    told = coded.join(sums, coded.label.eqNullSafe(sums._label))
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors of ``embeddings``."""
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds as SQL: one relation of codebooks and one of nearest entries a round."""
    near = """n{i} AS MATERIALIZED (SELECT vec, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT w.vec, w.part, b.entry, list_sum(list_transform(list_zip(w.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM parts w JOIN b{i} b ON w.part = b.part) GROUP BY vec, part)"""
    book = """b{j} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (
  SELECT part, entry, list(c ORDER BY dim) AS v FROM (
    SELECT n.part, n.entry, dim, floor(sum(w.v[dim])::DOUBLE / count(*))::BIGINT AS c
    FROM n{i} n JOIN parts w ON w.vec = n.vec AND w.part = n.part, range(1, 17) d(dim) GROUP BY n.part, n.entry, dim) GROUP BY part, entry) m
  ON m.part = b.part AND m.entry = b.entry)"""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(near.format(i=i))
        if i < ROUNDS:
            steps.append(book.format(i=i, j=i + 1))
    return f"""WITH good AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS vec, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec, p AS part, v[16 * p + 1 : 16 * p + 16] AS v FROM good, range(0, 4) r(p)),
b0 AS MATERIALIZED (SELECT part, vec - 1 AS entry, v FROM parts WHERE vec <= 256),
{', '.join(steps)},
codes AS (SELECT vec, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} GROUP BY vec),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM good JOIN codes USING (vec), books"""


#: DuckDB SQL of the query for vectors of 64 components.
ORACLE = _oracle()
