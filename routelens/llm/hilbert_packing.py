"""Sequence packing along a Hilbert curve.

Each document is tokenised once. Its token ids, hashed to signed directions, are
summed and so projected to three dimensions; the normal scores of these, in ten
bits each, are the cell whose Hilbert index is the document's key. Documents are
range-sorted by (key, doc_id, digest of the ids), so that a key shared by many
documents is still split between tasks, and each range is packed in one streaming
pass: neighbours on the curve follow each other, cut wherever a sequence fills.
Only the last sequence of a range can be short.

Null texts count as empty: their piece is the closing id 0 alone. Repeated rows
are packed each on their own; null doc_ids, and rows that repeat one, are packed like
others. An empty table gives no rows. Texts may hold characters of any kind; a lone
surrogate can't come from a table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keep, mapped, mix, spread, table, texts_of

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 1024
DIMENSIONS, BITS = 3, 10
#: Tokens of a range, on the mean: so many that the short last sequences stay few, and the same at every size.
RANGE_TOKENS = 2_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary as ranks for the faster library, if it stands beside the file."""
    import base64
    import os

    import tiktoken

    other = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.basename(path) != TOKENIZER or not os.path.exists(other):
        return None
    with open(other, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, without special tokens."""
    if fast := _fast(path):
        return [fast.encode_to_numpy(t, disallowed_special=()) for t in texts]
    return [np.array(e.ids, np.uint32) for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]


#: Tokens summed at a time, so that a packed count stays below its 20 bits.
_SUMMED = 1 << 20
_COUNT_BITS = 21


@lru_cache(maxsize=1)
def _directions(size: int = 1 << 16) -> np.ndarray:
    """For each hashed id, its signs in all dimensions: a bit for each, packed as counts into one integer."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(size, dtype=U64) + U64(0xA5A5))
    return sum((((h >> U64(k)) & U64(1)) << U64(_COUNT_BITS * k) for k in range(DIMENSIONS)), np.zeros(size, U64)).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of rows of cell coordinates (Skilling's transform)."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def cell(ids: np.ndarray) -> list[int]:
    """Cell of a document's hashed, projected token vector; its Hilbert index is the curve key."""
    table, plus = _directions(), [0] * DIMENSIONS
    for at in range(0, len(ids), _SUMMED):
        packed = int(table[ids[at : at + _SUMMED] & 0xFFFF].sum())
        for k in range(DIMENSIONS):
            plus[k] += packed >> (_COUNT_BITS * k) & ((1 << _COUNT_BITS) - 1)
    # Each dimension drifts with the length of the text; the normal score spreads it over the cells.
    score = [0.5 * (1 + math.erf((2 * p - len(ids)) / (4 * math.sqrt(max(1, len(ids)))))) for p in plus]
    return [min((1 << BITS) - 1, int(s * (1 << BITS))) for s in score]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, curve key, token count (with the closing id 0), digest and packed ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                out: list[list] = [[], [], [], []]
                for ids in encode_texts(texts_of(own["text"]), path):
                    a = np.zeros(len(ids) + 1, "<u4")
                    a[:-1] = ids
                    raw = (a.astype("<u2") if a.max() < 1 << 16 else a).tobytes()
                    for column, value in zip(out, (cell(a), len(a), zlib.crc32(raw), press.compress(raw)), strict=True):
                        column.append(value)
                out[0] = hilbert(np.array(out[0]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([own["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "key", "n", "digest", "ids"])

    return spread(docs.select("doc_id", "text")).transform(mapped, run, "doc_id long, key long, n long, digest long, ids binary")


def pack(docs: DataFrame, path: str, length: int = SEQUENCE) -> DataFrame:
    """A row for each piece of every document; pieces of a sequence follow each other from 0."""
    rows = keep(tokenised(docs, path), "tokens")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, total // RANGE_TOKENS)
    order = ["key", "doc_id", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        sequence, used = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, n, blob in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                raw = unpress.decompress(blob)
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    if used == length:
                        sequence, used = sequence + 1, 0
                    size = min(n - start, length - used)
                    piece = (doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, used)
                    for column, value in zip(out, piece, strict=True):
                        column.append(value)
                    start, used = start + size, used + size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [c.split()[0] for c in PIECES.split(", ")])

    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids").transform(mapped, run, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
