"""Lempel-Ziv phrase fingerprints.

A text is parsed, left to right, into dictionary phrases: each phrase is the
shortest string that the dictionary of this text lacks, and joins it. The phrase
set is hashed and the ``SKETCH`` smallest hashes are the signature; two texts
are as alike as the share of the smallest hashes of their union that both hold,
an estimate of the Jaccard likeness of the phrase sets.

A text edited at its end shares the parse up to the edit, so both are parsed in
one go. The *next* document (descending doc_id, the first after the last) is
reached without a single-task window: documents go to ranges of doc_id, and the
largest row of each range is sent, as a guest, to the range above it as well.

Null texts count as empty; the fingerprint of an empty text is the empty string,
alike 1 to itself and 0 to any other. Equal texts have equal fingerprints. Rows
that share a doc_id follow each other in the order of their packed texts. A null
doc_id sorts below all others. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mapped, parts, prefix_hash, span_hash, spread, table, texts_of

SKETCH = 128
_LOWEST = -(1 << 63)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _parse(text: str, begin: int, stop: int, seen: set[str], spans: list[int]) -> int:
    """Add the phrases that end by ``stop`` to ``seen`` and their bounds to ``spans``; where the next begins."""
    size = 1
    while begin < stop:
        end = begin + size
        if end > stop:
            end = stop
        # The dictionary holds every prefix of its phrases: step up or down from the last size.
        if text[begin:end] in seen:
            end += 1
            while end <= stop and text[begin:end] in seen:
                end += 1
            if end > stop:
                return begin
        else:
            while end - 1 > begin and text[begin : end - 1] not in seen:
                end -= 1
        phrase = text[begin:end]
        seen.add(phrase)
        spans.append(begin)
        spans.append(end)
        size = end - begin
        begin = end
    return begin


def _hashes(text: str, spans: list[int]) -> np.ndarray:
    if not spans:
        return np.zeros(0, np.uint32)
    low = spans[0]
    units = np.frombuffer(text[low : spans[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.array(spans, np.int64) - low
    return (span_hash(prefix_hash(units), bounds[::2], bounds[1::2]) >> U64(32)).astype(np.uint32)


def _smallest(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:SKETCH]


def sketches(text: str, kept: int, other: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and of ``text[:kept] + other``."""
    seen: set[str] = set()
    spans: list[int] = []
    begin = _parse(text, 0, kept, seen, spans)
    shared = _smallest(_hashes(text, spans))
    own: list[int] = []
    _parse(text, begin, len(text), seen, own)
    for a, b in zip(own[::2], own[1::2], strict=True):
        seen.discard(text[a:b])
    tail, new = text[begin:kept] + other, []
    _parse(tail, 0, len(tail), seen, new)
    return (_smallest(np.concatenate([shared, _hashes(text, own)])), _smallest(np.concatenate([shared, _hashes(tail, new)])))


def sketch(text: str) -> np.ndarray:
    """Signature of a text: the smallest hashes of its phrase set, ascending."""
    spans: list[int] = []
    _parse(text, 0, len(text), set(), spans)
    return _smallest(_hashes(text, spans))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of the union that both signatures hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~twice]))[:SKETCH]
    last = first[-1] + 1
    return float(np.count_nonzero(twice[: min(last, len(twice))])) / len(first)


def name(signature: np.ndarray) -> str:
    """A signature as text: eight hexadecimal digits for each hash."""
    return signature.astype(">u4").tobytes().hex()


def _ranges(docs: DataFrame) -> tuple[list[int], dict[int, list[int]], int]:
    """Lower bounds of the ranges of doc_id, the guests by id, and the number of ranges."""
    ids = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc_id"))
    n = parts(docs.sparkSession)
    found = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(x) for x in found})
    edges = np.array(bounds, np.int64)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            values = np.array(batch["doc_id"])
            where = np.searchsorted(edges, values, side="right")
            for k in np.unique(where):
                best[int(k)] = max(best.get(int(k), _LOWEST), int(values[where == k].max()))
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.int32()), pa.array(best.values(), pa.int64())], ["k", "top"])

    tops = sorted((r.k, r.top) for r in ids.transform(mapped, top, "k int, top long").groupBy("k").agg(F.max("top").alias("top")).collect())
    guests: dict[int, list[int]] = defaultdict(list)
    for i, (k, _) in enumerate(tops):
        guests[tops[i - 1][1]].append(k)  # below the lowest range, the highest again
    return bounds, dict(guests), len(bounds) + 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and both likenesses."""
    docs = docs.select("doc_id", "text")
    bounds, guests, n = _ranges(docs)
    edges = np.array(bounds, np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                rows: list[tuple] = []
                ids = [_LOWEST if i is None else i for i in own["doc_id"].to_pylist()]
                for doc, k, text in zip(ids, np.searchsorted(edges, np.array(ids, np.int64), side="right").tolist(), texts_of(own["text"]), strict=True):
                    blob = press.compress(text.encode("utf-8", "surrogatepass"))
                    rows.append((k, False, doc, blob))
                    rows += [(j, True, doc, blob) for j in guests.get(doc, ())]
                kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["k", "guest", "doc_id", "blob"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range, doc_id descending, the guest last; a row waits for the signature of the next."""
        unpress = zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        before = waiting = last_range = None
        done = False
        for batch in batches:
            out: list[tuple] = []
            for k, guest, doc, blob in zip(*(batch[c].to_pylist() for c in ("k", "guest", "doc_id", "blob")), strict=True):
                if k != last_range:
                    before, waiting, last_range, done = None, None, k, False
                if done:
                    continue
                text = unpress.decompress(blob).decode("utf-8", "surrogatepass")
                if before:
                    prior_doc, prior = before
                    size = len(prior) // 3
                    kept, head = len(prior) - size, text[:size]
                    own, edited = sketches(prior, kept, head)
                    if waiting:
                        out.append((*waiting[0], likeness(waiting[1], own)))
                    edited_sha = hashlib.sha256((prior[:kept] + head).encode("utf-8", "surrogatepass")).hexdigest()
                    waiting = (None if prior_doc == _LOWEST else prior_doc, len(prior), edited_sha, name(own), name(edited), likeness(own, edited)), own
                if guest:
                    out.append((*waiting[0], likeness(waiting[1], sketch(text))))
                before, done = (doc, text), guest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    sent = spread(docs).transform(mapped, send, "k int, guest boolean, doc_id long, blob binary").repartitionById(n, F.col("k"))
    return sent.sortWithinPartitions("k", "guest", F.desc("doc_id"), "blob").transform(mapped, rows, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document against its edited text and the next document."""
    return fingerprints(table(spark, sf_dir, "documents"))
