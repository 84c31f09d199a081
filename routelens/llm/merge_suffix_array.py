"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else as
well. Strings are reached from *anchors*: of the ``length`` - ``gram`` + 1 grams in a
window of ``length`` bytes, the one of least hash (the first of equals). Equal
windows have their anchors at the same offset, so only windows of anchors whose
gram occurs again can be equal; hashes that occur once are dropped first.

For an anchor and an interval of offsets, the *item* is the text from the window of
the least offset on, followed by what stands before it, backwards: the bytes that
all windows of the interval share come first. Each task sorts its items into a run,
keeps one of equal ones, and sends it front-coded (the length of the prefix shared
with the item before, and the rest). Each range of the order is merged by a loser
tree whose nodes hold common-prefix lengths: longer shared prefixes win unseen, and
known prefixes are never compared again. Equal items settle all their windows. An
item whose neighbours share the common bytes of its interval but not the rest is
split into shorter intervals for the next round, down to single windows; others
have no equal window. A frequent gram's items that are equal have been kept once a
task; those of very frequent grams, and the shorter intervals of these, are dealt by their
whole string, so that different texts round one common passage don't meet in one range.

A range holds ``RANGE_BYTES`` of text at every size. Beyond ``MOST_RANGES`` of them, the
anchors are taken in several passes, each with the grams of one share of all hashes: equal
windows have equal grams, so no match is lost, and a task's data doesn't grow.

Null texts count as empty; texts are UTF-8 and matches stay within a document.
A row that repeats doc_id and text is another document with that text. Where
removed bytes cut a character, the kept text drops what is left of it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, keep, mapped, mix, prefix_hash, span_hash, spread, table

LENGTH = 200
#: Bytes that windows are looked through at a time; offsets in them fit ``_PLACE`` bits beside a hash.
CHUNK, _PLACE = 1 << 20, 24
#: Anchors, bytes of items, and spans that a task holds before it sends them.
RUN_ANCHORS, RUN_BYTES, RUN_SPANS = 250_000, 10 << 20, 50_000
#: Bytes of text for each range of the order, and most ranges of one pass.
RANGE_BYTES, MOST_RANGES = 12 << 20, 50_000
#: A gram is very frequent from this number of anchors, or this share of them, on.
HOT_LEAST, HOT_SHARE = 200_000, 1e-3
_ENTRY, _CANDIDATE, _HOT, _RUN, _SPAN, _DOC = range(6)
_ROWS = "part int, kind int, key long, doc_id long, blob binary"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_KNOWN, _FREQUENT = 1, 2
_HEAD = 10  # bytes of an item before its text: hash of the shared bytes, and the interval


def gram_of(length: int) -> int:
    """Bytes of the grams among which anchors are chosen."""
    return max(2, length * 5 // 16)


def widths(length: int) -> list[int]:
    """Numbers of offsets in an interval, round by round."""
    out = [length - gram_of(length) + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // 4))
    return out


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the least and greatest offset of the windows it stands for."""
    gram = gram_of(length)
    wide = length - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(text) - length + 1), CHUNK):
        own = text[at : at + CHUNK + length - 1]
        h = prefix_hash(own)
        begin = np.arange(len(own) - gram + 1)
        full = span_hash(h, begin, begin + gram)
        key = (full >> U64(_PLACE) << U64(_PLACE)) | begin.astype(U64)
        size, least = 1, key
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        n = len(key) - wide + 1
        place = (np.minimum(least[:n], least[wide - size : wide - size + n]) & U64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        spot = place[first]
        # Anchors have small hashes; mixed again, they spread over all ranges.
        with np.errstate(over="ignore"):
            out.append((mix(full[spot] + U64(0x632BE59BD9B4E019)), spot + at, spot - last, spot - first))
    if not out:
        return np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one pressed string."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = raw[0], 1
    kinds = [struct.unpack_from("<2sQ", raw, at + 10 * i) for i in range(n)]
    at += 10 * n
    out = []
    for kind, size in kinds:
        dtype = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


def _joined(blobs: list[bytes]) -> bytes:
    """The arrays of several strings, one after another, in one."""
    return _pack(*(np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True)))


def _part(values: np.ndarray, n: int) -> np.ndarray:
    """The range, of n equal ranges of 64 bits, of each value."""
    return ((values >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _sections(part: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Each range with rows, and where they begin and end; ``part`` ascends."""
    edges = np.searchsorted(part, np.arange(n + 1))
    for k in range(n):
        if edges[k] < edges[k + 1]:
            yield k, int(edges[k]), int(edges[k + 1])


def _batch(rows: list[tuple[int, int, int | None, int | None, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _dealt(kind: int, keys: np.ndarray, n: int, *more: np.ndarray) -> Iterator[tuple]:
    """Rows that take arrays to the range of each document's key."""
    part = _part(keys, n)
    order = np.argsort(part, kind="stable")
    for k, a, b in _sections(part[order], n):
        own = order[a:b]
        yield k, kind, None, None, _pack(keys[own], *(x[own] for x in more))


def _in_documents(docs: DataFrame, n: int, run: Callable) -> DataFrame:
    """``run`` over (key, doc_id, text as bytes) of all rows; the key is a hash of doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), text).alias("key"), "doc_id", text.cast("binary").alias("text"))
    return rows.transform(mapped, run, _ROWS)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _send_hashes(length: int, n: int, turn: int = 0, turns: int = 1) -> Callable:
    """Each task's anchors of this pass, sorted by hash; of a hash that it holds more than once, one with their number."""

    def flush(found: list[tuple], keys: list[int]) -> Iterator[pa.RecordBatch]:
        hashes, place, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
        doc = np.array(keys, np.int64).astype(U64)[np.repeat(np.arange(len(found)), [len(f[0]) for f in found])]
        order = np.argsort(hashes, kind="stable")
        hashes, doc, place, low, high = hashes[order], doc[order], place[order].astype(np.uint32), low[order].astype(np.uint16), high[order].astype(np.uint16)
        first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        count = np.diff(np.append(first, len(hashes)))
        rest = np.ones(len(hashes), bool)
        rest[first] = False
        rows = list(_dealt(_CANDIDATE, doc[rest], n, hashes[rest], place[rest], low[rest], high[rest]))
        hashes, doc, place, low, high = (x[first] for x in (hashes, doc, place, low, high))
        for k, a, b in _sections(_part(hashes, n), n):
            names, index = np.unique(doc[a:b], return_inverse=True)
            rows.append((k, _ENTRY, None, None, _pack(hashes[a:b], count[a:b].astype(np.uint32), names, index.astype(np.uint32), place[a:b], low[a:b], high[a:b])))
        yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys, total = [], [], 0
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                own = anchors(np.frombuffer(text.as_buffer(), np.uint8), length)
                if turns > 1:
                    now = mix(own[0]) % U64(turns) == U64(turn)
                    own = tuple(c[now] for c in own)
                if len(own[0]):
                    found.append(own)
                    keys.append(key)
                    total += len(own[0])
                if total >= RUN_ANCHORS:
                    yield from flush(found, keys)
                    found, keys, total = [], [], 0
        if found:
            yield from flush(found, keys)

    return run


def _shared_hashes(n: int, hot_least: int = HOT_LEAST) -> Callable:
    """Anchors whose hash occurs again, dealt by document; and how often the most frequent hashes occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, ready = [], []
        for row in _rows_of(batches):
            if row[1] == _CANDIDATE:
                ready.append(row[4])
            else:
                hashes, count, names, index, place, low, high = _unpack(row[4])
                entries.append((hashes, count, names[index], place, low, high))
        if ready:
            yield _batch([(row[0], _CANDIDATE, None, None, _joined(ready))])
        if not entries:
            return
        hashes, count, doc, place, low, high = (np.concatenate(c) for c in zip(*entries, strict=True))
        found, inverse = np.unique(hashes, return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=len(found)).astype(np.int64)
        again = total[inverse] > 1
        rows = list(_dealt(_CANDIDATE, doc[again], n, hashes[again], place[again], low[again], high[again]))
        often = total >= hot_least
        rows.append((0, _HOT, int(total.sum()), None, _pack(found[often], total[often])))
        yield _batch(rows)

    return run


def _shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the longest common prefix; the first ``known`` bytes are equal."""
    end = min(len(a), len(b))
    while known < end:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            size = min(len(x), len(y))
            odd = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return known + size - (odd.bit_length() + 7) // 8
        known += len(x)
    return end


@dataclass
class Run:
    """Items of one kind of interval: text with head, document, anchor, its offsets, interval, flags."""

    items: list[bytes] = field(default_factory=list)
    about: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, item: bytes, *about: int) -> None:
        self.items.append(item)
        self.about.append(about)
        self.size += len(item) + 100


def _item(cover: bytes, o1: int, o2: int, c1: int, c2: int, length: int, head: bytes | None = None) -> bytes:
    """The item of offsets c1..c2 from the text of all windows of offsets o1..o2."""
    at = o2 - c1
    right = cover[at : at + length]
    head = head or xxhash.xxh3_64_digest(right[: length - (c2 - c1)])
    return head + bytes((c1, c2)) + right + cover[o2 - c2 : at][::-1]


def _sent(run: Run, length: int, n: int) -> Iterator[tuple]:
    """A run as rows: its items sorted and front-coded, one of equals; and the spans that equals settle."""
    spans: list[tuple[int, int, int]] = []
    out: dict[int, list] = {}
    order = sorted(range(len(run.items)), key=run.items.__getitem__)
    i = 0
    while i < len(order):
        item, j = run.items[order[i]], i + 1
        while j < len(order) and run.items[order[j]] == item:
            j += 1
        about = run.about[order[i]]
        if j - i > 1:
            spans += [_span(run.about[k], length) for k in order[i:j] if not run.about[k][6] & _KNOWN]
            about = (*about[:6], about[6] | _KNOWN)
        where = xxhash.xxh3_64_intdigest(item) if about[6] & _FREQUENT else int.from_bytes(item[:8], "big")
        part = (where >> 32) * n >> 32
        lcp, rest, info, last = out.setdefault(part, [[], [], [], [b""]])
        shared = _shared_prefix(last[0], item, 0)
        last[0] = item
        lcp.append(shared)
        rest.append(item[shared:])
        info.append(about)
        i = j
    for part, (lcp, rest, info, _) in out.items():
        keys, *more = (np.array(c, kind) for c, kind in zip(zip(*info, strict=True), (np.int64, *[np.int32] * 6), strict=True))
        yield part, _RUN, None, None, _pack(np.array(lcp, np.uint16), np.array([len(x) for x in rest], np.uint16), np.frombuffer(b"".join(rest), np.uint8), keys, *(x.astype(np.uint32 if k == 0 else np.uint8) for k, x in enumerate(more)))
    yield from _dealt_spans(spans, n)


def _span(about: tuple, length: int) -> tuple[int, int, int]:
    key, place, _, _, o1, o2, _ = about
    return key, place - o2, place - o1 + length


def _dealt_spans(spans: list[tuple[int, int, int]], n: int) -> Iterator[tuple]:
    """Spans, joined where they touch, dealt by document."""
    if spans:
        key, begin, stop = (np.array(c, np.int64) for c in zip(*spans, strict=True))
        order = np.lexsort((begin, key))
        key, begin, stop = key[order], begin[order], stop[order]
        # Far apart by document, spans of one axis; the furthest end so far tells where a new one begins.
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        shift = group * (int(stop.max()) - int(begin.min()) + 2)
        reach = np.maximum.accumulate(stop + shift)
        new = np.append(True, begin[1:] + shift[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        yield from _dealt(_SPAN, key[first].astype(U64), n, begin[first].astype(np.int32), (reach[last] - shift[last]).astype(np.int32))


def _one_a_place(doc: np.ndarray, hashes: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors sorted by document and place, one for each: a repeated row's come as often as the row.

    An anchor on either side of a chunk's boundary comes twice, each time with the offsets of one side.
    """
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return doc[first], hashes[first], place[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _sort_suffixes(length: int, n: int, hot: frozenset[int]) -> Callable:
    """Runs of the first round, from documents and their anchors whose hash occurs again."""
    wide = widths(length)[0]
    before, after = b"\xff" * (wide - 1), b"\xff" * (length + wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[tuple] = []
        ready: tuple | None = None
        own = Run()
        for _, kind, key, _, blob in _rows_of(batches):  # candidates first, then documents
            if kind == _CANDIDATE:
                wanted.append(tuple(_unpack(blob)))
                continue
            if not wanted:
                return
            if ready is None:
                columns = [np.concatenate(c) for c in zip(*wanted, strict=True)]
                order = np.lexsort((columns[2], columns[0]))
                ready = _one_a_place(*(c[order] for c in columns))
            name = np.int64(key).astype(U64)
            a, b = np.searchsorted(ready[0], name), np.searchsorted(ready[0], name, side="right")
            if a == b:
                continue
            # A byte that no text has stands beyond either end.
            text = before + zstandard.ZstdDecompressor().decompress(blob) + after
            for h, place, low, high in zip(*(c[a:b].tolist() for c in ready[1:]), strict=True):
                cover = text[place : place + wide - 1 + length]
                item = _item(cover, 0, wide - 1, 0, wide - 1, length, h.to_bytes(8, "big"))
                own.add(item, key, place, low, high, 0, wide - 1, _FREQUENT if h in hot else 0)
            if own.size >= RUN_BYTES:
                yield _batch(list(_sent(own, length, n)))
                own = Run()
        if own.items:
            yield _batch(list(_sent(own, length, n)))

    return run


def _decoded(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """Items of a front-coded run: prefix shared with the one before, item, about."""
    lcp, sizes, rest, *about = _unpack(blob)
    at, item = 0, b""
    for a in range(0, len(lcp), 256):
        own = slice(a, a + 256)
        for shared, size, info in zip(lcp[own].tolist(), sizes[own].tolist(), zip(*(c[own].tolist() for c in about), strict=True), strict=True):
            item = item[:shared] + rest[at : at + size].tobytes()
            at += size
            yield shared, item, info


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Items of sorted runs in one order, each with the prefix it shares with the one before.

    A loser tree: a node holds the run that lost there, and ``shared`` the prefix that a
    run's head has in common with the winner it lost to - all that later matches need.
    """
    k = len(runs)
    heads: list[tuple[int, bytes, tuple] | None] = [next(r, None) for r in runs]
    shared = [0] * k
    loser = [-1] * max(1, k)

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        m = _shared_prefix(x[1], y[1], shared[a])
        if m == len(x[1]) or m < len(y[1]) and x[1][m] < y[1][m]:
            shared[b] = m
            return True
        shared[a] = m
        return False

    winner = [0] * (2 * k)
    for i in range(2 * k - 1, 0, -1):
        if i >= k:
            winner[i] = i - k
        else:
            a, b = winner[2 * i], winner[2 * i + 1]
            winner[i], loser[i] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k else -1
    while k and (head := heads[top]) is not None:
        yield shared[top], head[1], head[2]
        heads[top] = following = next(runs[top], None)
        shared[top] = following[0] if following else 0
        i = (top + k) // 2
        while i:
            other = loser[i]
            x, y = heads[top], heads[other]
            if x is None or y is not None and (shared[other] > shared[top] or shared[other] == shared[top] and not beats(top, other)):
                loser[i], top = top, other
            i //= 2


def _merge_round(length: int, n: int, level: int) -> Callable:
    """Merge the runs of a range; settle equal items, send the parts of those that may have equal windows."""
    next_wide = [*widths(length), 0][level + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, settled = [], []
        for row in _rows_of(batches):
            if row[1] == _RUN:
                runs.append(_decoded(row[4]))
            else:
                settled.append(row[4])
        if settled:
            yield _batch([(row[0], _SPAN, None, None, _joined(settled))])
        spans: list[tuple[int, int, int]] = []
        children = Run()
        equals: list[tuple] = []
        item, near = b"", 0  # of the group of equals, and what it shares with the item before it

        def close(after: int) -> None:
            """The group of equals is complete; the next item shares ``after`` bytes with it."""
            key, place, low, high, o1, o2, flags = equals[0]
            known = len(equals) > 1 or flags & _KNOWN
            if known:
                spans.extend(_span(e, length) for e in equals if not e[6] & _KNOWN)
            if o1 == o2 or max(near, after) < _HEAD + length - (o2 - o1) and not flags & _FREQUENT:
                return
            right = item[_HEAD : _HEAD + length]
            cover = item[_HEAD + length :][::-1] + right
            for c1 in range(o1, o2 + 1, next_wide):
                c2 = min(c1 + next_wide - 1, o2)
                if low <= c2 and high >= c1:
                    children.add(_item(cover, o1, o2, c1, c2, length), key, place, low, high, c1, c2, (_KNOWN if known else 0) | flags & _FREQUENT)

        for shared, own, about in merge(runs):
            if equals and shared == len(own) == len(item):
                equals.append(about)
                continue
            if equals:
                close(shared)
                if children.size >= RUN_BYTES:
                    yield _batch(list(_sent(children, length, n)))
                    children = Run()
                if len(spans) >= RUN_SPANS:
                    yield _batch(list(_dealt_spans(spans, n)))
                    spans.clear()
            item, near, equals = own, shared, [about]
        if equals:
            close(0)
        yield _batch([*_sent(children, length, n), *_dealt_spans(spans, n)])

    return run


def _send_documents(n: int, least: int) -> Callable:
    """Documents of at least so many bytes, pressed, to the range of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            part = _part(np.array(batch["key"]).astype(U64), n).tolist()
            rows = zip(part, batch["key"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True)
            yield _batch([(k, _DOC, key, doc, press.compress(t.as_buffer())) for k, key, doc, t in rows if len(t.as_buffer()) >= least])

    return run


def _exchange(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionById(n, F.col("part"))


def ranges(docs: DataFrame) -> int:
    """Number of ranges for so much text: a task holds the runs of one."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // RANGE_BYTES))


def repeated_spans(docs: DataFrame, length: int, n: int, turns: int = 1, hot_least: int = HOT_LEAST) -> DataFrame:
    """Rows of packed (key, begin, end) of the repeated passages, dealt by document."""
    if not 8 <= length <= 360:
        raise ValueError("length must be from 8 to 360 bytes")
    out = None
    for turn in range(turns):
        entries = _in_documents(docs, n, _send_hashes(length, n, turn, turns))
        found = keep(_exchange(entries, n).transform(mapped, _shared_hashes(n, hot_least), _ROWS), "anchors")
        counts = found.where(F.col("kind") == _HOT).select("key", "blob").collect()  # a row for each range
        total = sum(r.key for r in counts)
        hot = frozenset(int(h) for r in counts for h, c in zip(*_unpack(bytes(r.blob)), strict=True) if c >= max(hot_least, HOT_SHARE * total))
        both = found.where(F.col("kind") == _CANDIDATE).union(_in_documents(docs, n, _send_documents(n, length)))
        rows = _exchange(both, n).sortWithinPartitions("kind").transform(mapped, _sort_suffixes(length, n, hot), _ROWS)
        for level in range(len(widths(length))):
            rows = _exchange(rows, n).transform(mapped, _merge_round(length, n, level), _ROWS)
        if turns > 1:
            rows = keep(rows, "spans")
        out = rows if out is None else out.union(rows)
    return out


def cut(text: bytes, begin: np.ndarray, stop: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the spans, the number of bytes removed, and of maximal runs of them."""
    kept, at, removed, runs = [], 0, 0, 0
    last = -1
    order = np.argsort(begin, kind="stable")
    for a, b in zip(np.maximum(begin[order], 0).tolist(), np.minimum(stop[order], len(text)).tolist(), strict=True):
        if a > last:
            runs += 1
            kept.append(text[at:a])
            removed -= a
            at, last = b, b
            removed += b
        elif b > last:
            removed += b - last
            at = last = b
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _with_spans(docs: DataFrame, length: int, run: Callable[[pa.StructArray, list[bytes], list[tuple]], pa.RecordBatch], schema: T.StructType | str, most: int, hot_least: int) -> DataFrame:
    """``run`` over batches of documents: their columns but the text, the texts, and their spans."""
    wanted = ranges(docs)
    turns = -(-wanted // most)
    n = -(-wanted // turns)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), text).alias("key"), "doc_id", text.cast("binary").alias("text"), F.struct(rest.alias("rest"), F.col("text").isNull().alias("void")).alias("row"))
    kind = rows.schema["row"].dataType
    sent = rows.transform(mapped, _send_rows(n), T.StructType.fromDDL(_ROWS).add("row", kind))
    both = repeated_spans(docs.select("doc_id", "text"), length, n, turns, hot_least).withColumn("row", F.lit(None).cast(kind)).union(sent)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple] = []
        ready: tuple | None = None
        for batch in batches:  # spans first, then documents
            kinds = batch["kind"].to_pylist()
            spans += [tuple(_unpack(batch["blob"][i].as_py())) for i, k in enumerate(kinds) if k == _SPAN]
            own = [i for i, k in enumerate(kinds) if k == _DOC]
            if own and ready is None:
                columns = [np.concatenate(c) for c in zip(*spans, strict=True)] if spans else [np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
                order = np.argsort(columns[0], kind="stable")
                ready = tuple(c[order] for c in columns)
            for at in range(0, len(own), 256):
                some = own[at : at + 256]
                texts, found = [], []
                for i in some:
                    name = np.int64(batch["key"][i].as_py()).astype(U64)
                    x, y = np.searchsorted(ready[0], name), np.searchsorted(ready[0], name, side="right")
                    texts.append(zstandard.ZstdDecompressor().decompress(batch["blob"][i].as_py()))
                    found.append((ready[1][x:y], ready[2][x:y]))
                yield run(batch["row"].take(pa.array(some)), texts, found)

    return _exchange(both, n).sortWithinPartitions("kind").transform(mapped, final, schema)


def _send_rows(n: int) -> Callable:
    """All documents, pressed, with their other columns, to the range of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            part = pa.array(_part(np.array(batch["key"]).astype(U64), n).astype(np.int32))
            blobs = pa.array([press.compress(t.as_buffer()) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), _DOC, np.int32)), batch["key"], batch["doc_id"], blobs, batch["row"]], [*_NAMES, "row"])

    return run


def report_passages(docs: DataFrame, length: int = LENGTH, most: int = MOST_RANGES, hot_least: int = HOT_LEAST) -> DataFrame:
    """A row for each document: its bytes, those removed, their maximal runs, and the digest of what is kept."""

    def run(row: pa.StructArray, texts: list[bytes], spans: list[tuple]) -> pa.RecordBatch:
        done = [cut(t, *s) for t, s in zip(texts, spans, strict=True)]
        columns = [pa.array(c, pa.int64()) for c in zip(*((len(t), d[1], d[2]) for t, d in zip(texts, done, strict=True)), strict=True)]
        digest = pa.array([hashlib.sha256(d[0]).hexdigest() for d in done])
        return pa.RecordBatch.from_arrays([row.field("rest").field("doc_id"), *columns, digest], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(spread(docs.select("doc_id", "text")), length, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", most, hot_least)


def dedup_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated passages; n_chars, if there, is that of the new text; null texts stay null."""
    schema = docs.schema
    names = schema.names

    def run(row: pa.StructArray, texts: list[bytes], spans: list[tuple]) -> pa.RecordBatch:
        rest = row.field("rest")
        columns = {c: rest.field(c) for c in names if c != "text"}
        void = row.field("void").to_pylist()
        kept = [None if v else cut(t, *s)[0].decode("utf-8", "ignore") for t, s, v in zip(texts, spans, void, strict=True)]
        if "n_chars" in columns:
            old = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([o if t is None else len(t) for t, o in zip(kept, old, strict=True)], columns["n_chars"].type)
        columns["text"] = pa.array(kept, pa.string())
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return _with_spans(docs, length, run, schema, MOST_RANGES, HOT_LEAST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document without what 200-byte strings repeat."""
    return report_passages(table(spark, sf_dir, "documents"))
