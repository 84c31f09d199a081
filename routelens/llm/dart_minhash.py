"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its word 5-shingles (lower case, split at white
space), a shingle's weight its count; a shorter text is one shingle of all its
words. Hashed darts fall on each unit of weight of an element as a Poisson process
in rank, the same in every document that holds the element; each dart belongs to
one of ``BANDS * ROWS`` coordinates, and the earliest of each is its signature: two
documents agree in a coordinate with the probability of their weighted Jaccard
likeness. Only darts up to a rank that suffices to fill the coordinates are thrown.

Equal texts are one node first. Nodes that agree on all rows of a band are
candidates. A bucket isn't expanded into pairs: its members are compared with one
centre, in full, by weighted Jaccard of the shingles; links make components. Where a
bucket still holds several components, its other members are dealt to blocks, so that
every two of different components meet in one task, and are compared there, first by
their signatures and then in full. Such a task returns rows of nodes or the tree that
joins them, never pairs: what is written grows with the members times the blocks of
their bucket. The largest component of a bucket isn't compared with itself. A link is
lost only if none of the bands shows it: a chance of (1 - 0.8 ** 4) ** 24, or 3.2e-6,
at a likeness of 0.8, and falling fast.

Null texts count as empty. Texts without words have no shingles: such a text is
alike only to equal texts. Rows that repeat a doc_id are nodes by their text. A
class is named by its smallest doc_id (null sorts first and is kept). Where texts are
equal, a null doc_id and the least long count as one. Other columns are kept by
``dedup_documents`` and ignored otherwise; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keep, mapped, mix, prefix_hash, span_hash, spread, table, texts_of
from .graph import components

WORDS, LIKENESS = 5, 0.8
BANDS, ROWS = 24, 4
#: Most members of a block, and their weight, on the mean; two blocks meet in a task.
BLOCK_ROWS, BLOCK_WEIGHT = 1024, 1 << 20
#: Most cells of a table of members by shingles.
CELLS = 1 << 22
#: Least share of agreeing coordinates of a pair worth comparing: six deviations below ``LIKENESS``.
LEAST_AGREEMENT = 0.55
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)])


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the word shingles of a text, and their counts."""
    units = np.frombuffer((text.lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = ~_SPACE[np.minimum(units, 0x2FFF)] & (units != 0x3000)
    edge = np.diff(solid.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = span_hash(prefix_hash(units), first, last)
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for i in range(min(words, len(h))):
            out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of each coordinate: ids, as many as coordinates; empty for an empty set.

    ``weights`` may be any positive numbers: the last unit of weight of an element is
    accepted where the dart's place in it is below the remainder.
    """
    if not len(elements):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        units = np.ceil(weights).astype(np.int64)
        of = np.repeat(np.arange(len(elements)), units)
        copy = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
        region = mix(elements[of] + copy.astype(U64) * U64(0x2545F4914F6CDD1D))
        room = weights[of] - copy  # of this unit of weight; 1 and more: all of it
        limit = size * (np.log(size) + 2) / float(np.sum(weights))
        while True:
            best, found = np.full(size, np.inf), np.zeros(size, U64)
            live, rank, thrown = np.arange(len(region)), np.zeros(len(region)), 0
            while len(live):
                # The next darts of each region: hashed exponential gaps in rank, many at once where regions are few.
                turns = np.arange(thrown, thrown + max(1, 512 // len(live)), dtype=U64)
                darts = mix(region[live][:, None] + (turns + U64(1)) * U64(0x9E3779B97F4A7C15))
                ranks = rank[:, None] + np.cumsum(-np.log1p(-(darts >> U64(11)).astype(np.float64) / 2.0**53), axis=1)
                again = mix(darts)
                hit = (ranks <= limit) & ((again >> U64(11)).astype(np.float64) / 2.0**53 <= room[live][:, None])
                ids, where, at = again[hit], (again[hit] % U64(size)).astype(np.int64), ranks[hit]
                np.minimum.at(best, where, at)
                first = at == best[where]
                found[where[first]] = ids[first]
                on = ranks[:, -1] <= limit
                live, rank, thrown = live[on], ranks[on, -1], thrown + len(turns)
            if np.isfinite(best).all():
                return found
            limit *= 2


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two weighted sets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the two hashes of the text, the weight of its set, band keys, and signature bytes (32 bits a coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS, dtype=U64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                own = batch.slice(start, 512)
                weight, keys, marks = [], [], []
                for text in texts_of(own["text"]):
                    elements, counts = shingles(text)
                    found = signature(elements, counts.astype(np.float64))
                    weight.append(int(counts.sum()))
                    marks.append(found.astype("<u4").tobytes())
                    if len(found):
                        with np.errstate(over="ignore"):
                            key = band
                            for column in found.reshape(BANDS, ROWS).T:
                                key = mix(key * U64(0x9E3779B97F4A7C15) + column)
                        keys.append(key.astype(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["a"], own["b"], pa.array(weight, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["doc_id", "a", "b", "weight", "bands", "marks"])

    return _keyed(docs).select("doc_id", "a", "b", "text").transform(mapped, run, "doc_id long, a long, b long, weight long, bands array<long>, marks binary")


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = [press.compress(t.encode("utf-8", "surrogatepass")) for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["a"], batch["b"], pa.array(blobs, pa.binary())], ["doc_id", "a", "b", "blob"])

    return _keyed(docs).select("doc_id", "a", "b", "text").transform(mapped, run, "doc_id long, a long, b long, blob binary")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) whose texts are alike."""
    left = pairs.join(texts.select(F.col("node").alias("x"), F.col("blob").alias("one")).hint("merge"), "x")
    both = left.join(texts.select(F.col("node").alias("y"), F.col("blob").alias("other")).hint("merge"), "y").select("x", "y", "one", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        read = lambda blob: shingles(unpress.decompress(blob).decode("utf-8", "surrogatepass"))
        last: tuple[int | None, tuple] = (None, ())
        for batch in batches:
            x, y = batch["x"].to_pylist(), batch["y"].to_pylist()
            good = []
            for i, node in enumerate(y):
                if last[0] != node:  # rows come sorted by y, the centre
                    last = node, read(batch["other"][i].as_py())
                good.append(likeness(read(batch["one"][i].as_py()), last[1]) >= LIKENESS)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    return both.transform(mapped, run, "x long, y long")


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough to be worth comparing, sizes included."""
    x = marks.select(F.col("node").alias("x"), F.col("marks").alias("one"), F.col("weight").alias("w"))
    y = marks.select(F.col("node").alias("y"), F.col("marks").alias("other"), F.col("weight").alias("v"))
    near = pairs.join(x.hint("merge"), "x").join(y.hint("merge"), "y").where((F.least("w", "v") >= F.greatest("w", "v") * LIKENESS) & (F.col("one") != F.lit(b"")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("one", "other"))
                yield pa.RecordBatch.from_arrays([batch["x"], batch["y"]], ["x", "y"]).filter(pa.array((one == other).mean(1) >= LEAST_AGREEMENT))

    return near.select("x", "y", "one", "other").transform(mapped, run, "x long, y long")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (node, key) whose key another node has as well."""
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return rows.join(several.hint("merge"), "key").select("node", "key")


def _centred(members: DataFrame) -> DataFrame:
    """Members with their bucket's centre y: the first by hash, the same order in all buckets, so that a group meets few centres."""
    centres = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("y"))).alias("c")).select("key", "c.y")
    return members.join(centres.hint("merge"), "key")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label of the members of buckets that hold several components; the centre, compared with all, is left out."""
    rows = members.where("node <> y").join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return rows.join(several.hint("merge"), "key")


def _dealt(apart: DataFrame, rows: int, weight: int) -> DataFrame:
    """The members once for each pair (i, j) of blocks in which they are compared; ``block`` is their own.

    Blocks 0 to ``others`` - 1 hold the members outside the bucket's largest component, the
    further ones that component: it meets the others, not itself.
    """
    sizes = apart.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).groupBy("key")
    sizes = sizes.agg(F.max(F.struct("n", "label", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.lit(1.0), F.ceil(n / rows), F.ceil(w / weight)).cast("int")
    sizes = sizes.select("key", F.col("main.label").alias("most"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("others"), blocks(F.col("main.n"), F.col("main.w")).alias("own"))
    inner, place = F.col("label") == F.col("most"), F.xxhash64(F.lit(3), "node")
    block = F.when(inner, F.col("others") + F.pmod(place, "own")).otherwise(F.pmod(place, "others")).cast("int")
    meets = F.sequence(F.lit(0), F.when(inner, F.col("others") - 1).otherwise(F.col("others") + F.col("own") - 1))
    dealt = apart.join(sizes.hint("merge"), "key").withColumn("block", block).withColumn("m", F.explode(meets))
    return dealt.select("key", F.least("m", "block").alias("i"), F.greatest("m", "block").alias("j"), "block", "node", "label", "weight")


_PAIR = ["key", "i", "j"]


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_PAIR).sortWithinPartitions(*_PAIR, "node")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The rows of each pair of blocks, as they come sorted, with the numbers of those of its two sides."""

    def sides(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        block, i, j = (np.array(rows[c]) for c in ("block", "i", "j"))
        return rows, np.flatnonzero(block == i), np.flatnonzero(block == j)

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([np.array(batch[c]).astype(np.int64) for c in _PAIR])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (keys[a] != last).any():
                yield sides(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield sides(held)


def _possible(label: np.ndarray, weight: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs of the two sides are of different components and of sizes that can be alike."""
    w, v = weight[one][:, None], weight[other][None]
    return (label[one][:, None] != label[other][None]) & (np.minimum(w, v) >= LIKENESS * np.maximum(w, v))


def _agreeing_members(dealt: DataFrame) -> DataFrame:
    """The dealt rows (with marks) that have a partner in their pair of blocks whose signature agrees enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, one, other in _groups(batches):
            marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), "<u4").reshape(rows.num_rows, -1)
            fit = _possible(np.array(rows["label"]), np.array(rows["weight"]), one, other)
            same = np.zeros(fit.shape, np.uint8)
            for a, b in zip(marks[one].T, marks[other].T, strict=True):
                same += a[:, None] == b[None]
            fit &= same >= LEAST_AGREEMENT * marks.shape[1]
            good = np.zeros(rows.num_rows, bool)
            good[one[fit.any(1)]] = good[other[fit.any(0)]] = True
            if good.any():
                yield from rows.drop_columns(["marks"]).filter(pa.array(good)).to_batches()

    return _together(dealt).transform(mapped, run, "key long, i int, j int, block int, node long, label long, weight long")


def shared_weight(one: list[tuple[np.ndarray, np.ndarray]], other: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weight that each of the first sets shares with each of the others: products of members by shingles, some shingles at a time."""

    def units(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        e, n = (np.concatenate(c) for c in zip(*sets, strict=True))
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets]), n)
        with np.errstate(over="ignore"):
            return of, mix(np.repeat(e, n) + copy.astype(U64) * U64(0x2545F4914F6CDD1D))

    (a, x), (b, y) = units(one), units(other)
    both = np.intersect1d(x, y)
    out = np.zeros((len(one), len(other)), np.float32)
    step = max(1, CELLS // max(len(one), len(other)))
    sides = []
    for of, e, n in ((a, x, len(one)), (b, y, len(other))):
        at = np.minimum(np.searchsorted(both, e), max(0, len(both) - 1))
        held = both[at] == e if len(both) else np.zeros(len(e), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((of[held][order], at[held][order], n))
    for begin in range(0, len(both), step):
        tables = []
        for of, at, n in sides:
            lo, hi = np.searchsorted(at, [begin, begin + step])
            cells = np.zeros((n, min(step, len(both) - begin)), np.float32)
            cells[of[lo:hi], at[lo:hi] - begin] = 1
            tables.append(cells)
        out += tables[0] @ tables[1].T
    return out


def _joined(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a table of links between two sides: for the members of each, the number of its first, counted over both sides."""
    a, b = np.arange(links.shape[0]), links.shape[0] + np.arange(links.shape[1])
    far = sum(links.shape)
    while True:
        low_b = np.minimum(b, np.where(links, a[:, None], far).min(0))
        low_a = np.minimum(a, np.where(links, low_b[None], far).min(1))
        if (low_a == a).all() and (low_b == b).all():
            return a, b
        a, b = low_a, low_b


def _block_links(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """x, y: components that links of their members join, as a tree for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for rows, one, other in _groups(batches):
            label, weight = np.array(rows["label"]), np.array(rows["weight"])
            sets = [shingles(unpress.decompress(b).decode("utf-8", "surrogatepass")) for b in rows["blob"].to_pylist()]
            if not len(one) or not len(other):
                continue
            shared = shared_weight([sets[k] for k in one], [sets[k] for k in other])
            links = _possible(label, weight, one, other) & (shared / (weight[one][:, None] + weight[other][None] - shared) >= LIKENESS)
            if links.any():
                member = label[np.concatenate([one, other])]
                root = member[np.concatenate(_joined(links))]
                pairs = np.unique(np.column_stack([member, root])[member != root], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    return _together(dealt.join(texts.hint("merge"), "node")).select(*_PAIR, "block", "label", "weight", "blob").transform(mapped, run, "x long, y long")


def classes(docs: DataFrame, block_rows: int = BLOCK_ROWS, block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """doc_id, a, b (hashes of the text), class_id of every row of ``docs``, and whether it is the one to keep (or repeats it)."""
    docs = spread(docs.select("doc_id", "text"))
    own = keep(sketches(docs), "sketches")
    groups = own.groupBy("a", "b").agg(F.min(F.struct("doc_id")).alias("least"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = keep(groups.select("a", "b", F.col("least.doc_id").alias("doc_id"), "weight", "bands", "marks", F.monotonically_increasing_id().alias("node")), "nodes")
    members = keep(_centred(_crowded(nodes.select("node", F.explode("bands").alias("key")))), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "a", "b").hint("merge"), "node")
    # Texts of all that may be compared, fetched once.
    low = F.lit(-(1 << 63))
    wanted = wanted.select("node", F.coalesce("doc_id", low).alias("k"), "a", "b").hint("merge")
    texts = keep(_packed(docs).withColumn("k", F.coalesce("doc_id", low)).join(wanted, ["k", "a", "b"]).select("node", "blob").dropDuplicates(["node"]), "texts")
    marks = nodes.select("node", "marks", "weight")
    stars = members.where("node <> y").select(F.col("node").alias("x"), "y").distinct()
    labels = components(keep(_links(_agreeing(stars, marks), texts), "links"))
    # Documents that merely share a passage meet in a few buckets, and no centre links them.
    apart = keep(_apart(members, labels).join(nodes.select("node", "weight").hint("merge"), "node"), "apart")
    dealt = _dealt(apart, block_rows, block_weight).join(marks.select("node", "marks").hint("merge"), "node")
    near = keep(_agreeing_members(dealt.select(*_PAIR, "block", "node", "label", "weight", "marks")), "near")
    joined = components(keep(_block_links(near, texts), "links"))
    label = nodes.join(labels.hint("merge"), "node", "left").select("a", "b", "doc_id", F.coalesce("label", "node").alias("node"))
    label = label.join(joined.hint("merge"), "node", "left").select("a", "b", "doc_id", F.coalesce("label", "node").alias("label"))
    own_label = keep(label, "labels")
    least = own_label.groupBy("label").agg(F.min(F.struct("doc_id", "a", "b")).alias("least"))
    named = keep(own_label.join(least.hint("merge"), "label").select("a", "b", "least"), "classes")
    best = F.struct("doc_id", "a", "b") == F.col("least")
    return own.select("doc_id", "a", "b").join(named.hint("merge"), ["a", "b"]).select("doc_id", "a", "b", F.col("least.doc_id").alias("class_id"), best.alias("best"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class: the one with the smallest doc_id, all columns as they were."""
    lowest, text = F.lit(-(1 << 63)), F.coalesce("text", F.lit(""))
    best = keep(classes(docs).where("best").select("doc_id", "a", "b").distinct(), "survivors")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", lowest).alias("k"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    keys = best.select(F.coalesce("doc_id", lowest).alias("k"), "a", "b").hint("merge")
    return rows.join(keys, ["k", "a", "b"], "left_semi").dropDuplicates(["k", "a", "b"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("best").alias("kept"))
