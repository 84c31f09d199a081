"""Repeated line runs by a suffix array over line identifiers.

The lines of a document that aren't blank, trimmed, are its sequence. Equal texts are one
sequence. The suffixes that share their first line with others are sorted by distributed
prefix doubling: a suffix's path holds the identifier of its first line, then its ranks by
2, 4, 8 ... lines, each from the pair of its rank so far and the path of the suffix that
many lines on. A suffix leaves the rounds when its rank is its own or its sequence ends;
the rounds end when none is left. The paths then order the whole suffix array, and two
neighbours' longest common prefix is told by their paths to a power of two, and exactly by
look-ups of shorter and shorter prefixes behind it (``suffix_array``).

Where neighbours share fewer than ``min_lines`` lines (a power of two) the array is cut.
The pieces are its longest-common-prefix intervals of that depth: their suffixes all begin
with one repeated run. A line goes if it lies in the run of a member that isn't its
interval's earliest, by (doc_id, digest of the text, line). Such runs overlap where a
longer one repeats, so together they are the maximal repeated runs without their first
copies. Blank lines stay. A later copy of a document may become empty. Single repeated
lines (closing brackets, headings, refrains) stay in a text whose other lines are its own.

Null texts count as empty; an empty text is one blank line. Rows that repeat both
doc_id and text are one document with one result; a null doc_id counts as the least long.
The search is DataFrame code: groups are aggregated to a row before they meet their
members, and a frequent line's members are a skewed side of a join that Spark can split.
Only the rewriting of the texts is Python, an Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, mapped, parts, spread, table, texts_of

MIN_LINES = 2
#: Rounds after which the lines to look up are narrowed down; the others are too near to one that did.
_NARROWED = {1, 8, 64, 512, 4096, 32768}
_KEY = ["key", "digest"]
REPORT = "doc_id long, n_lines long, n_removed long, n_runs long, longest_run long, n_chars_kept long, kept_sha256 string"


def _sequences(docs: DataFrame) -> DataFrame:
    """A row for each text: its hashes, the least key that has it, and two hashes of each line that isn't blank, in order."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    lines = F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    rows = _key(docs).select(*_KEY, "other", lines.alias("lines"))
    return rows.groupBy("digest", "other").agg(F.min("key").alias("key"), F.first("lines").alias("lines")).withColumn("n", F.size("lines"))


def _doubled(sequences: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Suffixes (key, digest, at, n, path) that share their first line, all lines with their paths, and the last round's length."""
    lines = sequences.select(*_KEY, "n", F.posexplode("lines").alias("at", "x")).select(*_KEY, "n", "at", F.array("x.a", "x.b").alias("path"))
    shared = lines.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    first = keep(lines.join(shared.hint("merge"), "path", "left").select(*_KEY, "n", "at", "path", F.col("members").isNotNull().alias("live")), "lines")
    alone, done, live, h = first.where("NOT live"), None, first.where("live"), 1
    ended = alone
    while live.limit(1).count():
        ahead = ended.unionByName(live).select(*_KEY, (F.col("at") - h).alias("at"), F.col("path").alias("second"))
        group = F.col("path") if h == 1 else F.slice("path", -1, 1)  # a rank says as much as the path to it
        pairs = live.join(ahead.hint("merge"), [*_KEY, "at"], "left").select(*_KEY, "n", "at", "path", group.alias("g"), F.coalesce("second", F.array().cast("array<bigint>")).alias("second"))
        pairs = keep(pairs, "pairs")
        ranks = pairs.groupBy("g", "second").agg(F.count(F.lit(1)).alias("members"))
        # Ids that rise with the partition and the row in it keep the order of the range sort.
        ranks = keep(ranks.repartitionByRange(parts(pairs.sparkSession), "g", "second").sortWithinPartitions("g", "second").withColumn("rank", F.monotonically_increasing_id()), "ranks")
        on = (F.col("members") > 1) & (F.size("second") > 0)
        joined = keep(pairs.join(ranks.hint("merge"), ["g", "second"]).select(*_KEY, "n", "at", F.concat("path", F.array("rank")).alias("path"), on.alias("live")), "suffixes")
        now, live = joined.where("NOT live"), joined.where("live")
        done = now if done is None else done.unionByName(now)
        ended = ended.unionByName(now)
        if h in _NARROWED:  # only documents that still have a suffix in the rounds are looked up in
            ended = keep(ended.join(live.select(*_KEY).distinct().hint("merge"), _KEY, "left_semi"), "ended")
        h *= 2
    columns = [*_KEY, "n", "at", "path"]
    suffixes = live.select(*columns) if done is None else done.select(*columns)
    return suffixes, alone.select(*columns).unionByName(suffixes), h


def _array(suffixes: DataFrame) -> DataFrame:
    """The suffix array: part, place (ascending), the suffix, the one before it, and their common prefix to a power of two."""
    order = ["path", *_KEY, "at"]
    own = suffixes.repartitionByRange(parts(suffixes.sparkSession), *order).sortWithinPartitions(*order)
    own = keep(own.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "array")
    me = F.struct(*_KEY, "n", "at", "path")
    here = W.partitionBy("part").orderBy("place")
    # One row for each partition: what stands last in those before it.
    lasts = own.groupBy("part").agg(F.max_by(me, "place").alias("last"))
    lasts = lasts.select("part", F.lag("last").over(W.orderBy("part")).alias("carried"))
    both = own.join(F.broadcast(lasts), "part").withColumn("before", F.coalesce(F.lag(me).over(here), "carried"))
    same = lambda i: F.get("path", F.lit(i)) == F.get("before.path", F.lit(i))
    ranks = F.size(F.filter(F.zip_with(F.slice("path", 3, 64), F.slice("before.path", 3, 64), lambda x, y: x == y), lambda e: e))
    length = F.least(F.col("n") - F.col("at"), F.col("before.n") - F.col("before.at"))
    floor = F.least(F.pow(F.lit(2.0), ranks).cast("int"), length)
    return both.select("part", "place", *_KEY, "n", "at", "before", F.when(F.coalesce(same(0) & same(1), F.lit(False)), floor).otherwise(0).alias("common"))


def suffix_array(docs: DataFrame) -> DataFrame:
    """key, digest, at (place in the sequence), place in the array, and lcp: lines shared with the suffix before, exactly.

    Suffixes that share no line with another stand nowhere; equal texts are told once, by the least doc_id.
    """
    suffixes, lines, longest = _doubled(_sequences(docs))
    found = _array(keep(suffixes, "sorted"))
    pairs = keep(found.select("place", *_KEY, "at", F.col("before.key").alias("key2"), F.col("before.digest").alias("digest2"), F.col("before.at").alias("at2"), F.col("common").alias("floor"), F.col("common").alias("lcp")), "common")
    k = longest
    while k > 1:
        k //= 2
        level = k.bit_length()  # where a path has the rank by k lines
        rank = F.struct(F.get("path", F.lit(0)), F.get("path", F.lit(1))) if k == 1 else F.get("path", F.lit(level))
        step = lines.select(*_KEY, F.col("at").alias("to"), (F.col("n") - F.col("at")).alias("left"), rank.alias("r"))
        one = step.select(*_KEY, "to", F.col("left"), F.col("r").alias("r1"))
        two = step.select(F.col("key").alias("key2"), F.col("digest").alias("digest2"), F.col("to").alias("to2"), F.col("r").alias("r2"))
        asked = pairs.withColumns({"to": F.col("at") + F.col("lcp"), "to2": F.col("at2") + F.col("lcp")})
        met = asked.join(one, [*_KEY, "to"], "left").join(two, ["key2", "digest2", "to2"], "left")
        more = (F.col("floor") > k) & F.coalesce(F.col("r1") == F.col("r2"), F.lit(False))
        pairs = keep(met.select("place", *_KEY, "at", "key2", "digest2", "at2", "floor", (F.col("lcp") + F.when(more, F.least(F.lit(k), "left")).otherwise(0)).cast("int").alias("lcp")), "common")
    return pairs.select(*_KEY, "at", "place", "lcp")


def _later(found: DataFrame, min_lines: int) -> DataFrame:
    """Members of the intervals of depth ``min_lines`` that aren't their interval's earliest."""
    cut = F.when(F.col("common") < min_lines, F.col("place"))
    here = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    # An interval is named by the place where it begins, perhaps in a partition before.
    begun = found.groupBy("part").agg(F.max(cut).alias("begun"))
    begun = begun.select("part", F.max("begun").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    named = found.join(F.broadcast(begun), "part").select(*_KEY, "at", F.coalesce(F.max(cut).over(here), "carried").alias("interval"))
    named = keep(named, "intervals")
    me = F.struct(*_KEY, "at")
    firsts = named.groupBy("interval").agg(F.count(F.lit(1)).alias("members"), F.min(me).alias("first")).where("members > 1")
    return named.join(firsts.hint("merge"), "interval").where(me != F.col("first")).select(*_KEY, "at")


def removed_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """key, digest, and the places in the sequence of the lines to delete, a row for each document with any."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    sequences = keep(_sequences(docs), "sequences")
    later = _later(_array(_doubled(sequences)[0]), min_lines)
    covered = later.select(*_KEY, F.explode(F.sequence("at", F.col("at") + (min_lines - 1))).alias("at"))
    own = covered.groupBy(*_KEY).agg(F.sort_array(F.collect_set("at")).alias("places"))
    # A text that an earlier document has as well goes whole.
    sizes = sequences.where(F.col("n") >= min_lines).select("digest", "other", F.col("key").alias("earliest"), "n")
    copies = _key(docs).select(*_KEY, "other").distinct().join(sizes.hint("merge"), ["digest", "other"]).where("key <> earliest")
    return keep(own.unionByName(copies.select(*_KEY, F.sequence(F.lit(0), F.col("n") - 1).alias("places"))), "places")


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "digest": F.xxhash64(F.coalesce("text", F.lit(""))), "other": F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")))})


def split_lines(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the numbers of those in the sequence."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(" \t\r")]


def without(text: str, places: list[int] | None) -> str:
    """The text without the lines at these places of its sequence."""
    if not places:
        return text
    lines, numbers = split_lines(text)
    gone = {numbers[p] for p in places}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone)


def _with_places(docs: DataFrame, min_lines: int) -> DataFrame:
    """The columns of ``docs`` in one struct, and the places to delete."""
    places = removed_lines(docs.select("doc_id", "text"), min_lines)
    rows = _key(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", "key", "digest")
    # Both sides grow with the documents: merged, not broadcast, at every size.
    return rows.join(places.hint("merge"), _KEY, "left").select("row", "places")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` without the later copies of repeated line runs; n_chars, if there, is that of the new text."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch["row"])
            texts = [without(t, p) if p else t for t, p in zip(rows["text"].to_pylist(), batch["places"].to_pylist(), strict=True)]
            columns = {f.name: rows[f.name] for f in schema} | {"text": pa.array(texts, rows["text"].type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(rows["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return _with_places(docs, min_lines).transform(mapped, run, schema)


def report_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """A row for each document: lines in its sequence, removed lines and runs of them, the longest run, digest of the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch["row"])
            out = []
            for doc, text, places in zip(rows["doc_id"].to_pylist(), texts_of(rows["text"]), batch["places"].to_pylist(), strict=True):
                places = places or []
                ends = [i for i, p in enumerate(places) if i + 1 == len(places) or places[i + 1] != p + 1]
                sizes = [b - a for a, b in zip([-1, *ends], ends, strict=False)]
                kept = without(text, places)
                out.append((doc, len(split_lines(text)[1]), len(places), len(sizes), max(sizes, default=0), len(kept), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            if out:
                names = [c.split()[0] for c in REPORT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)

    return _with_places(docs.select("doc_id", "text"), min_lines).transform(mapped, run, REPORT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document without the later copies of runs of two lines or more."""
    return report_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line
  FROM documents
), marked AS (
  SELECT *, trim(x, ' ' || chr(9) || chr(13)) AS y FROM lines
), seq AS (
  SELECT doc_id, line, y, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place FROM marked WHERE y <> ''
), two AS (
  SELECT *, lead(y) OVER (PARTITION BY doc_id ORDER BY place) AS z FROM seq
), later AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY y, z ORDER BY doc_id, place) > 1 AS copy FROM two WHERE z IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, place FROM (SELECT doc_id, place FROM later WHERE copy UNION ALL SELECT doc_id, place + 1 FROM later WHERE copy)
), runs AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM gone) GROUP BY doc_id, island
), per_doc AS (
  SELECT doc_id, sum(n) AS n_removed, count(*) AS n_runs, max(n) AS longest_run FROM runs GROUP BY doc_id
), kept AS (
  SELECT m.doc_id, string_agg(m.x, chr(10) ORDER BY m.line) AS text
  FROM marked m LEFT JOIN seq s USING (doc_id, line) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.place = s.place
  WHERE g.place IS NULL GROUP BY m.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n_lines FROM seq GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(p.n_removed, 0)::BIGINT AS n_removed, coalesce(p.n_runs, 0) AS n_runs,
  coalesce(p.longest_run, 0) AS longest_run, length(coalesce(k.text, '')) AS n_chars_kept, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN per_doc p USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
