"""Indexes kept as tables: words with blocks of items, character runs for searches; and passages found by automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .running import running, settled

#: Items of a block; blocks that a query looks at before it knows what the others must reach.
BLOCK, SEEDS = 1024, 2
#: Words of the items of one shard (and one for each item); characters of the queries that a task gets, about.
SHARD_CELLS, DEAL_CHARS = 4_000_000, 64_000_000
#: Characters of the passages in one automaton at most (a longer passage stands alone).
AUTOMATON_CHARS = 1_000_000


def bag(text: Column) -> Column:
    """Distinct words of three letters and more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w{3,})"), F.lit(1)), lambda w: w != ""))


def word_index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (shard, rank, id, updated, more) and postings (shard, word, ranks); a shard has a bounded number of words of items.

    Items (id, text, updated, perhaps pinned) stand in the order in which ties are decided, so earlier blocks win them.
    """
    pinned = F.coalesce(F.col("pinned").cast("int") * 2, F.lit(0)) if "pinned" in items.columns else F.lit(0)
    words = items.select("id", F.col("updated").cast("long").alias("updated"), pinned.alias("more"), F.coalesce(bag(F.col("text")), F.array().cast("array<string>")).alias("w"))
    ranked = running(words, [-F.col("more"), -F.col("updated"), F.col("id")], upto=F.lit(1).cast("long"), cells=F.size("w").cast("long") + 1)
    placed = settled(ranked.select(F.floor((F.col("cells") - 1) / SHARD_CELLS).alias("shard"), (F.col("upto") - 1).alias("rank"), "id", "updated", "more", "w"))
    flat = placed.select("shard", "rank", F.explode("w").alias("word")).groupBy("shard", "word").agg(F.collect_list("rank").alias("ranks"))
    return placed.drop("w"), settled(flat)


def best_items(items: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """qid, id, score, place: for each query (qid, text) the k items that share most of its words; a pinned one scores two more.

    Queries are dealt to groups of bounded size for each shard of items; a group's task reads its shard's postings, then its
    queries one by one, and tells the k best of each: no row stands for a pair of a query and an item, or for a word of a query.
    """
    placed, postings = word_index(items)
    shards = (placed.agg(F.max("shard")).first()[0] or 0) + 1
    chars = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    deals = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // DEAL_CHARS))
    salts = 4 * deals
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    kinds = {f.name: f.dataType for f in placed.schema.fields} | {"qid": queries.schema["qid"].dataType}
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    own = placed.select("shard", every, F.lit(0).alias("kind"), none("qid"), F.array().cast("array<string>").alias("words"), F.array("rank").alias("ranks"), "id", "updated", "more")
    held = postings.select("shard", every, F.lit(1).alias("kind"), none("qid"), F.array("word").alias("words"), "ranks", none("id"), none("updated"), none("more"))
    bags = queries.select("qid", bag(F.col("text")).alias("words"))
    met = bags.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("qid"), F.lit(salts)).cast("int").alias("salt"), F.lit(2).alias("kind"), "qid", "words")
    asked = met.select("shard", "salt", "kind", "qid", "words", F.array().cast("array<bigint>").alias("ranks"), none("id"), none("updated"), none("more"))
    dealt = own.unionByName(held).unionByName(asked).repartition(deals * shards, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "qid")
    told = T.StructType([T.StructField("qid", kinds["qid"]), T.StructField("id", kinds["id"]), T.StructField("score", T.LongType()), T.StructField("updated", T.LongType())])
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("updated"), "id")
    found = dealt.mapInArrow(_best_in(k, block), told)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("qid", "id", "score", "place")


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range behind the other."""
    sizes = ends - begins
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Shard:
    """A shard's items and postings; the latter as runs, each of a word in a block."""

    def __init__(self, items: list[pa.RecordBatch], words: list[pa.RecordBatch], block: int) -> None:
        joined = pa.Table.from_batches(items)
        ranks = joined["ranks"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.items, first = joined.take(np.argsort(ranks)), int(ranks.min())
        n, updated, ids = len(ranks), self.items["updated"], self.items["id"]
        turns = pa.table({"a": updated.is_null(), "b": updated, "c": ids.is_valid(), "d": ids})
        self.turn = np.empty(n, np.int64)
        self.turn[pc.sort_indices(turns, [("a", "ascending"), ("b", "descending"), ("c", "ascending"), ("d", "ascending")]).to_numpy()] = np.arange(n)
        self.more, self.block = self.items["more"].to_numpy().astype(np.int64), np.arange(n) // block
        self.most = np.maximum.reduceat(self.more, np.arange(0, n, block))
        self.words, sizes, slots = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if words:
            table = pa.Table.from_batches(words)
            self.words, sizes = table["words"].combine_chunks().flatten(), pc.list_value_length(table["ranks"]).to_numpy()
            slots = table["ranks"].combine_chunks().flatten().to_numpy() - first
        word = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((slots, word))
        self.slots, key = slots[by], word[by] * len(self.most) + self.block[slots[by]]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        self.run, self.run_block = np.append(begins, len(key)), key[begins] % len(self.most)
        self.word_runs = np.searchsorted(key[begins] // len(self.most), np.arange(len(sizes) + 1))

    def best(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and scores of the k best items for a query's words.

        A block can't score more than the query's words that it holds, and the most that an item of it has from being pinned.
        The blocks of the highest bounds are scored first; others only where their bound reaches the k-th score found there.
        """
        runs = _ranges(self.word_runs[words], self.word_runs[words + 1])
        blocks = self.run_block[runs]
        bound = np.bincount(blocks, minlength=len(self.most)) + self.most
        seeds = np.zeros(len(bound), bool)
        seeds[np.argsort(-bound, kind="stable")[:SEEDS]] = True
        slots, keys = self._scored(runs[seeds[blocks]], seeds, k)
        rest = ~seeds & (bound > 0) & (bound >= (keys.min() // len(self.turn) if len(keys) == k else 0))
        if rest.any():
            more, others = self._scored(runs[rest[blocks]], rest, k)
            slots, keys = np.concatenate([slots, more]), np.concatenate([keys, others])
            chosen = np.argsort(-keys)[:k]
            slots, keys = slots[chosen], keys[chosen]
        return slots, keys // len(self.turn)

    def _scored(self, runs: np.ndarray, blocks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and keys of the k best items of the blocks; a key is the score, and the turn among equal ones."""
        n = len(self.turn)
        scores = np.bincount(self.slots[_ranges(self.run[runs], self.run[runs + 1])], minlength=n) + np.where(blocks[self.block], self.more, 0)
        slots = np.flatnonzero(scores)
        keys = scores[slots] * n + (n - 1 - self.turn[slots])
        if len(keys) > k:
            chosen = np.argpartition(keys, len(keys) - k)[len(keys) - k :]
            slots, keys = slots[chosen], keys[chosen]
        return slots, keys


def _best_in(k: int, block: int):
    """The function that reads groups of a shard's items, its postings and queries, and tells the best items of each query."""

    def told(shard: _Shard, qids: pa.Array, words: list[np.ndarray]) -> pa.RecordBatch:
        found = [shard.best(own, k) for own in words]
        slots = pa.array(np.concatenate([s for s, _ in found]))
        asked = qids.take(pa.array(np.repeat(np.arange(len(found)), [len(s) for s, _ in found])))
        columns = [asked, shard.items["id"].combine_chunks().take(slots), pa.array(np.concatenate([n for _, n in found])), shard.items["updated"].combine_chunks().take(slots)]
        return pa.RecordBatch.from_arrays(columns, ["qid", "id", "score", "updated"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items, words, shard, open_ = None, [], [], None, None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy() for c in ("shard", "salt", "kind")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end == begin:
                    continue
                piece, kind = batch.slice(begin, end - begin), marks[2, begin]
                if group != (now := tuple(marks[:2, begin])):
                    if open_ is not None:
                        yield told(shard, *open_)
                    group, items, words, shard, open_ = now, [], [], None, None
                if kind < 2:
                    (words if kind else items).append(piece)
                    continue
                if not items:
                    continue
                shard = shard or _Shard(items, words, block)
                known = pc.index_in(piece["words"].flatten(), shard.words)
                sizes = pc.fill_null(pc.list_value_length(piece["words"]), 0).to_numpy()
                known = np.split(pc.fill_null(known, -1).to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])
                qids, own = piece["qid"], [w[w >= 0] for w in known]
                if open_ is not None:  # rows of one query may go on from the batch before
                    qids, own = pa.concat_arrays([open_[0], qids]), open_[1] + own
                same = qids.dictionary_encode("encode").indices.to_numpy()
                firsts = np.flatnonzero(np.diff(same, prepend=-1))
                if len(firsts) < len(own):
                    own = [np.concatenate(own[i:j]) for i, j in zip(firsts, [*firsts[1:], len(own)], strict=True)]
                    qids = qids.take(pa.array(firsts))
                open_ = qids.slice(len(own) - 1), own[-1:]
                if len(own) > 1:
                    yield told(shard, qids.slice(0, len(own) - 1), own[:-1])
        if open_ is not None:
            yield told(shard, *open_)

    return run


def contained(docs: DataFrame, items: DataFrame, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """doc_id and item_id where a document (answer) holds an item (reference) as a run of characters, of any length.

    Items are cut into shards of bounded size; each shard's automaton reads every document once, whatever it finds. An
    empty item is in every document; null texts hold and are nothing.
    """
    sized = running(items.where("reference IS NOT NULL").select("item_id", "reference"), [F.xxhash64("reference"), F.col("item_id")], upto=F.length("reference") + 1)
    shards = settled(sized.select("item_id", "reference", F.floor((F.col("upto") - 1) / chars).alias("shard")))
    told = T.StructType([docs.schema["doc_id"], items.schema["item_id"]])
    context, out = docs.sparkSession.sparkContext, docs.sparkSession.createDataFrame([], told)
    asked = docs.where("answer IS NOT NULL").select("doc_id", "answer")
    for number in sorted(r.shard for r in shards.select("shard").distinct().collect()):
        held: dict[str, list] = {}
        for r in shards.where(F.col("shard") == number).collect():  # as many characters as one automaton may have
            held.setdefault(r.reference, []).append(r.item_id)
        out = out.unionByName(asked.mapInArrow(_found_in(context.broadcast(held)), told))
    return out


def _found_in(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        held, automaton = sent.value, ahocorasick.Automaton()
        for reference, ids in held.items():
            if reference:
                automaton.add_word(reference, ids)
        automaton.make_automaton()
        always = held.get("", [])
        for batch in batches:
            docs, items = [], []
            for doc, answer in zip(batch["doc_id"].to_pylist(), batch["answer"].to_pylist(), strict=True):
                found = {i for _, ids in automaton.iter(answer) for i in ids} if len(automaton) else set()
                found.update(always)
                docs += [doc] * len(found)
                items += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_id").type), pa.array(items)], ["doc_id", "item_id"])

    return run


def run_index(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """gram, key: the runs of three characters, in lower case, that a row's texts hold, ranged by gram. Built once, read by many searches."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grams = lambda c: F.regexp_extract_all(c, F.lit("(?s)(?=(.{3}))"), F.lit(1))  # a match at every place; a substring is sought from the text's begin each time
    lower = rows.select(key, *[F.coalesce(F.lower(t), F.lit("")).alias(f"t{i}") for i, t in enumerate(texts)])
    flat = lower.select(key, F.explode(F.array_distinct(F.concat(*[grams(F.col(f"t{i}")) for i in range(len(texts))]))).alias("gram"))
    return settled(flat.repartitionByRange(n, "gram", key))


def grams_of(term: str) -> list[str]:
    """The runs of three characters that whatever matches the term must hold; % and _ of the term stand for other characters."""
    return sorted({piece[i : i + 3] for piece in re.split("[%_]", term.lower()) for i in range(len(piece) - 2)})


def holding(rows: DataFrame, index: DataFrame, key: str, term: str, *texts: str) -> DataFrame:
    """Rows of which a text holds the term in any case. The index names the rows to look at; without three characters in a row all are."""
    grams = grams_of(term)
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(F.col(t).ilike(f"%{term}%"), F.lit(False))
    if grams:
        able = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(key)
        rows = rows.join(able, key, "left_semi")
    return rows.where(hit)
