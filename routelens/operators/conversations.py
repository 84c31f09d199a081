"""Conversation queries: listing, search, turns, context budgets, relevance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.views import table, view, with_views
from . import indexes
from .running import scan

#: Characters of context, of memory, and memories of it.
CONTEXT, MEMORY, TOP = 2000, 5000, 6
TERM = "die"


def conv_list(messages: DataFrame) -> DataFrame:
    """A row for each conversation: size, last turn, title from its first user message."""
    return messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"), F.min_by(F.substring("content", 1, 40), F.when(F.col("role") == "user", F.col("turn"))).alias("title"))


def chat_search(messages: DataFrame, term: str, index: DataFrame | None = None) -> DataFrame:
    """Conversations with a message that holds the term, in any case; all for a blank term."""
    if not term.strip():
        return messages.select("conversation_id").distinct()
    index = indexes.run_index(messages, "id", "content") if index is None else index
    return indexes.holding(messages, index, "id", term, "content").select("conversation_id").distinct()


def complete_turns(messages: DataFrame) -> DataFrame:
    """Adjacent pairs of a user message and the assistant's answer."""
    before = F.struct("role", "id", "content")
    rows = scan(messages, ["conversation_id"], [F.col("turn"), F.col("id")], before=("lag", before))
    return rows.where("role = 'assistant' AND before.role = 'user'").select("conversation_id", F.col("before.id").alias("user_id"), F.col("id").alias("assistant_id"), (F.length("content") + F.length("before.content")).alias("chars"), "content", F.col("before.content").alias("user_content"))


def turn_search(messages: DataFrame, term: str, n: int = 5) -> DataFrame:
    """The latest n messages that hold the term, as complete turns, each once."""
    pairs = complete_turns(messages)
    hits = messages.where(F.col("content").ilike(f"%{term}%")).orderBy(F.desc("id")).limit(n).select(F.col("id").alias("hit"))
    return pairs.join(F.broadcast(hits), (F.col("user_id") == F.col("hit")) | (F.col("assistant_id") == F.col("hit"))).select("conversation_id", "user_id", "assistant_id").distinct()


def prev_user_message(messages: DataFrame) -> DataFrame:
    """For each answer, the last user message before it."""
    rows = scan(messages.select("id", "conversation_id", "turn", "role"), ["conversation_id"], [F.col("turn"), F.col("id")], user_id=("last", F.when(F.col("role") == "user", F.col("id"))))
    return rows.where("role = 'assistant'").select("id", "user_id")


def context_budget(messages: DataFrame, chars: int = CONTEXT) -> DataFrame:
    """The newest complete turns of each conversation while they fit; it stops at the first that doesn't."""
    newest = W.partitionBy("conversation_id").orderBy(F.desc("user_id")).rowsBetween(W.unboundedPreceding, 0)
    return complete_turns(messages).withColumn("used", F.sum("chars").over(newest)).where(F.col("used") <= chars).select("conversation_id", "user_id", "used")


def memory_budget(messages: DataFrame, chars: int = MEMORY) -> DataFrame:
    """Messages of each conversation, newest first, taken if they still fit; others are passed over.

    Sizes are streamed in order through the task that has their conversation; only what is taken comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = None, 0
        for batch in batches:
            good = []
            for own, size in zip(batch["conversation_id"].to_pylist(), batch["size"].to_pylist(), strict=True):
                key, used = own, used if own == key else 0
                good.append(used + size <= chars)
                used += size if good[-1] else 0
            yield batch.filter(pa.array(good, pa.bool_()))

    sizes = messages.select("conversation_id", "turn", "id", F.length("content").alias("size"))
    ordered = sizes.repartition("conversation_id").sortWithinPartitions("conversation_id", F.desc("turn"), "id")
    taken = ordered.mapInArrow(run, "conversation_id long, turn long, id long, size int").groupBy("conversation_id").agg(F.sum("size").cast("int").alias("used"), F.sort_array(F.collect_list(F.struct((-F.col("turn")).alias("k"), "id"))).alias("m"))
    ids = F.concat_ws(",", F.transform("m", lambda x: x["id"].cast("string")))
    everyone = messages.select("conversation_id").distinct().join(taken, "conversation_id", "left")
    return everyone.select("conversation_id", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce(F.size("m"), F.lit(0)).alias("n"), F.coalesce(F.when(F.col("m").isNotNull(), ids), F.lit("")).alias("ids"))


def rendered(messages: DataFrame) -> DataFrame:
    """Digest of each conversation as text, a line for each message, read in order and never put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for own, role, content in zip(*(batch[c].to_pylist() for c in ("conversation_id", "role", "content")), strict=True):
                if digest is None or own != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}: {content}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conversation_id", "digest"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["conversation_id", "digest"])

    ordered = messages.select("conversation_id", "turn", "role", "content").repartition("conversation_id").sortWithinPartitions("conversation_id", "turn")
    return ordered.mapInArrow(run, "conversation_id long, digest string")


def relevant_topk(items: DataFrame, queries: DataFrame, k: int = TOP, block: int = indexes.BLOCK) -> DataFrame:
    """For each query (qid, text), the k items (id, text, updated, perhaps pinned) that share most of its words of three letters up."""
    return indexes.best_items(items, queries, k, block)


def echo_guard(messages: DataFrame) -> DataFrame:
    """Answers that equal an earlier answer of the conversation, trimmed and in lower case."""
    answers = messages.where("role = 'assistant'").withColumn("norm", F.sha2(F.lower(F.trim("content")), 256))
    return answers.select("id", F.row_number().over(W.partitionBy("conversation_id", "norm").orderBy("turn")).alias("k")).select("id", (F.col("k") > 1).alias("echo"))


def compaction(messages: DataFrame, chars: int = CONTEXT) -> DataFrame:
    """Exchanges, each begun by a user message; the newest that fit, and how many are left out."""
    order = W.partitionBy("conversation_id").orderBy("turn")
    groups = messages.withColumn("g", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order)).groupBy("conversation_id", "g").agg(F.sum(F.length("content")).alias("size"))
    newest = W.partitionBy("conversation_id").orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, 0)
    kept = groups.withColumn("used", F.sum("size").over(newest))
    return kept.groupBy("conversation_id").agg(F.count_if(F.col("used") <= chars).alias("kept"), F.count_if(F.col("used") > chars).alias("omitted"))


def _m(s, d):
    return view(s, d, "messages")


def _relevant(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.col("item_id").alias("updated"))
    return relevant_topk(items, table(s, d, "documents").select(F.col("doc_id").alias("qid"), "text"))


QUERIES = {
    "conv_list": lambda s, d: conv_list(_m(s, d)),
    "chat_search": lambda s, d: chat_search(_m(s, d), TERM),
    "complete_turns": lambda s, d: complete_turns(_m(s, d)).select("conversation_id", "user_id", "assistant_id", "chars"),
    "turn_search": lambda s, d: turn_search(_m(s, d), TERM),
    "prev_user_message": lambda s, d: prev_user_message(_m(s, d)),
    "context_budget": lambda s, d: context_budget(_m(s, d)),
    "memory_budget": lambda s, d: memory_budget(_m(s, d)),
    "relevant_topk": _relevant,
    "echo_guard": lambda s, d: echo_guard(_m(s, d)),
    "compaction": lambda s, d: compaction(_m(s, d)),
    "render_prompt": lambda s, d: rendered(_m(s, d)),
}

_TURNS = "SELECT conversation_id, user_id, id AS assistant_id, length(content) + length(user_content) AS chars FROM (SELECT *, lag(role) OVER w AS before, lag(id) OVER w AS user_id, lag(content) OVER w AS user_content FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'"
_BAG = "list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN\\pM_]{3,}'), lambda x: x <> ''))"
ORACLES = {
    "conv_list": with_views("SELECT conversation_id, count(*) AS n, max(turn) AS last_turn, arg_min(substr(content, 1, 40), turn) FILTER (WHERE role = 'user') AS title FROM messages GROUP BY conversation_id", "messages"),
    "chat_search": with_views(f"SELECT DISTINCT conversation_id FROM messages WHERE content ILIKE '%{TERM}%'", "messages"),
    "complete_turns": with_views(_TURNS, "messages"),
    "turn_search": with_views(f"SELECT DISTINCT conversation_id, user_id, assistant_id FROM ({_TURNS}) t JOIN (SELECT id FROM messages WHERE content ILIKE '%{TERM}%' ORDER BY id DESC LIMIT 5) h ON h.id = t.user_id OR h.id = t.assistant_id", "messages"),
    "prev_user_message": with_views("SELECT id, (SELECT max(u.id) FROM messages u WHERE u.conversation_id = m.conversation_id AND u.role = 'user' AND u.turn < m.turn) AS user_id FROM messages m WHERE role = 'assistant'", "messages"),
    "context_budget": with_views(f"SELECT conversation_id, user_id, used::BIGINT AS used FROM (SELECT *, sum(chars) OVER (PARTITION BY conversation_id ORDER BY user_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM ({_TURNS})) WHERE used <= {CONTEXT}", "messages"),
    "memory_budget": with_views(f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS i, length(content) AS size FROM messages),
f AS (SELECT DISTINCT conversation_id, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, ''::VARCHAR AS ids FROM messages
  UNION ALL SELECT f.conversation_id, r.i, CASE WHEN used + size <= {MEMORY} THEN used + size ELSE used END, CASE WHEN used + size <= {MEMORY} THEN n + 1 ELSE n END, CASE WHEN used + size > {MEMORY} THEN ids WHEN ids = '' THEN id::VARCHAR ELSE concat(ids, ',', id::VARCHAR) END
  FROM f JOIN r ON r.conversation_id = f.conversation_id AND r.i = f.i + 1)
SELECT conversation_id, used::INT AS used, n, ids FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY i DESC) AS k FROM f) WHERE k = 1""", "messages"),
    "relevant_topk": f"""
WITH q AS (SELECT doc_id AS qid, unnest({_BAG}) AS w FROM documents), i AS (SELECT item_id AS id, unnest({_BAG}) AS w FROM benchmark), s AS (SELECT qid, id, count(*) AS score FROM q JOIN i USING (w) GROUP BY qid, id)
SELECT qid, id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS place FROM s) WHERE place <= {TOP}""",
    "echo_guard": with_views("SELECT id, row_number() OVER (PARTITION BY conversation_id, lower(trim(content)) ORDER BY turn) > 1 AS echo FROM messages WHERE role = 'assistant'", "messages"),
    "compaction": with_views(f"""
WITH g AS (SELECT conversation_id, g, sum(length(content)) AS size FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conversation_id ORDER BY turn) AS g FROM messages) GROUP BY ALL),
u AS (SELECT *, sum(size) OVER (PARTITION BY conversation_id ORDER BY g DESC ROWS UNBOUNDED PRECEDING) AS used FROM g)
SELECT conversation_id, count(*) FILTER (WHERE used <= {CONTEXT}) AS kept, count(*) FILTER (WHERE used > {CONTEXT}) AS omitted FROM u GROUP BY conversation_id""", "messages"),
    "render_prompt": with_views("SELECT conversation_id, sha256(string_agg(concat(role, ': ', content), chr(10) ORDER BY turn)) AS digest FROM messages GROUP BY conversation_id", "messages"),
}
