"""Conversations as an append-only log of changes, turns saved whole, deadlines, throttled progress, prompts with history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.views import table, view, with_views
from .conversations import complete_turns
from .datasets import POINTING, is_followup

#: Characters of history that go before a question; least seconds between two saves of progress.
HISTORY, PAUSE = 8000, 0.3
ROLES = ("user", "assistant", "system")


def conversations_of(changes: DataFrame) -> DataFrame:
    """What a log of changes (ord, conversation_id, op, title, role, content) leaves: the conversations that live on.

    A conversation lives from its first creation to its deletion; changes outside of that, with a blank title
    or content, or of an unknown role are refused. updated is the last change that took effect. Deleting takes
    the messages along, so a deleted conversation leaves no row.
    """
    on = lambda op: F.when(F.col("op") == op, F.col("ord"))
    born = changes.groupBy("conversation_id").agg(F.min(on("create")).alias("born"))
    after = changes.join(born, "conversation_id").where(F.col("ord") >= F.col("born"))
    gone = after.groupBy("conversation_id").agg(F.min(on("delete")).alias("gone"))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    good = (F.col("op") == "settings") | (F.col("ord") == F.col("born")) | (F.col("op") == "rename") & filled("title") | (F.col("op") == "message") & filled("content") & F.col("role").isin(*ROLES)
    alive = after.where(good).join(gone.where("gone IS NULL"), "conversation_id")
    named = F.when((F.col("op") == "rename") | (F.col("ord") == F.col("born")), F.col("ord"))
    return alive.groupBy("conversation_id").agg(F.coalesce(F.max_by("title", named), F.lit("New Chat")).alias("title"), F.count_if(F.col("op") == "message").alias("messages"), F.max("ord").alias("updated"))


def atomic_turns(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Turns (turn_key) of existing conversations that have a user and an assistant message, the first of each: both or none, once."""
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("ord", "content")))
    pairs = messages.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_semi").groupBy("turn_key").agg(F.min("conversation_id").alias("conversation_id"), first("user").alias("u"), first("assistant").alias("a"))
    return pairs.where("u IS NOT NULL AND a IS NOT NULL").select("turn_key", "conversation_id", F.col("u.content").alias("user"), F.col("a.content").alias("assistant"))


def harvested(tasks: DataFrame, finished: DataFrame, deadline) -> DataFrame:
    """Every task with the first answer that was finished by the deadline, else a blank one, and whether it was abandoned."""
    done = finished.where(F.col("at") <= deadline).groupBy("task_id").agg(F.min_by("answer", F.struct("at", "answer")).alias("answer"))
    return tasks.select("task_id").join(done, "task_id", "left").select("task_id", F.coalesce("answer", F.lit("")).alias("answer"), F.col("answer").isNull().alias("abandoned"))


def throttled(progress: DataFrame, seconds: float = PAUSE) -> DataFrame:
    """run_id, at, ord of the updates that are saved: a run's first, and each over ``seconds`` after the one saved last.

    Rows are streamed in order through the task that has their run; none is gathered.
    """
    pause = int(seconds * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, 0)
        for batch in batches:
            keep = []
            for key, at in zip(batch["run_id"].to_pylist(), batch["us"].to_pylist(), strict=True):
                good = last[0] != key or at - last[1] > pause
                keep.append(good)
                if good:
                    last = key, at
            yield batch.filter(pa.array(keep, pa.bool_())).select(["run_id", "ord"])

    rows = progress.select("run_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "ord").repartition("run_id").sortWithinPartitions("run_id", "us", "ord")
    return rows.mapInArrow(run, "run_id long, ord long")


def contextual_prompts(turns: DataFrame, questions: DataFrame, chars: int = HISTORY) -> DataFrame:
    """conversation_id and prompt: the question alone, or, if it points back, after the newest turns that fit (one at least).

    ``turns`` has conversation_id, k (ascending), user and assistant; ``questions`` conversation_id and question.
    """
    line = F.concat(F.lit("user: "), "user", F.lit("\nassistant: "), "assistant")
    newest = W.partitionBy("conversation_id").orderBy(F.desc("k"))
    told = turns.select("conversation_id", "k", line.alias("line")).withColumns({"used": F.sum(F.length("line")).over(newest.rowsBetween(W.unboundedPreceding, 0)), "place": F.row_number().over(newest)})
    shown = told.where((F.col("used") <= chars) | (F.col("place") == 1)).groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda t: t["line"]), "\n").alias("history"))
    both = questions.join(shown, "conversation_id", "left")
    full = F.concat(F.lit("Previous conversation (context only):\n"), "history", F.lit("\n\nAnswer only this new question: "), "question")
    return both.select("conversation_id", F.when(is_followup(F.col("question")) & F.col("history").isNotNull(), full).otherwise(F.col("question")).alias("prompt"))


def _changes(s, d) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind == "signup", "create").when((kind == "error") & (k % 19 == 0), "delete").when(kind == "view", "message").when(kind == "click", "rename").otherwise("settings")
    return table(s, d, "events").select(k.alias("ord"), F.col("user_id").alias("conversation_id"), op.alias("op"), F.when(k % 7 != 0, F.concat(F.lit("t"), k.cast("string"))).alias("title"), F.when(k % 5 == 0, "tool").otherwise("user").alias("role"), F.when(k % 11 == 0, " ").otherwise("hello").alias("content"))


def _turn_rows(s, d) -> DataFrame:
    rows = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("turn_key"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ord"), "role", F.sha2("text", 256).alias("content"))
    return rows.unionByName(rows.withColumn("ord", F.col("ord") + 100))  # every message sent twice


def _contextual(s, d) -> DataFrame:
    messages = view(s, d, "messages")
    turns = complete_turns(messages).select("conversation_id", "user_id", "assistant_id")
    text = messages.select("id", "content")
    full = turns.join(text.select(F.col("id").alias("user_id"), F.col("content").alias("user")), "user_id").join(text.select(F.col("id").alias("assistant_id"), F.col("content").alias("assistant")), "assistant_id")
    questions = messages.where("role = 'user'").groupBy("conversation_id").agg(F.max_by("content", "turn").alias("question"), F.max("turn").alias("last"))
    before = full.join(questions, "conversation_id").where(F.col("user_id") < F.col("conversation_id") * 1000 + F.col("last"))
    return contextual_prompts(before.select("conversation_id", F.col("user_id").alias("k"), "user", "assistant"), questions.select("conversation_id", "question")).select("conversation_id", F.sha2("prompt", 256).alias("digest"))


def _harvest(s, d) -> DataFrame:
    tasks = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("task_id"))
    done = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("task_id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("answer"))
    return harvested(tasks, done, F.lit("1994-06-01").cast("timestamp"))


def _latest_states(s, d) -> DataFrame:
    k = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed"))), (F.col("user_id") % 3 + 1).cast("int"))
    return table(s, d, "events").select((k % 300).alias("run_id"), k.alias("ord"), state.alias("state"))


def queued(runs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Runs that a restart may pick up: queued, and queued as an occurrence."""
    return runs.where("state = 'queued'").join(occurrences.where("status = 'queued'"), "run_id").select("run_id", "job_id")


def _queued(s, d) -> DataFrame:
    last = _latest_states(s, d).groupBy("run_id").agg(F.max_by("state", "ord").alias("state"))
    k = F.col("event_id")
    occurrences = table(s, d, "events").select((k % 300).alias("run_id"), F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "view", "queued").otherwise("done").alias("status")).distinct()
    return queued(last, occurrences)


QUERIES = {
    "conv_crud": lambda s, d: conversations_of(_changes(s, d)),
    "atomic_turn": lambda s, d: atomic_turns(_turn_rows(s, d).where("NOT (turn_key % 5 = 0 AND role = 'assistant')"), table(s, d, "conversations").where("conv_id % 7 <> 0").select(F.col("conv_id").alias("conversation_id"))),
    "deadline_harvest": _harvest,
    "progress_throttle": lambda s, d: throttled(table(s, d, "events").select((F.col("user_id") % 50).alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("ord")), 43_200.0),
    "contextual_prompt": _contextual,
    "queued_recovery": _queued,
    "runs_list": lambda s, d: _latest_states(s, d).orderBy(F.desc("ord")).limit(100),
    "actions_list": lambda s, d: table(s, d, "events").select("event_id", F.substring(F.sha2((F.col("event_id") % 700).cast("string"), 256), 1, 12).alias("action_id"), "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "action_id"),
}

_BACK = POINTING
_OP = "CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' AND event_id % 19 = 0 THEN 'delete' WHEN event_type = 'view' THEN 'message' WHEN event_type = 'click' THEN 'rename' ELSE 'settings' END"
_STATE = "['queued', 'running', 'completed'][user_id % 3 + 1]"
ORACLES = {
    "conv_crud": f"""
WITH c AS (SELECT event_id AS ord, user_id AS id, {_OP} AS op FROM events), b AS (SELECT id, min(ord) AS born FROM c WHERE op = 'create' GROUP BY id),
g AS (SELECT DISTINCT c.id FROM c JOIN b ON c.id = b.id AND ord > born WHERE op = 'delete'),
l AS (SELECT c.*, born FROM c JOIN b ON c.id = b.id AND ord >= born WHERE c.id NOT IN (SELECT id FROM g) AND (op = 'settings' OR ord = born OR (op = 'rename' AND ord % 7 <> 0) OR (op = 'message' AND ord % 11 <> 0 AND ord % 5 <> 0)))
SELECT id AS conversation_id, coalesce(arg_max(CASE WHEN ord % 7 <> 0 THEN concat('t', ord) END, ord) FILTER (WHERE (op = 'rename' OR ord = born) AND ord % 7 <> 0), 'New Chat') AS title, count(*) FILTER (WHERE op = 'message') AS messages, max(ord) AS updated FROM l GROUP BY id""",
    "atomic_turn": """
WITH m AS (SELECT conv_id * 1000 + turn // 2 AS turn_key, conv_id, turn, role, sha256(text) AS content FROM conversations WHERE conv_id % 7 <> 0)
SELECT turn_key, any_value(conv_id) AS conversation_id, arg_min(content, turn) FILTER (WHERE role = 'user') AS user, arg_min(content, turn) FILTER (WHERE role = 'assistant') AS assistant
FROM m WHERE turn_key % 5 <> 0 GROUP BY turn_key HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0""",
    "deadline_harvest": """
SELECT c_custkey::VARCHAR AS task_id, coalesce(a, '') AS answer, a IS NULL AS abandoned
FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority AS a FROM orders WHERE o_orderdate <= TIMESTAMP '1994-06-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority) = 1) ON o_custkey = c_custkey""",
    "progress_throttle": """
WITH RECURSIVE e AS (SELECT user_id % 50 AS run_id, ts, event_id AS ord FROM events),
f AS (SELECT run_id, min(ts) AS ts FROM e GROUP BY run_id UNION ALL SELECT f.run_id, (SELECT min(e.ts) FROM e WHERE e.run_id = f.run_id AND e.ts > f.ts + INTERVAL 43200 SECOND) FROM f WHERE f.ts IS NOT NULL)
SELECT f.run_id, min(e.ord) AS ord FROM f JOIN e ON e.run_id = f.run_id AND e.ts = f.ts GROUP BY f.run_id, f.ts""",
    "contextual_prompt": with_views(f"""
WITH q AS (SELECT conversation_id, arg_max(content, turn) AS question, max(turn) AS last FROM messages WHERE role = 'user' GROUP BY conversation_id),
p AS (SELECT *, lag(role) OVER w AS r, lag(content) OVER w AS asked, lag(turn) OVER w AS t FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY turn)),
l AS (SELECT p.conversation_id, t, concat('user: ', asked, chr(10), 'assistant: ', content) AS line FROM p JOIN q USING (conversation_id) WHERE role = 'assistant' AND r = 'user' AND t < last),
u AS (SELECT *, sum(length(line)) OVER w AS used, row_number() OVER w AS place FROM l WINDOW w AS (PARTITION BY conversation_id ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
h AS (SELECT conversation_id, string_agg(line, chr(10) ORDER BY t) AS history FROM u WHERE used <= {HISTORY} OR place = 1 GROUP BY conversation_id)
SELECT q.conversation_id, sha256(CASE WHEN history IS NOT NULL AND len(list_intersect(regexp_split_to_array(lower(question), '[^\\pL\\pN\\pM_]+'), string_split('{_BACK}', ' '))) > 0
  THEN concat('Previous conversation (context only):', chr(10), history, chr(10), chr(10), 'Answer only this new question: ', question) ELSE question END) AS digest FROM q LEFT JOIN h USING (conversation_id)""", "messages"),
    "queued_recovery": f"""
WITH r AS (SELECT event_id % 300 AS run_id, arg_max({_STATE}, event_id) AS state FROM events GROUP BY 1)
SELECT DISTINCT run_id, user_id AS job_id FROM events JOIN r ON r.run_id = event_id % 300 WHERE state = 'queued' AND event_type = 'view'""",
    "runs_list": f"SELECT event_id % 300 AS run_id, event_id AS ord, {_STATE} AS state FROM events ORDER BY event_id DESC LIMIT 100",
    "actions_list": "SELECT event_id, substr(sha256((event_id % 700)::VARCHAR), 1, 12) AS action_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
}
