"""Building and merging outcome datasets; small text rules of routing and chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashrng import uniform, uniform_sql
from ..sources import files
from ..sources.views import table, view, with_views
from .running import quantiles
from .text import COMPLEX_SQL, LENGTH_SQL
from .usage import CHEAP_IN, CHEAP_OUT, STRONG_IN, STRONG_OUT

DOLLARS_A_SECOND, QUALITY = 0.0001, 0.6
ALLOWED = ("maker/BRAND#13", "maker/brand#5 ", "other/Brand#21")
#: What the metas of datasets must agree on to be merged.
COMPATIBLE = ("local_model", "remote_model", "quality_threshold", "tier_mode", "system_prompt_sha256", "temperature", "cheap_max_tokens")


def collect_cost(rows: DataFrame) -> DataFrame:
    """Graded rows with their costs and label: tokens of a billed provider, else seconds; ungraded (negative) rows go."""
    graded = rows.where("local_quality >= 0 AND remote_quality >= 0")
    tokens = (F.col("local_prompt_tokens") * F.lit(CHEAP_IN) + F.col("local_completion_tokens") * F.lit(CHEAP_OUT)) / F.lit(1e6)
    cheap = F.when(F.col("cheap_provider") == "fireworks", tokens).otherwise(F.col("local_latency_s") * F.lit(DOLLARS_A_SECOND))
    strong = (F.col("remote_prompt_tokens") * F.lit(STRONG_IN) + F.col("remote_completion_tokens") * F.lit(STRONG_OUT)) / F.lit(1e6)
    return graded.select("task_id", F.round(cheap, 9).alias("local_cost"), F.round(strong, 9).alias("remote_cost"), (F.col("local_quality") >= QUALITY).alias("local_ok"))


def join_grades(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Qualities, replaced by a verdict's (cheap, strong; older names local, remote) where there is one."""
    both = rows.join(verdicts, "task_id", "left")
    return both.select("task_id", F.coalesce("cheap", "local", "local_quality").alias("cheap_quality"), F.coalesce("strong", "remote", "remote_quality").alias("strong_quality"))


def merge_outcomes(parts: list[DataFrame]) -> DataFrame:
    """Bag union of datasets, each told by its number."""
    out = None
    for i, part in enumerate(parts):
        own = part.withColumn("origin", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def merge_compat(metas: DataFrame, keys: tuple[str, ...] = COMPATIBLE) -> DataFrame:
    """Keys on which the metas differ; none if the datasets may be merged."""
    counts = metas.agg(*[F.count_distinct(F.coalesce(F.col(k).cast("string"), F.lit("\0"))).alias(k) for k in keys])
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("values")) for k in keys])
    return counts.select(F.inline(each)).where("values > 1")


def model_key(model: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(model, "/"), -1)))


def model_allowlist(models: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Each model with the allowed one of its key, null where it isn't allowed; never another model."""
    names = models.sparkSession.createDataFrame([(a,) for a in allowed], "resolved string")
    return models.join(names.withColumn("k", model_key(F.col("resolved"))), model_key(F.col("model")) == F.col("k"), "left").select("model", "resolved")


def route_intent(reply: Column) -> Column:
    """The route in a reply: a JSON or Python dict, perhaps in a code fence; null where it names none."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```[^\n]*\n(.*)\n```$", "$1")
    found = F.regexp_extract(bare, r"""(?s)^\s*\{.*["']route["']\s*:\s*["'](local|strong)["'].*\}\s*$""", 1)
    return F.when(found != "", found)


def recent_turns(messages: DataFrame, turns: int = 3, chars: int = 2000) -> DataFrame:
    """conversation_id, window: the last user and assistant messages that a router is shown.

    The newest come first into the budget; the one that exceeds it keeps its end.
    """
    newest = W.partitionBy("conversation_id").orderBy(F.desc("turn"))
    last = messages.where("role IN ('user', 'assistant')").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= turns)
    before = newest.rowsBetween(W.unboundedPreceding, -1)
    room = last.withColumn("room", F.lit(chars) - F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))).where("room > 0")
    shown = F.expr("right(content, least(length(content), room))")
    return room.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", shown.alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("window"))


def routed(replies: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The route of each row (prompt, reply): the reply's, or where it names none the heuristic's."""
    own = route_intent(F.col("reply"))
    fallback = F.when(T.heuristic_score(F.col("prompt")) >= threshold, "local").otherwise("strong")
    return replies.withColumns({"route": F.coalesce(own, fallback), "kind": F.when(own.isNull(), "heuristic-fallback").otherwise("reply")})


#: The formats an answer can be asked in, in the order in which they are looked for, and the rules' patterns.
FORMATS = ("docx", "html", "csv", "json", "md", "txt")
_EXT = "docx|html|txt|md|csv|json"
_REFUSED = r"\b(no|without|don't|do not)\s+(a\s+)?(file|download)s?\b"
_ASKS = r"\b(write|wrike|make|create|generate|build|export|download|save|convert|give|provide)\b"
_AS = rf"\b(as|in|to)\s+(a\s+)?(\.?({_EXT})|word (document|file))\b"
_QUESTION = r"^\s*(what\b|why\b|explain\b|how (do|does|can|to)\b)"
_MOVES = r"\b(export|download|save|convert)\b"
_ABOUT = rf"\b(what|why|how)\b.*\b({_EXT})\b"
_NAMED = (r"\b(save|export|download|create|generate|build|make|named?|called)\b[^\n]{0,60}\b[\w-]+\.", r"\b(as|in|to)\s+[\w-]+\.")


def requested_format(prompt: Column) -> Column:
    """The file format that a prompt asks an answer in, or null."""
    low = F.lower(prompt)
    has = low.rlike
    silent = has(_REFUSED) | (has(_QUESTION) & ~has(_MOVES)) | ~(has(_ASKS) | has(_AS)) | (has(_ABOUT) & ~has(_ASKS))
    kind = F.coalesce(*[F.when(has(rf"(?<![\w.])\.?{ext}\b") | has(_NAMED[0] + rf"{ext}\b") | has(_NAMED[1] + rf"{ext}\b"), F.lit(ext)) for ext in FORMATS], F.when(has(r"\bword (document|file)\b"), F.lit("docx")))
    return F.when(~silent, kind)


#: Words that point back.
POINTING = "he she they him her them it its his hers their that this those these my mine me i we our us you your again earlier before previous last same above also too"


def is_followup(prompt: Column) -> Column:
    """A pronoun or another word that points back."""
    return prompt.rlike(rf"(?iU)\b({'|'.join(POINTING.split())})\b")


def safe_basename(name: Column, default: str = "output") -> Column:
    """A file stem of letters, digits, dashes and underscores."""
    stem = F.substring(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_-]", "-"), r"^-+|-+$", ""), 1, 70)
    return F.when(stem == "", default).otherwise(stem)


#: Shape of the packets of a search reply.
_PACKET = "id INT, error STRING, result STRUCT<isError: BOOLEAN, content: ARRAY<STRUCT<type: STRING, text: STRING>>>"


def reply_text(body: Column) -> Column:
    """The text in a search reply, which is JSON or lines of an event stream that hold JSON: that of its first packet of id 1;
    null for a reply without one, or one that tells of an error.
    """
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: x.startswith("data: ")), lambda x: F.substr(x, F.lit(7)))
    packets = F.transform(F.when(F.ltrim(body).startswith("{"), F.array(body)).otherwise(lines), lambda x: F.from_json(x, _PACKET))
    own = F.filter(packets, lambda p: p["id"] == 1)

    def told(found: Column) -> Column:
        p = F.try_element_at(found, F.lit(1))
        texts = F.transform(F.filter(p["result"]["content"], lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit("")))
        good = p.isNotNull() & p["error"].isNull() & ~F.coalesce(p["result"]["isError"], F.lit(False))
        return F.when(good, F.coalesce(F.array_join(texts, "\n"), F.lit("")))

    return T.let(own, told)


def search_blocks(text: Column, n: int = 3) -> Column:
    """title, url and snippet of the first n results in a search reply's text that have a public link."""
    blocks = F.split(F.concat(F.lit("\n"), text), r"\nTitle: ")
    made = F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), lambda b: F.struct(
        F.substring(F.regexp_extract(b, r"^([^\n]*)", 1), 1, 300).alias("title"), F.regexp_extract(b, r"(?m)^URL: (https?://\S+)\s*$", 1).alias("url"),
        F.substring(F.regexp_replace(b, r"(?s)^.*?\n(?:Highlights|Text|Content):\s*", ""), 1, 2000).alias("snippet")))
    return F.slice(F.filter(made, lambda r: T.public_link(r["url"])), 1, n)


def toy_outcomes(ids: DataFrame, seed: int = 7) -> DataFrame:
    """A seeded record for each id: eight categories in groups of two paraphrases, hard ones mostly failed by the cheap model."""
    rows = ids.select("id").withColumn("g", F.floor(F.col("id") / 2))
    u = lambda name: uniform(seed, F.lit(name), F.col("id"))
    category = F.floor(uniform(seed, F.lit("category"), F.col("g")) * 8)
    quality = F.when(category < 4, 0.5 + u("q") / 2).otherwise(u("q") * 0.7)
    return rows.select(F.concat(F.lit("toy-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("task_id"), F.concat(F.lit("g-"), F.col("g").cast("string")).alias("group_id"), category.cast("int").alias("category"), F.round(quality, 4).alias("local_quality"), F.round(0.75 + u("r") / 4, 4).alias("remote_quality"), (F.round(quality, 4) >= QUALITY).alias("local_ok"))


def profile(trials: DataFrame) -> DataFrame:
    """Trials, successes, median and greatest value of each model."""
    sums = trials.groupBy("model").agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("value") > 10).alias("successes"), F.round(F.max("value"), 6).alias("most"))
    return sums.join(quantiles(trials, "model", "value", median=("linear", 0.5)).withColumn("median", F.round("median", 6)), "model", "left")


def _out(s, d):
    return view(s, d, "outcomes")


def _collected(s, d):
    o = _out(s, d)
    return collect_cost(o.withColumn("cheap_provider", F.when(F.col("ord") % 3 == 0, "fireworks").otherwise("local")).withColumn("local_quality", F.when(F.col("ord") % 10 == 4, -1.0).otherwise(F.col("local_quality"))))


def _verdicts(s, d):
    k = F.col("event_id")
    number = lambda on: F.when(on, (k % 7).cast("double") / F.lit(7.0))
    v = table(s, d, "events").select(k.cast("string").alias("task_id"), number(k % 3 != 0).alias("cheap"), number(k % 3 == 0).alias("local"), number(k % 2 != 0).alias("strong"), number(k % 2 == 0).alias("remote"))
    return join_grades(_out(s, d), v).select("task_id", F.round("cheap_quality", 6).alias("cheap_quality"), F.round("strong_quality", 6).alias("strong_quality"))


def _models(s, d):
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "shop/").when(F.col("p_size") % 3 == 1, "a/b/").otherwise(""), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" "))))
    models = table(s, d, "part").select("p_partkey", name.alias("model"))
    return models.join(model_allowlist(models.select("model").distinct(), ALLOWED), "model")


def _replies(s, d):
    """A router's reply to each conversation: of six kinds, whole texts in some."""
    k, text, route = F.col("conv_id") % 6, F.col("text"), F.when(F.col("conv_id") % 4 < 2, "local").otherwise("strong")
    quoted = lambda q: F.concat(F.lit(f"{{{q}route{q}: {q}"), route, F.lit(f"{q}}}"))
    fenced = F.concat(F.lit("```json\n"), quoted('"'), F.lit("\n```"))
    reply = F.when(k == 0, quoted('"')).when(k == 1, quoted("'")).when(k == 2, fenced).when(k == 3, F.concat(F.lit(" "), quoted('"'), F.lit(" "))).when(k == 4, F.lit('{"route": "other"}')).otherwise(text)
    return table(s, d, "conversations").where("turn = 0").select("conv_id", F.concat(F.when(F.col("conv_id") % 5 == 0, "Calculate 12 * 9 and explain why. ").otherwise(""), text).alias("prompt"), reply.alias("reply"))


def _intents(s, d):
    shown = recent_turns(view(s, d, "messages")).select(F.col("conversation_id").alias("conv_id"), F.size("window").alias("turns"), F.aggregate("window", F.lit(0), lambda n, m: n + F.length(m["content"])).alias("chars"))
    return routed(_replies(s, d)).select("conv_id", "route", "kind").join(shown, "conv_id", "left")


#: How a request for a format may begin; the texts of the conversations follow.
OPENINGS = (
    "Write a report as a docx: ", "what is csv? ", "Export the table to csv please. ", "Create a word document. ", "make it in json ", "write a poem without a file ", "",
    "Why is html so slow? ", "Save it to notes.md now. ", "give me report.v2.txt or so ", "How do I download a json? ", "provide an html and a csv ",
)


def _opened(s, d):
    begin = F.element_at(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(begin, "text").alias("prompt"))


def _searched(s, d):
    """Search replies made of pages, as JSON and as event lines: a good result, one of another protocol, one with its text, one
    without a link; some replies tell of an error, some hold another packet before.
    """
    k = F.col("page_id")
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<[^>]*>", " "), r"\s+", " ")
    first = F.concat(F.lit("intro\nTitle: Page "), k.cast("string"), F.lit("\nURL: "), F.col("url"), F.lit("\nHighlights: "), plain)
    rest = F.concat(F.lit("Title: Two\nURL: ftp://x\nText: no\nTitle: Three\nURL: http://d.e/"), k.cast("string"), F.lit("\nText: end\nof it\nTitle: Four\nContent: none"))
    piece = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"))
    content = F.when(k % 3 > 0, F.array(piece(first), piece(rest))).otherwise(F.array(piece(first), F.struct(F.lit("image").alias("type"), F.lit("Title: no").alias("text"))))
    packet = F.to_json(F.struct(F.lit(1).alias("id"), F.when(k % 11 == 5, "refused").alias("error"), F.struct((k % 13 == 7).alias("isError"), content.alias("content")).alias("result")))
    body = F.when(k % 2 == 0, packet).otherwise(F.concat(F.lit('event: message\ndata: {"id": 2, "result": null}\n\ndata: '), packet, F.lit("\n\n")))
    return table(s, d, "pages").select("page_id", F.when(k % 17 == 4, "data: {}").otherwise(body).alias("body"))


def _fenced(s, d):
    """Code in the answers of conversations, each made to hold three fenced blocks, one of them blank."""
    shown = F.concat(F.lit("See:\n```Python title\n"), "text", F.lit("\n```\n~~~\n \n~~~\n````\n```\n"), "role", F.lit("\n````\nend"))
    rows = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(T.fenced_blocks(shown)).alias("place", "b"))
    return rows.select("conv_id", "turn", "place", "b.language", "b.extension", F.sha2("b.code", 256).alias("digest"))


def _worked(s, d):
    k, n = F.col("item_id"), F.format_string("%,d", F.col("item_id") * 137)
    tail = F.when(k % 4 == 0, F.concat(F.lit("\n#### "), n)).when(k % 4 == 1, F.concat(F.lit("\n#### first\n####  "), n, F.lit(".5 "))).when(k % 4 == 2, F.lit("\n#### many")).otherwise("")
    return table(s, d, "benchmark").select("item_id", F.concat("text", tail).alias("answer"))


def _targets(s, d):
    k = F.col("item_id")
    target = F.when(k % 4 == 0, F.concat(F.lit(" ("), F.substring(F.lit("ABCDEF"), (k % 6 + 1).cast("int"), F.lit(1)), F.lit(")"))).when(k % 4 == 1, F.lit("(AB)")).otherwise(F.concat(F.lit(" "), "text"))
    return table(s, d, "benchmark").select("item_id", target.alias("target"))


def _metas(s, d):
    """A meta for each nation, as datasets collected with settings of their own would have."""
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(
        "n_nationkey", F.concat(F.lit("m-"), (F.col("n_regionkey") % 2).cast("string")).alias("local_model"), F.lit("big").alias("remote_model"), F.lit(0.6).alias("quality_threshold"), F.when(k != 7, F.lit("remote_pair")).alias("tier_mode"),
        F.sha2(F.col("n_regionkey").cast("string"), 256).alias("system_prompt_sha256"), F.lit(0.0).alias("temperature"), (256 + F.col("n_regionkey") * 0).alias("cheap_max_tokens"),
    )


def gsm8k_reference(answer: Column) -> Column:
    """The number after the last ####, or null."""
    number = F.replace(F.trim(F.regexp_extract(answer, r"####\s*([^\n]+)\s*$", 1)), F.lit(","), F.lit(""))
    return F.when(number.try_cast("double").isNotNull(), number)


def _shown_blocks(body: Column) -> Column:
    one = lambda r: F.concat_ws("|", r["title"], r["url"], F.replace(r["snippet"], F.lit("\n"), F.lit(" ")))
    return F.array_join(F.transform(search_blocks(reply_text(body)), one), ";")


def _mmlu(s, d) -> DataFrame:
    rows = table(s, d, "benchmark").select("item_id", files.mmlu_prompt("world_history", F.col("text"), [F.lit(" one"), F.lit("two "), F.lit("three"), F.lit("four")]).alias("prompt"))
    return rows.select("item_id", F.sha2("prompt", 256).alias("digest"))


def receipts(steps: DataFrame, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The chosen keys of each step's JSON payload, as one JSON text; absent keys are left out."""
    parts = F.create_map(*[x for k in keys for x in (F.lit(k), F.get_json_object("payload", f"$.{k}"))])
    return steps.select("id", F.to_json(F.map_filter(parts, lambda _, v: v.isNotNull())).alias("receipt"))


def scope_filter(items: DataFrame, scope: str) -> DataFrame:
    """Items of a user's own scope (the default) or of the given one."""
    return items.where(F.coalesce(F.get_json_object("meta", "$.scope"), F.lit("user")).isin("user", scope))


def _scoped(s, d) -> DataFrame:
    k = F.col("event_id")
    meta = F.when(k % 4 == 0, F.lit('{"scope": "team"}')).when(k % 4 == 1, F.lit('{"scope": "user"}')).when(k % 4 == 2, F.lit('{"scope": "other"}')).otherwise(F.lit("{}"))
    return scope_filter(table(s, d, "events").select("event_id", meta.alias("meta")), "team").select("event_id")


QUERIES = {
    "collect_cost": _collected,
    "join_grades": _verdicts,
    "merge_outcomes": lambda s, d: merge_outcomes([_out(s, d).where("category = 'en'"), _out(s, d).where("category <> 'en'")]).groupBy("origin", "category").agg(F.count(F.lit(1)).alias("n")),
    "merge_compat": lambda s, d: merge_compat(_metas(s, d)),
    "model_allowlist": _models,
    "anti_missing_split": lambda s, d: _out(s, d).join(_out(s, d).where("ord % 9 <> 0").select("task_id"), "task_id", "left_anti").select("task_id"),
    "anti_done_tasks": lambda s, d: _out(s, d).join(view(s, d, "grades").select("task_id"), "task_id", "left_anti").select("task_id", "category"),
    "resume_collect": lambda s, d: files.latest_by(view(s, d, "usage_log").select((F.col("ord") % 500).alias("k"), "ord", "route"), "k", "ord"),
    "split_filter": lambda s, d: _out(s, d).join(table(s, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("task_id")), "task_id").select("task_id", "category"),
    "sink_results": lambda s, d: files.results(_out(s, d), view(s, d, "grades").select("task_id", F.col("grade").cast("string").alias("answer"))).select("task_id", "answer"),
    "route_intent": _intents,
    "requested_format": lambda s, d: _opened(s, d).select("conv_id", "turn", requested_format(F.col("prompt")).alias("format")),
    "is_followup": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", is_followup(F.col("text")).alias("followup")),
    "parse_search_blocks": lambda s, d: _searched(s, d).select("page_id", _shown_blocks(F.col("body")).alias("found")),
    "bbh_reference": lambda s, d: _targets(s, d).select("item_id", files.bbh_reference(F.col("target")).alias("reference")),
    "gsm8k_reference": lambda s, d: _worked(s, d).select("item_id", gsm8k_reference(F.col("answer")).alias("reference")),
    "mmlu_prompt": _mmlu,
    "receipts": lambda s, d: receipts(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("payload")), ("k", "absent")),
    "scope_filter": _scoped,
    "safe_basename": lambda s, d: table(s, d, "pages").select("page_id", safe_basename(F.col("url")).alias("name")),
    "gen_toy_outcomes": lambda s, d: toy_outcomes(table(s, d, "documents").select(F.col("doc_id").alias("id"))),
    "fenced_blocks": _fenced,
    "ordered_distinct": lambda s, d: view(s, d, "messages").groupBy("conversation_id").agg(F.concat_ws(",", F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda m: m["role"]))).alias("roles")),
    "profile_stats": lambda s, d: profile(table(s, d, "events").select(F.col("event_type").alias("model"), "value")),
    "ext_star_revenue": lambda s, d: _star(s, d),
}


def _star(s, d) -> DataFrame:
    """Revenue of each nation and year: joins on keys, aggregated."""
    lines = table(s, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = table(s, d, "customer").select("c_custkey", "c_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    names = table(s, d, "nation").select("n_nationkey", "n_name")
    return rows.join(names, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "year").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


def _format_sql() -> str:
    """Independent of the columns: plain letters first, each rule a column, formats by a list of tests."""
    openings = ", ".join("'" + o.replace("'", "''") + "'" for o in OPENINGS)
    tests = " ".join(f"WHEN regexp_matches(p, '(^|[^a-z0-9_.])[.]?{e}\\b') OR regexp_matches(p, '\\b(save|export|download|create|generate|build|make|named?|called)\\b[^\\n]{{0,60}}\\b[a-z0-9_-]+[.]{e}\\b') OR regexp_matches(p, '\\b(as|in|to)\\s+[a-z0-9_-]+[.]{e}\\b') THEN '{e}'" for e in ("docx", "html", "csv", "json", "md", "txt"))
    return f"""
WITH o AS (SELECT conv_id, turn, regexp_replace(lower(concat([{openings}][(conv_id + turn) % {len(OPENINGS)} + 1], text)), '[^\\x00-\\x7F]', 'x', 'g') AS p FROM conversations),
r AS (SELECT *, regexp_matches(p, '\\b(write|wrike|make|create|generate|build|export|download|save|convert|give|provide)\\b') AS asks,
  regexp_matches(p, '\\b(as|in|to)\\s+(a\\s+)?([.]?(docx|html|txt|md|csv|json)|word (document|file))\\b') AS told, regexp_matches(p, '\\b(no|without|don''t|do not)\\s+(a\\s+)?(file|download)s?\\b') AS refused,
  regexp_matches(p, '^\\s*(what\\b|why\\b|explain\\b|how (do|does|can|to)\\b)') AND NOT regexp_matches(p, '\\b(export|download|save|convert)\\b') AS question, regexp_matches(p, '\\b(what|why|how)\\b.*\\b(docx|html|txt|md|csv|json)\\b') AS about FROM o)
SELECT conv_id, turn, CASE WHEN refused OR question OR NOT (asks OR told) OR (about AND NOT asks) THEN NULL {tests} WHEN regexp_matches(p, '\\bword (document|file)\\b') THEN 'docx' END AS format FROM r"""


_TOY = lambda name, key="id": uniform_sql("'7'", f"'{name}'", f"{key}::VARCHAR")
ORACLES = {
    "collect_cost": with_views(f"""
SELECT task_id, round(CASE WHEN ord % 3 = 0 THEN (local_prompt_tokens * {CHEAP_IN}::DOUBLE + local_completion_tokens * {CHEAP_OUT}::DOUBLE) / 1e6::DOUBLE ELSE local_latency_s * {DOLLARS_A_SECOND}::DOUBLE END, 9) AS local_cost,
  round((remote_prompt_tokens * {STRONG_IN}::DOUBLE + remote_completion_tokens * {STRONG_OUT}::DOUBLE) / 1e6::DOUBLE, 9) AS remote_cost, local_quality >= 0.6::DOUBLE AS local_ok FROM outcomes WHERE ord % 10 <> 4""", "outcomes"),
    "join_grades": with_views("""
SELECT o.task_id, round(coalesce((e.event_id % 7)::DOUBLE / 7.0::DOUBLE, o.local_quality), 6) AS cheap_quality, round(coalesce((e.event_id % 7)::DOUBLE / 7.0::DOUBLE, o.remote_quality), 6) AS strong_quality
FROM outcomes o LEFT JOIN events e ON e.event_id::VARCHAR = o.task_id""", "outcomes"),
    "merge_outcomes": with_views("SELECT (category <> 'en')::INT AS origin, category, count(*) AS n FROM outcomes GROUP BY ALL", "outcomes"),
    "merge_compat": "SELECT * FROM (SELECT 'local_model' AS key, count(DISTINCT n_regionkey % 2) AS values FROM nation UNION ALL SELECT 'tier_mode', count(DISTINCT n_nationkey <> 7) FROM nation UNION ALL SELECT 'system_prompt_sha256', count(DISTINCT n_regionkey) FROM nation) WHERE values > 1",
    "model_allowlist": """
SELECT p_partkey, model, CASE lower(trim(string_split(model, '/')[-1])) WHEN 'brand#13' THEN 'maker/BRAND#13' WHEN 'brand#5' THEN 'maker/brand#5 ' WHEN 'brand#21' THEN 'other/Brand#21' END AS resolved
FROM (SELECT p_partkey, concat(CASE p_size % 3 WHEN 0 THEN 'shop/' WHEN 1 THEN 'a/b/' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE concat(' ', p_brand, ' ') END) AS model FROM part)""",
    "anti_missing_split": with_views("SELECT task_id FROM outcomes WHERE ord % 9 = 0", "outcomes"),
    "anti_done_tasks": with_views("SELECT task_id, category FROM outcomes WHERE task_id NOT IN (SELECT task_id FROM grades)", "outcomes", "grades"),
    "resume_collect": with_views("SELECT k, ord, route FROM (SELECT ord % 500 AS k, ord, route, row_number() OVER (PARTITION BY ord % 500 ORDER BY ord DESC) AS i FROM usage_log) WHERE i = 1", "usage_log"),
    "split_filter": with_views("SELECT task_id, category FROM outcomes WHERE label_quality = 1", "outcomes"),
    "sink_results": with_views("SELECT o.task_id, coalesce(CASE WHEN g.grade = 1 THEN '1.0' WHEN g.grade = 0 THEN '0.0' END, '') AS answer FROM outcomes o LEFT JOIN grades g USING (task_id)", "outcomes", "grades"),
    "route_intent": f"""
WITH t AS (SELECT conv_id, conv_id % 6 AS k, concat(CASE WHEN conv_id % 5 = 0 THEN 'Calculate 12 * 9 and explain why. ' ELSE '' END, text) AS prompt FROM conversations WHERE turn = 0),
r AS (SELECT conv_id, CASE WHEN k < 4 THEN CASE WHEN conv_id % 4 < 2 THEN 'local' ELSE 'strong' END END AS own, CASE WHEN round(round({LENGTH_SQL}, 3) * 0.4::DOUBLE + round({COMPLEX_SQL}, 3) * 0.6::DOUBLE, 3) >= 0.5 THEN 'local' ELSE 'strong' END AS other FROM t),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, length(text) AS n FROM conversations WHERE role IN ('user', 'assistant')),
w AS (SELECT conv_id, 2000 - coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, n FROM m WHERE k <= 3),
c AS (SELECT conv_id, count(*)::INT AS turns, sum(least(n, room))::INT AS chars FROM w WHERE room > 0 GROUP BY conv_id)
SELECT conv_id, coalesce(own, other) AS route, CASE WHEN own IS NULL THEN 'heuristic-fallback' ELSE 'reply' END AS kind, turns, chars FROM r LEFT JOIN c USING (conv_id)""",
    "requested_format": _format_sql(),
    "is_followup": "SELECT conv_id, turn, len(list_intersect(regexp_split_to_array(lower(text), '[^\\pL\\pN\\pM_]+'), string_split('" + POINTING + "', ' '))) > 0 AS followup FROM conversations",
    "parse_search_blocks": """
WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g') AS plain, length(url) <= 2048 AND regexp_matches(url, '^https?://[^/?#@\\s]+([/?#]\\S*)?$') AS ok FROM pages)
SELECT page_id, CASE WHEN page_id % 17 <> 4 AND page_id % 11 <> 5 AND page_id % 13 <> 7 THEN concat(CASE WHEN ok THEN concat('Page ', page_id, '|', url, '|', substr(ltrim(plain), 1, 2000)) ELSE '' END,
  CASE WHEN page_id % 3 > 0 THEN concat(CASE WHEN ok THEN ';' ELSE '' END, 'Three|http://d.e/', page_id, '|end of it') ELSE '' END) END AS found FROM p""",
    "fenced_blocks": """
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1)::INT AS place, language, extension, sha256(code) AS digest FROM (
  SELECT conv_id, turn, 1 AS k, 'python' AS language, 'py' AS extension, concat(text, chr(10)) AS code FROM conversations WHERE regexp_matches(text, '\\S')
  UNION ALL SELECT conv_id, turn, 2, 'text', 'txt', concat('```', chr(10), role, chr(10)) FROM conversations)""",
    "bbh_reference": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN substr('ABCDEF', item_id % 6 + 1, 1) WHEN 1 THEN '(AB)' ELSE trim(text) END AS reference FROM benchmark",
    "gsm8k_reference": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN (item_id * 137)::VARCHAR WHEN 1 THEN concat((item_id * 137)::VARCHAR, '.5') END AS reference FROM benchmark",
    "mmlu_prompt": "SELECT item_id, sha256(concat('Answer this world history multiple-choice question. Reply with exactly one option letter: A, B, C, or D.', chr(10), chr(10), trim(text), chr(10), 'Options:', chr(10), '(A) one', chr(10), '(B) two', chr(10), '(C) three', chr(10), '(D) four')) AS digest FROM benchmark",
    "receipts": """SELECT event_id AS id, concat('{"k":"', json_extract_string(props, '$.k'), '"}') AS receipt FROM events""",
    "scope_filter": "SELECT event_id FROM events WHERE event_id % 4 <> 2",
    "safe_basename": "SELECT page_id, CASE WHEN n = '' THEN 'output' ELSE n END AS name FROM (SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70) AS n FROM pages)",
    "gen_toy_outcomes": f"""
SELECT concat('toy-', lpad(id::VARCHAR, 6, '0')) AS task_id, concat('g-', (id // 2)::VARCHAR) AS group_id, c::INT AS category, q AS local_quality, round(0.75::DOUBLE + {_TOY('r')} / 4, 4) AS remote_quality, q >= 0.6::DOUBLE AS local_ok
FROM (SELECT id, c, round(CASE WHEN c < 4 THEN 0.5::DOUBLE + {_TOY('q')} / 2 ELSE {_TOY('q')} * 0.7::DOUBLE END, 4) AS q FROM (SELECT id, floor({_TOY('category', '(id // 2)')} * 8) AS c FROM (SELECT doc_id AS id FROM documents)))""",
    "ordered_distinct": with_views("SELECT conversation_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conversation_id, role, min(turn) AS t FROM messages GROUP BY ALL) GROUP BY conversation_id", "messages"),
    "profile_stats": "SELECT event_type AS model, count(*) AS trials, count(*) FILTER (WHERE value > 10) AS successes, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS most FROM events GROUP BY event_type",
    "ext_star_revenue": "SELECT n_name, year(o_orderdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
}
