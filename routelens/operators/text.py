"""Queries of the text expressions over prompts, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.views import table, view, with_views
from . import indexes

#: Prompts that exercise the signals, which the given prose hardly does.
PROMPTS = (
    "What is the capital of France?", "Calculate 12 * 9 and explain why.", "Write a python function to sort a list.", "Fix this bug: the code has an error",
    "If all knights and knaves lie, who is lying?", "Summarize the text in one sentence.", "Classify this review: positive or negative", "Extract all the names and dates from the text.",
    "First compare the two, then justify. Finally, conclude.", "How many apples are 3 boxes?", "How much is it? Why? Explain why.", "List the organizations.", "nothing here",
    "A riddle: must be true or not? 1. yes 2. no", "TL;DR of the summary", "analyse step by step the trade-offs", "I cannot say", "As an AI I am not sure",
)
_VALUES = ", ".join("(" + "'" + p.replace("'", "''") + "')" for p in PROMPTS)


def _prompts(s, d) -> DataFrame:
    own = s.createDataFrame([(p,) for p in PROMPTS], "prompt string")
    return table(s, d, "documents").select(F.col("text").alias("prompt")).union(own).distinct()


def _keyed(s, d, **columns) -> DataFrame:
    p = F.col("prompt")
    return _prompts(s, d).select(F.sha2("prompt", 256).alias("key"), *[c(p).alias(n) for n, c in columns.items()])


def _features(s, d) -> DataFrame:
    return _prompts(s, d).select(F.sha2("prompt", 256).alias("key"), *[F.round(c, 6).alias(n) for n, c in T.features(F.col("prompt")).items()])


def _docs(s, d) -> DataFrame:
    return table(s, d, "documents")


def _grades(s, d) -> DataFrame:
    """Answers made of the benchmark's texts, one kind after another, right and wrong."""
    k, text = F.col("item_id"), F.col("text")
    word = F.element_at(F.split(text, " "), 2)
    letter = F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1))
    kind = F.element_at(F.array(*map(F.lit, ("exact", "contains", "choice", "numeric"))), (F.floor(k / 3) % 4 + 1).cast("int"))
    right = k % 3 > 0
    answer = (
        F.when(F.col("kind") == "exact", F.concat(F.lit("  "), text, F.lit("!! ")))
        .when(F.col("kind") == "contains", F.concat(F.lit("I think: "), text))
        .when(F.col("kind") == "choice", F.concat(F.lit("The answer is ("), letter, F.lit(").")))
        .otherwise(F.concat(F.lit("so 3 + 4 = "), F.format_string("%,d", k * 1009), F.lit(".0")))
    )
    reference = (
        F.when(F.col("kind") == "exact", F.when(right, text).otherwise(F.concat(text, F.lit(" x"))))
        .when(F.col("kind") == "contains", F.when(right, word).otherwise("no such words"))
        .when(F.col("kind") == "choice", F.when(right, letter).otherwise("E"))
        .otherwise(F.when(right, (k * 1009).cast("string")).otherwise("none"))
    )
    rows = table(s, d, "benchmark").withColumn("kind", kind).select("item_id", "kind", answer.alias("answer"), reference.alias("reference"))
    graded = F.lit(None).cast("double")
    for each in ("exact", "contains", "choice", "numeric"):
        graded = F.when(F.col("kind") == each, T.grade(each, F.col("answer"), F.col("reference"))).otherwise(graded)
    return rows.select("item_id", "kind", graded.alias("grade"))


QUERIES = {
    "normalize_prompt": lambda s, d: _docs(s, d).select("doc_id", T.normalize(F.col("text")).alias("norm")),
    "default_group_id": lambda s, d: _docs(s, d).select("doc_id", T.default_group(F.col("text")).alias("group_id")),
    "length_score": lambda s, d: _keyed(s, d, score=lambda p: F.round(T.length_score(p), 6)),
    "signals": lambda s, d: _keyed(s, d, **{n: (lambda p, n=n: T.signal(n, p)) for n in T.SIGNALS}),
    "complexity_score": lambda s, d: _keyed(s, d, score=lambda p: F.round(T.complexity_score(p), 6)),
    "heuristic_score": lambda s, d: _keyed(s, d, score=T.heuristic_score),
    "engineered_features": _features,
    "post_check": lambda s, d: _keyed(s, d, problems=lambda p: F.concat_ws(",", T.post_check(F.lit("unrelated question of some length"), p, 3))),
    "trigram_dominance": lambda s, d: _docs(s, d).select("doc_id", F.round(T.top_trigram_share(F.col("text")), 6).alias("share")),
    "shingles_5": lambda s, d: _docs(s, d).select("doc_id", F.size(T.shingles(F.col("text"))).alias("n")),
    "token_estimate": lambda s, d: _docs(s, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens")),
    "extract_urls": lambda s, d: table(s, d, "pages").select("page_id", F.concat_ws(" ", T.urls(F.concat_ws(" ", "url", F.lit("see http://a.b/c), https://x.y/."), "url"))).alias("urls")),
    "public_link": lambda s, d: table(s, d, "pages").select("page_id", T.public_link(F.col("url")).alias("ok"), T.public_link(F.concat(F.lit("http://user@"), "url")).alias("with_user")),
    "html_to_text": lambda s, d: table(s, d, "pages").select("page_id", T.html_lines(F.col("html")).alias("text")),
    "escape_html": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("digest")),
    "chunk_read": lambda s, d: _docs(s, d).select("doc_id", T.chunk(F.col("text"), 100, 500).alias("c")).select("doc_id", "c.text", "c.total", "c.next_offset"),
    "offload": lambda s, d: _docs(s, d).select("doc_id", F.when(F.length("text") > 5000, F.sha2("text", 256)).alias("key"), F.when(F.length("text") > 5000, F.substring("text", 1, 1000)).otherwise(F.col("text")).alias("preview")),
    "grade": _grades,
    "grade_contains": lambda s, d: _contains(s, d),
    "manifest_counts": lambda s, d: _docs(s, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")),
    "cost_ceiling": lambda s, d: _docs(s, d).agg(F.sum(F.octet_length("text") + 64 + F.octet_length(F.lit("system\n"))).alias("bytes"), F.count(F.lit(1)).alias("tasks")),
}


def _contains(s, d) -> DataFrame:
    """Documents that hold a benchmark passage, or one of its first four words (each item's, told by 100000 and more)."""
    text = table(s, d, "benchmark").select("item_id", T.normalize(F.col("text")).alias("reference"))
    short = text.select((F.col("item_id") + 100000).alias("item_id"), F.array_join(F.slice(F.split("reference", " "), 2, 4), " ").alias("reference"))
    return indexes.contained(_docs(s, d).select("doc_id", T.normalize(F.col("text")).alias("answer")), text.unionByName(short))


_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN\\pM_\\s\\x{00A0}]', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g'))"
_WORDS = "len(list_filter(regexp_split_to_array(prompt, '[\\s\\x{00A0}]+'), lambda x: x <> ''))"
_P = f"(SELECT text AS prompt FROM documents UNION SELECT * FROM (VALUES {_VALUES}))"
LENGTH_SQL = f"CASE WHEN {_WORDS} <= 15 THEN 1.0::DOUBLE WHEN {_WORDS} >= 120 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - ({_WORDS} - 15)::DOUBLE / 105.0::DOUBLE END"


def _signal_sql(name: str) -> str:
    """A signal in RE2. ``\\b`` there is of ASCII words: accented letters are first made plain ones."""
    weight, pattern = T.SIGNALS[name]
    flags = "is" if "s" in pattern[2 : pattern.index(")")] else "i"
    body = pattern[pattern.index(")") + 1 :].replace("'", "''")
    return f"regexp_matches(regexp_replace(prompt, '[^\\x00-\\x7F]', 'x', 'g'), '{body}', '{flags}')"


COMPLEX_SQL = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (0.0::DOUBLE" + "".join(f" + CASE WHEN {_signal_sql(n)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for n, (w, _) in T.SIGNALS.items()) + ")))"
_HTML = "html"
for _pattern, _to, _flags in (
    ("<!--.*?-->", "", "gs"), ("<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>", "", "gis"),
    ("</(p|div|br|li|h1|h2)\\s*>|<(p|div|br|li|h1|h2)\\b[^>]*/>", "\n", "gi"), ("<[/!?a-zA-Z][^>]*>", "", "g"),
):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '{_to}', '{_flags}')"
# The references that occur in the pages; the operator knows all.
for _code, _mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", "\u00a0"), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_code}', '{_mark}')"
_HTML = f"substr(regexp_replace({_HTML}, '[ \\t]+', ' ', 'g'), 1, 24000)"
_ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_PLAIN = "regexp_replace(prompt, '[^\\x00-\\x7F]', 'x', 'g')"
_COUNT = lambda pattern, of="prompt": f"len(regexp_extract_all({of}, '{pattern}'))::DOUBLE"
_SPLIT = "list_filter(regexp_split_to_array(prompt, '[\\s\\x{00A0}]+'), lambda x: x <> '')"
_SIGNAL_SQL = ", ".join(f"CASE WHEN {_signal_sql(n)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal_{n}" for n in sorted(T.SIGNALS))
_FEATURES = f"""
SELECT sha256(prompt) AS key, round(ln(1 + length(prompt)), 6) AS n_chars_log, round(ln(1 + {_WORDS}), 6) AS n_words_log,
  round(coalesce(list_sum(list_transform({_SPLIT}, lambda x: length(x)))::DOUBLE / nullif({_WORDS}, 0), 0.0), 6) AS avg_word_len,
  {_COUNT("[.!?]+")} AS n_sentences, {_COUNT(chr(10))} + 1 AS n_lines, {_COUNT("[?]")} AS n_question_marks,
  round(coalesce({_COUNT("[0-9]")} / nullif(length(prompt), 0), 0.0), 6) AS digit_ratio, round(coalesce({_COUNT("[\\p{{Lu}}]".replace("{{", "{").replace("}}", "}"))} / nullif(length(prompt), 0), 0.0), 6) AS upper_ratio,
  {_COUNT("[0-9]\\s*[-+*/^%=]\\s*[0-9]")} AS n_math_ops, CASE WHEN contains(prompt, '```') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_code_fence,
  CASE WHEN regexp_matches({_PLAIN}, '^\\s*(what|who|when|where|which|why|how|is|are|do|does|can|did)\\b', 'i') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS starts_with_question_word,
  {_COUNT("\\b[A-Z][A-Z]+\\b", _PLAIN)} AS n_allcaps_words, round({LENGTH_SQL}, 6) AS heuristic_length_score, round({COMPLEX_SQL}, 6) AS heuristic_complexity_score, {_SIGNAL_SQL}
FROM {_P}"""
_HEDGE = "|".join(h.replace("'", "''") for h in T.HEDGES)
_CHECKED = f"""
WITH p AS (SELECT prompt, row_number() OVER () AS i, {_SPLIT} AS w FROM {_P}),
t AS (SELECT i, len(w) AS n, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(chr(31), w[i], w[i + 1], w[i + 2]))) AS x FROM p WHERE len(w) >= 12),
m AS (SELECT i, max(c)::DOUBLE / (any_value(n) - 2) AS share FROM (SELECT i, any_value(n) AS n, count(*) AS c FROM t GROUP BY i, x) GROUP BY i)
SELECT sha256(prompt) AS key, concat_ws(',', CASE WHEN length(trim(prompt, ' ' || chr(9) || chr(10) || chr(13))) < 3 THEN 'empty_or_truncated' END,
  CASE WHEN regexp_matches(regexp_replace(substr(lower(trim(prompt, ' ' || chr(9) || chr(10) || chr(13))), 1, 120), '[^\\x00-\\x7F]', 'x', 'g'), '\\b({_HEDGE})\\b') THEN 'hedging_or_refusal' END,
  CASE WHEN starts_with(lower(prompt), 'unrelated question of some length') THEN 'prompt_echo' END, CASE WHEN share > 0.3 THEN 'degenerate_repetition' END) AS problems
FROM p LEFT JOIN m USING (i)"""
ORACLES = {
    "engineered_features": _FEATURES,
    "post_check": _CHECKED,
    "extract_urls": "SELECT page_id, concat_ws(' ', regexp_replace(url, '[.,;:!?)\\]}''\"]+$', ''), 'http://a.b/c', 'https://x.y/') AS urls FROM pages",
    "normalize_prompt": f"SELECT doc_id, {_NORM} AS norm FROM documents",
    "default_group_id": f"SELECT doc_id, concat('g-', substr(sha256({_NORM}), 1, 16)) AS group_id FROM documents",
    "length_score": f"SELECT sha256(prompt) AS key, round({LENGTH_SQL}, 6) AS score FROM {_P}",
    "signals": f"SELECT sha256(prompt) AS key, {', '.join(f'{_signal_sql(n)} AS {n}' for n in T.SIGNALS)} FROM {_P}",
    "complexity_score": f"SELECT sha256(prompt) AS key, round({COMPLEX_SQL}, 6) AS score FROM {_P}",
    "heuristic_score": f"SELECT sha256(prompt) AS key, round((round({LENGTH_SQL}, 3) * 0.4::DOUBLE + round({COMPLEX_SQL}, 3) * 0.6::DOUBLE) / 1.0::DOUBLE, 3) AS score FROM {_P}",
    "trigram_dominance": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x{00A0}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(chr(31), w[i], w[i + 1], w[i + 2]))) AS x FROM w WHERE len(w) >= 3)
SELECT d.doc_id, round(m.c::DOUBLE / m.n, 6) AS share FROM documents d LEFT JOIN (SELECT doc_id, any_value(n) - 2 AS n, max(c) AS c FROM (SELECT doc_id, any_value(n) AS n, count(*) AS c FROM t GROUP BY doc_id, x) GROUP BY doc_id) m USING (doc_id)""",
    "shingles_5": f"SELECT doc_id, CASE WHEN length(norm) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(norm) - 3), lambda i: substr(norm, i, 5)))) END::INT AS n FROM (SELECT doc_id, {_NORM} AS norm FROM documents)",
    "token_estimate": "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents",
    "public_link": "SELECT page_id, length(url) <= 2048 AND regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)') AS ok, regexp_matches(concat('http://user@', url), '^https?://[^/?#@]+([/?#]|$)') AS with_user FROM pages",
    "html_to_text": f"SELECT page_id, {_HTML} AS text FROM pages",
    "escape_html": f"SELECT page_id, sha256({_ESCAPED}) AS digest FROM pages",
    "chunk_read": "SELECT doc_id, substr(text, 101, 500) AS text, length(text)::INT AS total, CASE WHEN length(text) > 600 THEN 600 END AS next_offset FROM documents",
    "offload": "SELECT doc_id, CASE WHEN length(text) > 5000 THEN sha256(text) END AS key, CASE WHEN length(text) > 5000 THEN substr(text, 1, 1000) ELSE text END AS preview FROM documents",
    "grade": "SELECT item_id, ['exact', 'contains', 'choice', 'numeric'][item_id // 3 % 4 + 1] AS kind, CASE WHEN item_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade FROM benchmark",
    "grade_contains": f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {_NORM} AS a FROM documents) d JOIN (SELECT item_id, {_NORM} AS r FROM benchmark UNION ALL SELECT item_id + 100000, array_to_string(string_split({_NORM}, ' ')[2:5], ' ') FROM benchmark) b ON contains(d.a, b.r)",
    "manifest_counts": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL",
    "cost_ceiling": "SELECT sum(octet_length(encode(text)) + 71)::BIGINT AS bytes, count(*) AS tasks FROM documents",
}
