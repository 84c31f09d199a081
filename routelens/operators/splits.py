"""Dataset hygiene: validation, duplicates and leakage, group-safe splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions.hashrng import uniform, uniform_sql
from ..sources.views import table, view, with_views
from . import nearsets
from .running import running, settled, spread

QUALITY, NEAR, SEED = 0.6, 0.85, 7
#: Groups that one fold of the split assigns, on the mean.
FOLD = 10_000
#: Shares of train, validation and test.
RATIOS = (("train", 0.7), ("val", 0.15), ("test", 0.15))


def validate(rows: DataFrame, threshold: float = QUALITY) -> DataFrame:
    """task_id and problem for each rule a record breaks; no rows for a valid dataset."""
    unit = lambda c: (f"{c}_out_of_unit", (F.col(c) < 0) | (F.col(c) > 1) | F.isnan(c))
    positive = lambda c: (f"{c}_negative", (F.col(c) < 0) | F.isnan(c))
    rules = [
        ("missing_task_id", F.col("task_id").isNull()),
        ("blank_prompt", F.col("prompt").isNull() | (F.trim("prompt") == "")),
        *[(f"missing_{c}", F.col(c).isNull()) for c in ("local_quality", "remote_quality", "local_ok")],
        *map(unit, ("local_quality", "remote_quality", "local_confidence", "local_min_token_prob", "local_low_token_frac")),
        *map(positive, ("local_cost", "remote_cost", "local_latency_s", "remote_latency_s")),
        ("label_contradicts_quality", F.col("local_ok") != (F.col("local_quality") >= threshold)),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    broken = rows.select("task_id", F.explode(each).alias("problem"))
    twice = rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id", F.lit("duplicate_task_id").alias("problem"))
    return broken.unionByName(twice)


def _normal(rows: DataFrame) -> Column:
    """The normal form of the prompts: given as norm, or made."""
    return F.col("norm") if "norm" in rows.columns else T.normalize(F.col("prompt"))


def exact_dup_conflicts(rows: DataFrame) -> DataFrame:
    """(first, later) tasks of one normal form in different groups; first is the earliest by order."""
    keyed = settled(rows.select("task_id", "group_id", "ord", F.sha2(_normal(rows), 256).alias("norm")))
    first = keyed.groupBy("norm").agg(F.min(F.struct("ord", F.col("task_id").alias("first"), F.col("group_id").alias("g"))).alias("f")).select("norm", "f.first", "f.g")
    return keyed.join(first, "norm").where("group_id <> g").select("first", F.col("task_id").alias("later"))


def near_dup_classes(rows: DataFrame, threshold: float = NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (task_id, group_id, ord, h) of each distinct set of 5-character shingles, the links of each set, and trees of alike sets.

    Equal sets are one row before anything is compared, and alike ones are never expanded into pairs (``nearsets``).
    """
    text = "norm" if "norm" in rows.columns else "prompt"
    own = rows.select("task_id", "group_id", "ord", text, F.xxhash64("task_id", "ord", text).alias("key"))
    told = settled(nearsets.sketched(own.select("task_id", "group_id", "ord", "key", _normal(own).alias("norm")), "norm"))
    sets = settled(told.groupBy("h").agg(F.first("bits").alias("bits"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min("key").alias("key")))

    def texts(wanted: DataFrame) -> DataFrame:
        """h and norm, of one row each."""
        found = own.select("key", text).join(sets.join(wanted, "h").select("key", "h"), "key").dropDuplicates(["h"])
        return found.select("h", _normal(found).alias("norm"))

    links, trees = nearsets.classes(sets, texts, threshold, components)
    return told.select("task_id", "group_id", "ord", "h"), links, settled(trees)


def near_dup_roots(members: DataFrame, trees: DataFrame) -> DataFrame:
    """``members`` with the root of their set's component, its own h where it is alike to none."""
    roots = components(trees, trees.select(F.col("x").alias("node")).union(trees.select("y")).distinct())
    return members.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))


def near_dup_pairs(rows: DataFrame, threshold: float = NEAR) -> DataFrame:
    """A row for each prompt that is alike to others by the Jaccard likeness of its 5-character shingles: its class (the
    earliest prompt of it), how many others it is alike to, the likeness of the closest, and whether its class is in several groups.
    """
    members, links, trees = near_dup_classes(rows, threshold)
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("own"))
    known = near_dup_roots(members, trees).join(sizes, "h").join(links, "h", "left")
    known = known.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("own") - 1, "score": F.when(F.col("own") > 1, 1.0).otherwise(F.col("score"))}).where("links > 0")
    known = settled(known)
    whole = known.groupBy("root").agg(F.min_by("task_id", "ord").alias("class"), (F.min("group_id") < F.max("group_id")).alias("across"))
    return known.join(whole, "root").select("task_id", "class", "links", F.round("score", 6).alias("score"), "across")


def near_dup_groups(rows: DataFrame, threshold: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """group_id and root of groups merged where they hold near copies; and (group_id, links, score): the links of its prompts, the closest likeness."""
    members, links, trees = near_dup_classes(rows, threshold)
    held = settled(near_dup_roots(members, trees).groupBy("root", "h", "group_id").agg(F.count(F.lit(1)).alias("k")))
    least = held.groupBy("root").agg(F.min("group_id").alias("y"))
    edges = held.select("root", "group_id").distinct().join(least, "root").where("group_id <> y").select(F.col("group_id").alias("x"), "y").distinct()
    sizes = held.groupBy("h").agg(F.sum("k").alias("own"))
    each = held.join(sizes, "h").join(links, "h", "left").withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("own") - F.col("k"), "score": F.when(F.col("own") > F.col("k"), 1.0).otherwise(F.col("score"))})
    ends = each.groupBy("group_id").agg(F.sum(F.col("k") * F.col("links")).alias("links"), F.max("score").alias("score"))
    return components(edges, rows.select(F.col("group_id").alias("node")).distinct()).select(F.col("node").alias("group_id"), "root"), ends


def near_dup_merge_report(rows: DataFrame, threshold: float = NEAR) -> DataFrame:
    """Each group that is merged into another for splitting: its root, the links of its prompts to alike ones, and the closest likeness."""
    roots, ends = near_dup_groups(rows, threshold)
    return roots.where("group_id <> root").join(ends, "group_id").select("group_id", "root", "links", F.round("score", 6).alias("score"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the least node of its component. Labels fall along edges and jump until none changes."""
    both = settled(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = nodes.select("node", F.col("node").alias("root"))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("x", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        # only roots that fell themselves: a giant component's root isn't among them, and its nodes may be dealt to several tasks
        jump = lower.where("root <> node").select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = settled(lower.join(jump.hint("merge"), "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        if not labels.where("root < old").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def group_components(rows: DataFrame) -> DataFrame:
    """Groups joined where they hold one normal form, each with the least group of its component."""
    keyed = rows.select(F.sha2(T.normalize(F.col("prompt")), 256).alias("norm"), "group_id").distinct()
    least = keyed.groupBy("norm").agg(F.min("group_id").alias("y"))
    edges = keyed.join(least, "norm").where("group_id <> y").select(F.col("group_id").alias("x"), "y").distinct()
    return components(edges, rows.select(F.col("group_id").alias("node")).distinct()).select(F.col("node").alias("group_id"), "root")


def greedy_split(rows: DataFrame, seed: int = SEED, fold: int = FOLD) -> DataFrame:
    """task_id and split: groups in hashed order, each to the split that lacks most rows.

    The fold runs over one row for each group. Beyond ``fold`` groups, ranges of the hashed order are folded each on
    their own, to the same shares: no task holds all groups, and the splits keep their shares.
    """
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("u", uniform(seed, F.col("group_id")))
    ranges = sizes.agg(F.ceil(F.count(F.lit(1)) / fold).alias("ranges"))
    ranged = sizes.crossJoin(F.broadcast(ranges)).select("group_id", "n", "u", F.floor(F.col("u") * F.col("ranges")).alias("range"))

    def assign(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["u", "group_id"])
        wanted, out = {s: r * int(groups["n"].sum()) for s, r in RATIOS}, []
        filled = dict.fromkeys(wanted, 0)
        for n in groups["n"].tolist():
            split = max(filled, key=lambda s: wanted[s] - filled[s])  # the first of equals
            filled[split] += n
            out.append(split)
        return pd.DataFrame({"group_id": groups["group_id"].to_numpy(), "split": out})

    assigned = ranged.groupBy("range").applyInPandas(assign, "group_id string, split string")
    return rows.select("task_id", "group_id", "local_ok").join(assigned, "group_id")


def make_splits(rows: DataFrame, seed: int = SEED, threshold: float = NEAR) -> DataFrame:
    """task_id, group_id (merged), local_ok and split; near copies never stand in two splits.

    ValueError where prompts of one normal form stand in different groups: that is a fault of the grouping.
    """
    rows = settled(rows.select("task_id", "group_id", "ord", "local_ok", T.normalize(F.col("prompt")).alias("norm")))
    if bad := exact_dup_conflicts(rows).limit(3).collect():
        raise ValueError(f"equal prompts in different groups, among them {[tuple(r) for r in bad]}")
    roots, _ = near_dup_groups(rows, threshold)
    merged = rows.join(roots, "group_id").withColumn("group_id", F.col("root")).drop("root")
    return greedy_split(merged, seed)


def grouped_by_prompt(rows: DataFrame) -> DataFrame:
    """Rows grouped by their prompts' normal form, as rows without a group of their own are."""
    return spread(rows).withColumn("group_id", T.default_group(F.col("prompt")))


def split_stats(assigned: DataFrame) -> DataFrame:
    """Rows, groups and label rate of each split, and whether the rates differ by over 15 points."""
    own = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"), F.avg(F.col("local_ok").cast("int")).alias("rate"))
    gap = own.agg((F.max("rate") - F.min("rate") > 0.15).alias("unbalanced"))
    return own.crossJoin(F.broadcast(gap)).select("split", "n", "groups", F.round("rate", 6).alias("rate"), "unbalanced")


def serial_ids(rows: DataFrame) -> DataFrame:
    """Rows numbered within their source by order, by running counts over all sources."""
    told = running(rows.select("task_id", "source", "ord"), [F.col("source"), F.col("ord"), F.col("task_id")], k=F.lit(1))
    first = told.groupBy("source").agg(F.min("k").alias("first"))
    return told.join(first, "source").select("task_id", F.concat(F.col("source"), F.lit("-"), F.format_string("%03d", F.col("k") - F.col("first"))).alias("serial"))


def _out(s, d):
    return view(s, d, "outcomes")


def _broken(s, d):
    """The outcomes with some records spoilt, so that every rule has something to find."""
    o, k = _out(s, d), F.col("ord")
    return o.withColumns({
        "task_id": F.when(k % 50 == 7, F.lit("dup")).otherwise(F.col("task_id")),
        "prompt": F.when(k % 41 == 3, F.lit("  ")).otherwise(F.col("prompt")),
        "local_quality": F.when(k % 37 == 5, F.lit(1.5)).otherwise(F.col("local_quality")),
        "local_cost": F.when(k % 43 == 2, F.lit(-1.0)).otherwise(F.col("local_cost")),
        "local_ok": F.when(k % 47 == 1, ~F.col("local_ok")).when(k % 53 == 4, F.lit(None)).otherwise(F.col("local_ok")),
    })


QUERIES = {
    "validate_outcomes": lambda s, d: validate(_broken(s, d)),
    "exact_dup_conflicts": lambda s, d: exact_dup_conflicts(_out(s, d)),
    "near_dup_pairs": lambda s, d: near_dup_pairs(_out(s, d)),
    "group_components": lambda s, d: group_components(_out(s, d)),
    "near_dup_merge_report": lambda s, d: near_dup_merge_report(grouped_by_prompt(_out(s, d))),
    "make_splits": lambda s, d: make_splits(grouped_by_prompt(_out(s, d))).select("task_id", "group_id", "split"),
    "greedy_split": lambda s, d: greedy_split(_out(s, d)).select("task_id", "split"),
    "split_stats": lambda s, d: split_stats(greedy_split(_out(s, d))),
    "merge_dup_check": lambda s, d: _out(s, d).groupBy(F.sha2(T.normalize(F.col("prompt")), 256).alias("norm")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where("n > 1"),
    "content_hash": lambda s, d: _out(s, d).select("task_id", F.substring(F.sha2(F.concat_ws("\x1f", "task_id", "prompt", "category", "group_id"), 256), 1, 16).alias("digest")),
    "stable_sample": lambda s, d: _out(s, d).orderBy(uniform(21, F.col("task_id")), "task_id").limit(100).select("task_id", "ord"),
    "anti_exclusions": lambda s, d: _out(s, d).join(table(s, d, "labels").select(F.col("doc_id").cast("string").alias("task_id")), "task_id", "left_anti").select("task_id", "category"),
    "ab_shuffle": lambda s, d: _out(s, d).select("task_id", F.when(uniform(5, F.col("task_id")) < 0.5, "A").otherwise("B").alias("label")),
    "serial_ids": lambda s, d: serial_ids(_out(s, d)),
}

_NORM = "trim(regexp_replace(regexp_replace(lower(prompt), '[^\\pL\\pN\\pM_\\s\\x{00A0}]', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g'))"
_KEYED = f"(SELECT task_id, group_id, ord, local_ok, sha256({_NORM}) AS norm FROM outcomes)"
_SPOILT = """SELECT ord, CASE WHEN ord % 50 = 7 THEN 'dup' ELSE task_id END AS task_id, CASE WHEN ord % 41 = 3 THEN '  ' ELSE prompt END AS prompt, CASE WHEN ord % 37 = 5 THEN 1.5 ELSE local_quality END AS local_quality,
  remote_quality, CASE WHEN ord % 43 = 2 THEN -1.0 ELSE local_cost END AS local_cost, CASE WHEN ord % 47 = 1 THEN NOT local_ok WHEN ord % 53 = 4 THEN NULL ELSE local_ok END AS local_ok FROM outcomes"""
_SPLIT = f"""
WITH RECURSIVE sizes AS (SELECT group_id, count(*) AS n, {uniform_sql("'7'", "group_id")} AS u FROM outcomes GROUP BY group_id), g AS (SELECT *, row_number() OVER (ORDER BY u, group_id) AS i, (SELECT count(*) FROM outcomes) AS total FROM sizes),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS tr, 0::BIGINT AS va, 0::BIGINT AS te, ''::VARCHAR AS group_id, ''::VARCHAR AS split
  UNION ALL SELECT i, tr + CASE WHEN s = 'train' THEN n ELSE 0 END, va + CASE WHEN s = 'val' THEN n ELSE 0 END, te + CASE WHEN s = 'test' THEN n ELSE 0 END, group_id, s
  FROM (SELECT g.i, g.n, g.group_id, tr, va, te, CASE WHEN 0.7::DOUBLE * total - tr >= 0.15::DOUBLE * total - va AND 0.7::DOUBLE * total - tr >= 0.15::DOUBLE * total - te THEN 'train' WHEN 0.15::DOUBLE * total - va >= 0.15::DOUBLE * total - te THEN 'val' ELSE 'test' END AS s
    FROM f JOIN g ON g.i = f.i + 1))"""
ORACLES = {
    "validate_outcomes": with_views(f"""
WITH r AS ({_SPOILT})
SELECT task_id, 'blank_prompt' AS problem FROM r WHERE trim(prompt) = '' UNION ALL SELECT task_id, 'missing_local_ok' FROM r WHERE local_ok IS NULL
UNION ALL SELECT task_id, 'local_quality_out_of_unit' FROM r WHERE local_quality > 1 UNION ALL SELECT task_id, 'local_cost_negative' FROM r WHERE local_cost < 0
UNION ALL SELECT task_id, 'label_contradicts_quality' FROM r WHERE local_ok <> (local_quality >= 0.6::DOUBLE) UNION ALL SELECT task_id, 'duplicate_task_id' FROM r GROUP BY task_id HAVING count(*) > 1""", "outcomes"),
    "exact_dup_conflicts": with_views(f"SELECT f.task_id AS first, k.task_id AS later FROM {_KEYED} k JOIN (SELECT norm, arg_min(task_id, ord) AS task_id, arg_min(group_id, ord) AS g FROM {_KEYED} GROUP BY norm) f USING (norm) WHERE k.group_id <> f.g", "outcomes"),
    "group_components": with_views(f"""
WITH RECURSIVE k AS (SELECT DISTINCT norm, group_id FROM {_KEYED}), e AS (SELECT DISTINCT a.group_id AS x, b.group_id AS y FROM k a JOIN k b USING (norm)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS group_id, min(y) AS root FROM r GROUP BY x""", "outcomes"),
    "greedy_split": with_views(f"{_SPLIT} SELECT task_id, split FROM outcomes JOIN f USING (group_id)", "outcomes"),
    "split_stats": with_views(f"""{_SPLIT}, own AS (SELECT split, count(*) AS n, count(DISTINCT group_id) AS groups, avg(local_ok::INT) AS rate FROM outcomes JOIN f USING (group_id) GROUP BY split)
SELECT split, n, groups, round(rate, 6) AS rate, (SELECT max(rate) - min(rate) > 0.15 FROM own) AS unbalanced FROM own""", "outcomes"),
    "merge_dup_check": with_views(f"SELECT norm, count(*) AS n, min(ord) AS first FROM {_KEYED} GROUP BY norm HAVING count(*) > 1", "outcomes"),
    "content_hash": with_views("SELECT task_id, substr(sha256(concat_ws(chr(31), task_id, prompt, category, group_id)), 1, 16) AS digest FROM outcomes", "outcomes"),
    "stable_sample": with_views(f"SELECT task_id, ord FROM outcomes ORDER BY {uniform_sql(chr(39) + '21' + chr(39), 'task_id')}, task_id LIMIT 100", "outcomes"),
    "anti_exclusions": with_views("SELECT task_id, category FROM outcomes WHERE ord NOT IN (SELECT doc_id FROM labels)", "outcomes"),
    "ab_shuffle": with_views(f"SELECT task_id, CASE WHEN {uniform_sql(chr(39) + '5' + chr(39), 'task_id')} < 0.5 THEN 'A' ELSE 'B' END AS label FROM outcomes", "outcomes"),
    "serial_ids": with_views("SELECT task_id, concat(source, '-', printf('%03d', row_number() OVER (PARTITION BY source ORDER BY ord) - 1)) AS serial FROM outcomes", "outcomes"),
}
