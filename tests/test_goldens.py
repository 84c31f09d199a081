"""Closed-form cases."""

import datetime as dt
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from routelens.functions import text as T
from routelens.operators import indexes, chatlog, contracts, conversations, datasets, metrics, running, simulate, splits, sweep, text, usage, workspace
from routelens.sources import files


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def outcomes(spark, rows):
    names = "task_id string, ord long, prompt string, category string, source string, group_id string, local_quality double, remote_quality double, local_ok boolean, local_cost double, remote_cost double, local_latency_s double, remote_latency_s double, local_confidence double, local_min_token_prob double, local_low_token_frac double, post_check_problem string, p_local double"
    return spark.createDataFrame(rows, names)


def row(i, p=0.5, lq=0.2, rq=0.9, conf=0.9, problem=None, group="g", prompt="p", category="c", ok=None):
    return (str(i), i, prompt, category, "s", group, lq, rq, lq >= 0.6 if ok is None else ok, 0.1, 1.0, 1.0, 3.0, conf, 0.45, 0.1, problem, p)


def test_normal_form(spark):
    r = one(spark, a=T.normalize(F.lit("  What is   2+2?! ")), g=T.default_group(F.lit("Hello!")), h=T.default_group(F.lit("hello")), b=T.default_group(F.lit("bye")), u=T.normalize(F.lit("ÉCOLE, oui")))
    assert r.a == "what is 2 2" and r.g == r.h != r.b and r.u == "école oui"


def test_scores(spark):
    r = one(spark, short=T.heuristic_score(F.lit("What is the capital of France?")), hard=T.heuristic_score(F.lit("Prove this theorem and compute the integral")), long=T.length_score(F.lit("w " * 120)), accent=T.signal("math", F.lit("écompute")))
    assert r.short == 1.0 and r.hard == 0.55 and r.long == 0.0 and not r.accent


def test_post_check(spark):
    check = lambda p, o: one(spark, x=T.post_check(F.lit(p), F.lit(o), 3)).x
    assert check("q", "  ") == ["empty_or_truncated"]
    assert check("q", "I don't know, sorry") == ["hedging_or_refusal"]
    assert check("What is the capital of France, please?", "what is the capital of france, please? Paris") == ["prompt_echo"]
    assert check("q", "a b c " * 10) == ["degenerate_repetition"]
    assert check("q", "Paris is the capital") == []


def test_graders(spark):
    cases = (
        ("exact", " The  Answer! ", "the answer", 1.0), ("exact", "no", "yes", 0.0), ("contains", "I think it is Paris, France.", "paris", 1.0), ("contains", "London", "paris", 0.0),
        ("choice", "The answer is (B).", "B", 1.0), ("choice", "Because", "B", 0.0), ("numeric", "so 3 + 4 = 1,007.0", "1007", 1.0), ("numeric", "about 12", "13", 0.0), ("numeric", "none", "13", 0.0),
    )
    for kind, answer, reference, want in cases:
        assert one(spark, g=T.grade(kind, F.lit(answer), F.lit(reference))).g == want, (kind, answer)


def reply(*texts, id=1, error=None, failed=False):
    """A search reply as JSON."""
    return json.dumps({"id": id, "result": {"isError": failed, "content": [{"type": "text", "text": t} for t in texts]}} | ({"error": error} if error else {}))


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (datasets.route_intent, (('{"route": "local"}', "local"), ("{'route': 'strong'}", "strong"), ('```json\n{"route": "local"}\n```', "local"), ('{"route": "other"}', None), ("local", None))),
        (datasets.requested_format, (("Write a report as a docx", "docx"), ("what is csv?", None), ("Export the table to csv please", "csv"), ("Create a word document", "docx"), ("make it in json", "json"), ("write a poem without a file", None), ("hello", None), ("tell me how csv works in json", None), ("save it as notes.md", "md"), ("read my.csv", None))),
        (datasets.is_followup, (("What about it?", True), ("Capital of France", False), ("Explain the previous answer", True), ("Theory of sets", False))),
        (
            datasets._shown_blocks,
            (
                (reply("Title: One\nURL: https://a.b/c\nHighlights: some text\nmore", "Title: Two\nURL: ftp://x\nText: no\nTitle: Three\nURL: http://d.e\nText: end"), "One|https://a.b/c|some text more;Three|http://d.e|end"),
                (reply("nothing here"), ""),
                ("event: message\ndata: " + reply("Title: no", id=2) + "\n\ndata: " + reply("".join(f"\nTitle: {i}\nURL: ftp://x" for i in range(1200)) + "\nTitle: Last\nURL: http://l.m\nText: t") + "\n", "Last|http://l.m|t"),
                (reply("Title: One\nURL: https://a.b/c", error={"code": 3}), None),
                (reply("Title: One\nURL: https://a.b/c", failed=True), None),
                ("no packet", None),
            ),
        ),
        (files.bbh_reference, (("(C)", "C"), (" yes ", "yes"), ("(AB)", "(AB)"))),
        (datasets.gsm8k_reference, (("so it is\n#### 1,200", "1200"), ("#### many", None), ("none", None))),
    ],
)
def test_rules_of_text(spark, rule, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    assert [r.y for r in rows.orderBy("i").select(rule(F.col("x")).alias("y")).collect()] == [c[1] for c in cases]


def test_models_and_unmatched_joins(spark):
    models = spark.createDataFrame([("other/MODEL-a",), ("model-b ",), ("org/model-c",)], "model string")
    got = dict(map(tuple, datasets.model_allowlist(models, ("org/Model-A", "org/model-b")).collect()))
    assert got == {"other/MODEL-a": "org/Model-A", "model-b ": "org/model-b", "org/model-c": None}
    rows = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.3, 0.4)], "task_id string, local_quality double, remote_quality double")
    verdicts = spark.createDataFrame([("b", None, 1.0, 0.0, None)], "task_id string, cheap double, local double, strong double, remote double")
    assert sorted(map(tuple, datasets.join_grades(rows, verdicts).collect())) == [("a", 0.1, 0.2), ("b", 1.0, 0.0)]


def test_recent_turns_and_fallback(spark):
    rows = [(1, 0, "user", "a" * 1500), (1, 1, "assistant", "b" * 900), (1, 2, "tool", "z"), (1, 3, "user", "c" * 700), (1, 4, "assistant", "d" * 600), (2, 0, "user", "x")]
    got = {r.conversation_id: [(m.role, m.content) for m in r.window] for r in datasets.recent_turns(spark.createDataFrame(rows, "conversation_id long, turn long, role string, content string")).collect()}
    assert got == {1: [("assistant", "b" * 700), ("user", "c" * 700), ("assistant", "d" * 600)], 2: [("user", "x")]}
    r = datasets.routed(spark.createDataFrame([("Calculate 2 * 3, prove it and write an algorithm", "no"), ("hi", "no"), ("hi", "{'route': 'strong'}")], "prompt string, reply string")).collect()
    assert [(x.route, x.kind) for x in r] == [("strong", "heuristic-fallback"), ("local", "heuristic-fallback"), ("strong", "reply")]


def test_html_lines(spark):
    page = "<p>one</p>two <b>three</b><br/>four<br>five<script>x<p></p></script><!-- <p>no</p> --> caf&eacute;&#8217;s &lt;b&gt;<style>never closed"
    assert one(spark, t=T.html_lines(F.lit(page))).t == "one\ntwo three\nfourfive café’s <b>"
    assert len(one(spark, t=T.html_lines(F.lit("<p>" + "x" * 30000))).t) == 24000


def test_html_references_are_closed_ones(spark):
    assert one(spark, t=T.html_lines(F.lit("x&amp<b>To</b> &notit; &amp;lt; &#39;&nope;"))).t == "x&ampTo &notit; &lt; '&nope;"


def test_neighbours_in_long_keys(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("item"), F.col("id").alias("ord"))
    began = time.time()
    got = running.scan(rows, ["item"], [F.col("ord")], before=("lag", F.col("ord")), after=("lead", F.col("ord")))
    assert got.where("coalesce(before, ord - 2) = ord - 2 AND coalesce(after, ord + 2) = ord + 2").count() == 60_000 and got.where("after IS NULL").count() == 2
    assert time.time() - began < 60  # frames up to the end took time with the square of a key's rows


def test_contained_passages_of_any_length(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta end"), (2, "xalpha beta gammay"), (3, "gamma"), (4, "one two three four five six seven eight")], "doc_id long, answer string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["beta gamma delta", "alpha beta gamma", "gamma", "eta gam", "two three four five six seven", "delta end x", "wo three four fiv"])], "item_id long, reference string")
    got = {tuple(r) for r in indexes.contained(docs, items, 30).collect()}
    assert got == {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.reference in d.answer}


def test_running_sums_and_quantiles(spark):
    import random
    import statistics

    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(40)), rng.randrange(9)) for _ in range(500)] + [("c", 1.5, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(6).withColumn("i", F.monotonically_increasing_id())
    got = running.running(df, [F.col("x"), F.col("i")], s=F.col("n"), k=F.lit(1)).collect()
    so_far = 0
    for place, r in enumerate(sorted(got, key=lambda r: (r.x, r.i)), 1):
        so_far += r.n
        assert (r.s, r.k) == (so_far, place)
    found = {r.g: r for r in running.quantiles(df, "g", "x", median=("linear", 0.5), p95=("nearest", 0.95)).collect()}
    for g in "abc":
        values = sorted(r[1] for r in rows if r[0] == g)
        assert found[g].median == statistics.median(values) and found[g].p95 == values[round(0.95 * (len(values) - 1))]


def test_web_text(spark):
    r = one(spark, u=T.urls(F.lit("see https://a.b/c), https://a.b/c. http://x")), ok=T.public_link(F.lit("https://a.b/c")), bad=T.public_link(F.lit("https://u@a.b/c")), ftp=T.public_link(F.lit("ftp://a")), code=T.fenced_blocks(F.lit("x\n```py\n1\n2\n```\ny")), c=T.chunk(F.lit("abcdef"), 2, 3), n=T.token_estimate(F.lit("")))
    assert r.u == ["https://a.b/c", "http://x"] and r.ok and not r.bad and not r.ftp and [tuple(c) for c in r.code] == [("py", "py", "1\n2\n")]
    assert (r.c.text, r.c.total, r.c.next_offset) == ("cde", 6, 5) and r.n == 1


def test_cascade(spark):
    rows = outcomes(spark, [row(0), row(1, conf=0.1), row(2, conf=None), row(3, problem="x")])
    strong = simulate.simulate(rows, F.lit(False)).first()
    assert (strong.quality, strong.cost, strong.latency) == (0.9, 1.0, 3.0)
    kept, low, unknown, flagged = simulate.simulate(rows, F.lit(True)).orderBy("ord").collect()
    assert (kept.quality, kept.unsafe_local, kept.escalated) == (0.2, True, False)
    assert low.escalated and (low.quality, low.cost, low.latency) == (0.9, 1.1, 4.0)
    assert not unknown.escalated and flagged.escalated
    assert rows.select(*[simulate.gate_confidence(g).alias(g) for g in ("mean", "min", "low_frac", "none")]).first() == (0.9, 0.45, 0.9, None)
    with pytest.raises(ValueError):
        simulate.gate_confidence("other")
    assert simulate.summarize(simulate.simulate(rows.limit(0), F.lit(True))).first().n == 0


def test_policies(spark):
    rows = outcomes(spark, [row(i, p=p, lq=q, rq=0.92) for i, (q, p) in enumerate(((0.9, 0.9), (0.85, 0.8), (0.2, 0.3), (0.1, 0.2)))])
    points = sweep.sweep(rows)
    safe = sweep.max_unsafe(points, 0.0).first()
    assert 0.3 < safe.threshold <= 0.8 and safe.local_utilisation == 0.5
    assert sweep.quality_floor(points, 0.9).first().local_utilisation == 0.5
    assert sweep.quality_floor(points, 1.0).first().local_utilisation == 0.0
    assert points.count() == 6 and {p.threshold for p in points.collect()} >= {0.0, 1.000001}


def scored(spark, y, p):
    return spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p double")


def test_metrics(spark):
    best = scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert metrics.roc_auc(best).first()[0] == 1 and tuple(metrics.pr_auc(best).first()) == (1, 1) and metrics.brier(best).first().brier < 0.05
    assert metrics.roc_auc(scored(spark, [1, 1], [0.1, 0.2])).first()[0] is None
    assert metrics.roc_auc(scored(spark, [0, 1], [0.5, 0.5])).first()[0] == 0.5
    assert metrics.ece(scored(spark, [1] * 70 + [0] * 30, [0.7] * 100)).first()[0] == 0
    assert metrics.ece(scored(spark, [0] * 50, [0.99] * 50)).first()[0] > 0.9
    assert tuple(metrics.confusion(scored(spark, [1, 1, 0, 0], [0.9, 0.4, 0.9, 0.1])).first()) == (1, 1, 1, 1)
    same = spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit(0.5).alias("v"))
    assert tuple(metrics.bootstrap(same, "v", 1).first()) == (0.5, 0.5, 0.5)


def test_gate_advice(spark):
    rows = lambda pairs: spark.createDataFrame([(str(i), c, g) for i, (c, g) in enumerate(pairs)], "task_id string, conf double, grade double")
    found = usage.logprob_reco(rows([(0.5, 0.0), (0.6, 0.0), (0.85, 1.0), (0.9, 1.0), (0.95, 1.0), (0.99, 1.0)]), 0.9).first()
    assert tuple(found) == (0.85, 1.0, 4, 0)
    assert usage.logprob_reco(rows([(0.9, 0.0), (0.5, 1.0)]), 0.9).count() == 0
    assert usage.logprob_reco(rows([(0.9, 1.0)]), 0.9).first().threshold == 0.0


def test_recurrence(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    r = one(spark, a=workspace.next_due(at("2026-01-01 00:00:00"), at("2026-01-01 02:07:00"), F.lit(30)), gap=workspace.next_daily(at("2026-10-02 16:30:00"), at("2026-10-03 16:00:00"), "Australia/Sydney"), none=workspace.next_due(at("2026-01-01 00:00:00"), at("2026-01-01 02:07:00"), F.lit(0)))
    assert r.a == dt.datetime(2026, 1, 1, 2, 30) and r.gap == dt.datetime(2026, 10, 3, 16, 30) and r.none is None


def test_duplicates_and_splits(spark):
    rows = outcomes(spark, [row(0, group="g1", prompt="What is the capital of France?"), row(1, group="g2", prompt="what is the capital of france"), row(2, group="g1", prompt="What is the capital of France")])
    assert [tuple(r) for r in splits.exact_dup_conflicts(rows).collect()] == [("0", "1")]
    many = outcomes(spark, [row(i, group=f"g{i % 20}") for i in range(200)])
    assigned = splits.greedy_split(many)
    assert assigned.groupBy("group_id").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    sizes = {r.split: r.n for r in splits.split_stats(assigned).collect()}
    assert sizes == {"train": 140, "val": 30, "test": 30}
    assert splits.validate(many).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    prompts = []
    for _ in range(12):
        base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(30)) for _ in range(14)]
        for _ in range(4):
            words = list(base)
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = "other%d" % rng.randrange(9)
            prompts.append(" ".join(words))
    rows = outcomes(spark, [row(i, group=f"g{i % 7}", prompt=p) for i, p in enumerate([*prompts, "abc", "abc", ""])])
    sets = [{p[i : i + 5] for i in range(len(p) - 4)} if len(p) > 5 else {p} for p in [*prompts, "abc", "abc", ""]]
    alike = [[i != j and len(a & b) / len(a | b) >= 0.85 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = {str(i): sum(alike[i]) for i in range(len(sets)) if any(alike[i])}
    assert {r.task_id: r.links for r in splits.near_dup_pairs(rows).collect()} == want and want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "x long, y long")
    nodes = spark.range(60).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in splits.components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50 and got[40] == 40


def test_context_stops_at_the_first_that_overflows(spark):
    rows = [(1, 1, 0, "user", "a" * 10), (2, 1, 1, "assistant", "b" * 10), (3, 1, 2, "user", "c" * 500), (4, 1, 3, "assistant", "d"), (5, 1, 4, "user", "e"), (6, 1, 5, "assistant", "f"), (7, 1, 6, "user", "alone")]
    messages = spark.createDataFrame(rows, "id long, conversation_id long, turn long, role string, content string")
    assert [r.user_id for r in conversations.context_budget(messages, 100).collect()] == [5]
    assert conversations.memory_budget(messages, 40).first().ids == "7,6,5,4,2,1"


def test_split_of_many_groups_and_merged_groups(spark):
    rows = outcomes(spark, [row(i, group=f"g{i // 3}", prompt=f"prompt number {i}") for i in range(600)])
    parts = {r.task_id: r.split for r in splits.greedy_split(rows, fold=20).collect()}
    counts = [list(parts.values()).count(s) for s, _ in splits.RATIOS]
    assert len(parts) == 600 and all(abs(n - 600 * r) < 60 for n, (_, r) in zip(counts, splits.RATIOS))
    assert all(parts[str(i)] == parts[str(3 * (i // 3))] for i in range(600))
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest "
    near = [row(i, group=f"g{i % 4}", prompt=base * 3 + "word%d" % (i % 2)) for i in range(2)] + [row(9, group="z", prompt="something else entirely")] + [row(10 + i, group=f"h{i}", prompt="copy of this text, again") for i in range(1)]
    merged = {r.group_id: (r.root, r.links) for r in splits.near_dup_merge_report(outcomes(spark, near)).collect()}
    assert merged == {"g1": ("g0", 1)}
    got = {r.task_id: (r.group_id, r.split) for r in splits.make_splits(outcomes(spark, near)).collect()}
    assert got["0"] == got["1"] and got["0"][0] == "g0" and got["9"][0] == "z"
    with pytest.raises(ValueError, match="equal prompts"):
        splits.make_splits(outcomes(spark, [row(1, group="a", prompt="Same!"), row(2, group="b", prompt="same")]))


def test_scan_carries_from_partition_to_partition(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice((None, "a", "a", "a", "b", "c")), i, rng.choice((None, rng.randrange(9)))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = {r.i: (r.total, r.known, r.before, r.after) for r in running.scan(df, ["k"], [F.col("i")], total=("sum", F.col("v")), known=("last", F.col("v")), before=("lag", F.col("v")), after=("lead", F.col("v"))).collect()}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        for j, (_, i, _) in enumerate(own):
            seen = [v for _, _, v in own[: j + 1] if v is not None]
            assert got[i] == (sum(seen) if seen else None, seen[-1] if seen else None, own[j - 1][2] if j else None, own[j + 1][2] if j + 1 < len(own) else None)


def test_searches_by_runs(spark):
    rows = [(1, "Ärger über", "x"), (2, None, "aBcd"), (3, "ab", None), (4, "a%c", "_"), (5, "xaXcy", "ü")]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    index = indexes.run_index(df, "id", "title", "content")
    for term in ("", "a", "ÄRGER", "abc", "a_c", "b%d", "%", "über x", "xaxc"):
        want = {i for i, *texts in rows if any(t is not None and re.search(re.escape(term.lower()).replace("%", ".*").replace("_", "."), t.lower()) for t in texts)}
        assert {r.id for r in indexes.holding(df, index, "id", term, "title", "content").collect()} == want
    assert indexes.grams_of("ab%cdef_gh") == ["cde", "def"]


def test_relevant_items_in_blocks(spark):
    import random

    rng = random.Random(5)
    words = ["w%02d" % i for i in range(60)] + ["ab"]
    items = [(i, " ".join(rng.choice(words) for _ in range(12)), rng.randrange(5), rng.random() < 0.2) for i in range(90)]
    queries = [(i, " ".join(rng.choice(words) for _ in range(9))) for i in range(40)] + [(99, ""), (98, None)]
    bag = lambda t: {w for w in (t or "").split() if len(w) > 2}
    want = set()
    for qid, text_ in queries:
        scored = sorted(((len(bag(text_) & bag(t)) + 2 * p, u, i) for i, t, u, p in items), key=lambda x: (-x[0], -x[1], x[2]))
        want |= {(qid, i, n, place + 1) for place, (n, _, i) in enumerate([x for x in scored if x[0] > 0][:6])}
    frames = spark.createDataFrame(items, "id long, text string, updated long, pinned boolean"), spark.createDataFrame(queries, "qid long, text string")
    for block in (1024, 7, 1):
        assert {tuple(r) for r in conversations.relevant_topk(*frames, block=block).collect()} == want


def test_relevant_items_take_no_row_for_each_pair(spark, monkeypatch):
    items = spark.range(300).select("id", F.concat(F.lit("the "), F.format_string("w%04d", F.col("id"))).alias("text"), F.col("id").alias("updated"))
    queries = spark.range(20_000).select(F.col("id").alias("qid"), F.concat(F.lit("the "), F.format_string("w%04d", F.col("id") % 300)).alias("text"))
    best = conversations.relevant_topk(items, queries, 2)
    assert "explode(slots" not in best._jdf.queryExecution().toString()  # before, each pair of a query and an item was a row of an aggregate
    got = best.collect()
    assert len(got) == 40_000 and all((r.id, r.score) == ((r.qid % 300, 2) if r.place == 1 else (298 if r.qid % 300 == 299 else 299, 1)) for r in got)
    # a query in several rows counts all of its words; few words to a shard, so there are many
    monkeypatch.setattr(indexes, "SHARD_CELLS", 50)
    parts = spark.createDataFrame([(1, "the w0001"), (1, "the w0002"), (2, None), (3, "none")], "qid long, text string")
    assert {tuple(r) for r in conversations.relevant_topk(items, parts, 3, 4).collect()} == {(1, 2, 3, 1), (1, 1, 3, 2), (1, 299, 2, 3)}
    assert conversations.relevant_topk(items.limit(0), parts).count() == 0 and conversations.relevant_topk(items, parts.limit(0)).count() == 0


def test_contracts(spark):
    tools = {"labels": contracts.LABELS}
    cases = (
        ('{"answer": "hi"}', ("answer", None)), ('```\n{"answer": "hi"}\n```', ("answer", None)), ('{"answer": ""}', (None, "empty answer")), ("{", (None, "invalid JSON")),
        ('{"tool": "labels", "arguments": {"id": "a", "add": []}}', ("tool", None)), ('{"tool": "labels", "arguments": {"id": "a", "add": [true]}}', (None, "arguments.add[]: expected string")),
        ('{"tool": "labels", "arguments": {"id": "a", "add": [], "n": true}}', (None, "arguments.n: expected integer")), ('{"tool": "x", "arguments": {}}', (None, "neither an enabled tool nor an answer")),
    )
    for reply, (kind, error) in cases:
        r = one(spark, x=contracts.decision(F.lit(reply), tools)).x
        assert r.error == error and (kind is None or r[kind] is not None), reply
    with pytest.raises(ValueError, match="vocabulary"):
        contracts.violation(F.lit("{}"), {"type": "object", "pattern": "x"})
    r = one(spark, a=contracts.tool_call_text(F.lit("f"), F.lit('{"a": "`"}')), b=contracts.tool_call_text(F.lit("9"), F.lit("{}")), c=contracts.tool_call_text(F.lit("f"), F.lit("[]")), d=contracts.tool_call_text(F.lit("f"), F.lit(None)))
    assert r.a == '```f\n{"a":"\\u0060"}\n```' and r.b is None and r.c is None and r.d == "```f\n{}\n```"


def test_throttled_progress(spark):
    at = [0.0, 0.1, 0.31, 0.5, 0.62, 0.7, 2.0]
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(seconds=x), i) for k in (1, 2) for i, x in enumerate(at)]
    got = sorted(map(tuple, chatlog.throttled(spark.createDataFrame(rows, "run_id long, at timestamp, ord long").repartition(3)).collect()))
    assert got == [(k, i) for k in (1, 2) for i in (0, 2, 4, 6)]


def test_file_hashes(spark):
    import hashlib
    import os

    folder = "/root/testdata/sf0.001"
    if os.path.isdir(folder):
        got = {r.file: r.sha256 for r in contracts._file_hashes(spark, folder).collect()}
        assert got == {f"{t}.parquet": hashlib.sha256(open(f"{folder}/{t}.parquet", "rb").read()).hexdigest() for t in contracts.TABLES}


def test_character_runs_of_long_texts(spark):
    from routelens.operators import indexes

    rows = spark.createDataFrame([(1, "Aß😀c", "\nx"), (2, None, "ab"), (3, "", "lorem ipsum €" * 40_000)], "id long, title string, content string")
    began = time.time()
    got = {(r.id, r.gram) for r in indexes.run_index(rows, "id", "title", "content").collect()}
    assert {g for i, g in got if i == 1} == {"aß😀", "ß😀c"} and not any(i == 2 for i, _ in got) and {g for i, g in got if i == 3} == {("lorem ipsum €" * 2)[i : i + 3] for i in range(13)}
    assert time.time() - began < 40  # half a million characters: time with their square before
