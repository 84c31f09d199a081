import random

import corpus_pipeline
from routelens.llm import string_kernel
from tests.llm import test_dart_minhash, test_line_suffix_array, test_merge_suffix_array, test_string_kernel


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = test_string_kernel.corpus(400, 3)
    rows = [(i, t.replace(" ", "\n", 2)) for i, t, _ in base]
    passage = " ".join(t for i, t, x in test_string_kernel.corpus(12, 77) if not x)[:330]
    rows += [(1000 + i, f"{rows[1][1][: 20 * i]} {passage}\nline one here\nline two here\n{test_string_kernel.corpus(2, 90 + i)[1][1]} {test_string_kernel.corpus(2, 190 + i)[1][1]}") for i in range(6)]
    rows += [(2000, rows[2][1]), (2001, rows[2][1] + " more"), (2002, None), (2003, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in base], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outputs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        outputs.append(now)
        if k < 4:
            assert now.columns == docs.columns and now.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    kept = [{r.doc_id: r.text for r in o.collect()} for o in outputs[:4]]

    model = string_kernel.fit(*string_kernel.training_texts(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert kept[0] == {i: t for i, t in rows if model.score([t or ""])[0] < 0.5}
    assert {i for i, _, x in base if not x} <= set(kept[0]) and len(kept[0]) < len(rows)

    gone = test_line_suffix_array.brute(list(kept[0].items()), 2)
    assert kept[1] == {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in kept[0].items()}

    classes = test_dart_minhash.expected(list(kept[1].items()))
    assert set(kept[2]) == set(classes.values()) and all(kept[2][i] == kept[1][i] for i in kept[2])

    removed = {r[0]: r[2] for r in test_merge_suffix_array.brute(list(kept[2].items()), 200)}
    assert set(kept[3]) == set(kept[2])
    assert all(len((kept[2][i] or "").encode()) - len((kept[3][i] or "").encode()) == removed[i] for i in kept[3])
    assert sum(removed.values()) > 0

    pieces = outputs[4].collect()
    assert {r.doc_id for r in pieces} == set(kept[3])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in again.select("doc_id", "start", "length", "ids_crc32").collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_odd_tables(spark, tmp_path):
    """No rows; then repeated rows, nulls in all columns, and columns whose names the stages use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ", row string, key long, places long, node long, label string, h long, score double, weight long, bands string, shard int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    base = test_string_kernel.corpus(60, 3)
    rows = [(i, t, "en", "s", len(t)) for i, t, _ in base]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "no id here", None, None, None), (70, None, None, None, None), (71, "", None, None, 0), (70, rows[4][1], None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4, 0.5, 6, "z", None) for r in rows], kinds + clash)
    docs.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in base] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/b/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, f"{tmp_path}/b").write.parquet(f"{tmp_path}/b/{name}")
        now = spark.read.parquet(f"{tmp_path}/b/{name}")
        assert now.columns == docs.columns and now.where("doc_id IS NULL").count() >= 1
    found = [r.doc_id for r in now.collect()]
    assert found.count(3) == 1 and set(found) <= {r[0] for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, f"{tmp_path}/b")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(found)
