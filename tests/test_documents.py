import io
import zipfile

import pytest
from pyspark.sql import functions as F

from routelens.operators import documents


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_office_documents(spark):
    rows = [
        ("a.docx", packed(word__document_xml='<d xmlns:w="u"><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></d>')),
        ("b.pptx", packed(ppt__slides__slide1_xml='<d xmlns:a="u"><a:p><a:r><a:t>He</a:t></a:r><a:r><a:t>ad</a:t></a:r></a:p><a:p><a:t>line</a:t></a:p></d>', ppt__slides__slide10_xml='<d/>', ppt__slides__slide2_xml='<d><p><t>x</t></p></d>')),
        ("c.xlsx", packed(xl__sharedStrings_xml="<s><si><t>word</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row><c r="A2" t="inlineStr"><is><t>in &amp; out</t></is></c><c r="C2"/></row></w>')),
        ("d.txt", "café".encode()), ("e.txt", b"\xff\xfe\xff"), ("f.docx", b"no archive"), ("g.docx", packed(other_xml="<x/>")),
    ]
    got = {r.path: (r.text, r.error) for r in documents.doc_extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"] == ("One two\nthree", None) and got["b.pptx"] == ("slide 1\nHead\nline\nslide 2\nx", None)
    assert got["c.xlsx"] == ("sheet 1\nA1: word\tB1: 7\nA2: in & out\tC2: ", None) and got["d.txt"] == ("café", None)
    assert all(got[p][0] is None and got[p][1] for p in ("e.txt", "f.docx", "g.docx"))


def test_limits_of_documents(spark):
    big = packed(word__document_xml="<d><p><t>" + "x" * 500 + "</t></p></d>")
    rows = spark.createDataFrame([("a.docx", big)], "path string, content binary")
    assert "more than" in documents.doc_extract(rows, unpacked=100).first().error and documents.doc_extract(rows).first().text == "x" * 500
    assert documents.doc_extract(rows.limit(0)).count() == 0


def test_documents_are_read_once(spark):
    strings = "<s>" + "".join(f"<si><t>s{i}</t></si>" for i in range(3)) + "</s>"
    sheet = '<w><row/><row><c r="A2" t="s"><v>{}</v></c><c r="B2" t="s"><v>9</v></c></row></w>'
    rows = [("a.XLSX", packed(xl__worksheets__sheet99999999999_xml=sheet.format(2), xl__worksheets__sheet2_xml=sheet.format(99999999999), xl__sharedStrings_xml=strings, xl__worksheets__sheet1_xml="<w><row/></w>")), ("b.docx", packed(word__document_xml="<d/>"))]
    found = documents.doc_extract(spark.createDataFrame(rows, "path string, content binary"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan  # before, each document was read twice, and each line was a row of shuffles
    assert {tuple(r) for r in found.collect()} == {("a.XLSX", "sheet 2\nA2: \tB2: \nsheet 99999999999\nA2: s2\tB2: ", None), ("b.docx", "", None)}


def test_export_formats(spark):
    x = spark.range(1).select(documents.export_item(F.lit("A b/c"), F.lit("<x>"), "html").alias("h"), documents.export_item(F.lit("A b/c"), F.lit("<x>"), "md").alias("m")).first()
    assert x.h.name == "A_b_c.html" and "<pre>&lt;x&gt;</pre>" in x.h.body and (x.m.name, x.m.body) == ("A_b_c.md", "<x>")
    with pytest.raises(ValueError):
        documents.export_item(F.lit("a"), F.lit("b"), "exe")
