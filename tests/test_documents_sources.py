"""Decoders, document routing and file sources on small fixtures."""

import io
import os
import tarfile
import tempfile
import zipfile

from pyspark.sql import functions as F

from convolake.operators import decoders as D
from convolake.operators import documents as DOC
from convolake.plans.q_documents import _encode
from convolake.sources import columns as SC
from convolake.sources import files as SF
from convolake.sources import logs as SL


def files_df(spark, items):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in items], "path string, content binary")


def test_op83_html(spark):
    html = ("<html><head><title>T &amp; Co</title><style>p{}</style><script>var x='<p>';</script></head>"
            "<body><p>Hello&nbsp;world</p><div>Line <b>two</b></div></body></html>")
    r = DOC.html_to_text(spark.createDataFrame([(html,)], "html string")).collect()[0]
    assert r.title == "T & Co" and r.text == "Hello world\nLine **two**"
    md = ("<body><h2>Title</h2><ul><li><a href=\"/x\">X</a></li><li><em>y</em></li></ul></body>")
    r2 = DOC.html_to_text(spark.createDataFrame([(md,)], "html string")).collect()[0]
    assert r2.text == "## Title\n* [X](/x)\n* _y_"


def test_op84_rows_to_text(spark):
    df = spark.createDataFrame([("1", "", "2")], "a string, b string, c string")
    assert DOC.rows_to_text(df).collect()[0].text == "a: 1 | c: 2"


def test_op85_captions(spark):
    srt = "1\n00:00 --> 00:01\nHello\n\n2\n00:01 --> 00:02\nthere\n"
    ass = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\i1}Hi, you{\\i0}\nComment: x"
    df = spark.createDataFrame([(srt, ass)], "srt string, ass string")
    r = DOC.captions_to_text(DOC.captions_to_text(df, "srt", "srt", "a"), "ass", "ass", "b").collect()[0]
    assert r.a == "Hello there" and r.b == "Hi, you"


def test_op86_rtf_xml(spark):
    df = spark.createDataFrame([("{\\rtf1\\ansi Hello \\b world\\b0}", "<a><b>x</b><c> y </c></a>")], "r string, x string")
    r = DOC.strip_markup(DOC.strip_markup(DOC.strip_markup(df, "r", "rtf", "o1"), "x", "xml", "o2"), "x", "svg",
                         "o3").collect()[0]
    assert r.o1 == "Hello world" and r.o2 == "x y" and r.o3 == "x\ny"


def test_op87_redact(spark):
    df = spark.createDataFrame([("KEY=abc\n# K=v\nplain",)], "text string")
    assert DOC.redact_assignments(df).collect()[0].redacted == "KEY=<redacted>\n# K=v\nplain"


def test_roundtrip_binary_formats():
    text = "first line\nsecond line"
    assert "second line" in D.docx_text(_encode(1, text, "docx"))[0]
    assert D.xlsx_text(_encode(1, text, "xlsx"))[0].startswith("[Sheet: S1]")
    assert "[Slide 1]" in D.pptx_text(_encode(1, text, "pptx"))[0]
    assert "first line" in D.odf_text(_encode(1, text, "odt"))[0]
    assert D.epub_text(_encode(1, text, "epub"))[1] == 1
    assert len(D.mail_messages(_encode(1, text, "mbox"), True)) == 2
    assert D.mail_messages(_encode(1, text, "eml"), False)[0]["subject"] == "doc 1"
    assert D.csv_text(b"a,b\n1,\n")[0] == "a: 1"


def test_op4_expand_archives(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", "A")
        z.writestr("nested.zip", b"x")
        z.writestr("dir/", "")
    tb = io.BytesIO()
    with tarfile.open(fileobj=tb, mode="w:gz") as t:
        info = tarfile.TarInfo("b.md")
        info.size = 1
        t.addfile(info, io.BytesIO(b"B"))
    df = files_df(spark, [("/x/a.zip", buf.getvalue()), ("/x/b.tgz", tb.getvalue()), ("/x/c.txt", b"C"),
                          ("/x/bad.zip", b"not a zip"), ("/x/d.gz", b"\x1f\x8b")])
    out = {r.path: r.archive_error for r in DOC.expand_archives(df).collect()}
    assert set(out) == {"/x/a.zip!/a.txt", "/x/b.tgz!/b.md", "/x/c.txt", "/x/bad.zip", "/x/d.gz"}
    assert out["/x/bad.zip"].startswith("Parse error")
    parsed = {r.path: r for r in DOC.extract_text(DOC.expand_archives(df)).collect()}
    assert parsed["/x/d.gz"].metadata == {"archive": "true"} and parsed["/x/a.zip!/a.txt"].text == "A"


def test_op82_extract_text_routes_and_never_fails(spark):
    df = files_df(spark, [("/d/a.txt", b"plain"), ("/d/b.html", b"<title>t</title><p>x</p>"),
                          ("/d/bad.txt", b"ok \xff\xfe text"),
                          ("/d/c.docx", b"broken"), ("/d/d.png", b"\x89PNG"), ("/d/e.pdf", b"%PDF"),
                          ("/d/f.weird", b"?"), ("/d/g.env", b"A=1\n#c"), ("/d/h.py", b"print(1)"),
                          ("/d/i.json", b'{"a": [1, 2]}'), ("/d/j.jsonl", b'{"a": 1}\n\n{"b": 2}\n'),
                          ("/d/k.json", b"{broken")])
    out = {r.path: r for r in DOC.extract_text(df).collect()}
    assert out["/d/a.txt"].text == "plain" and out["/d/b.html"].metadata["title"] == "t"
    assert out["/d/bad.txt"].text == "ok  text"
    assert out["/d/c.docx"].errors and out["/d/d.png"].metadata == {"needs_ocr": "true"}
    assert out["/d/e.pdf"].errors == ["Decoder not available: pdf"]
    assert out["/d/f.weird"].errors == ["Unsupported: weird"]
    assert out["/d/g.env"].text == "A=<redacted>\n#c" and out["/d/h.py"].metadata == {"language": "py"}
    assert out["/d/i.json"].text == '{\n  "a": [\n    1,\n    2\n  ]\n}'
    assert out["/d/j.jsonl"].metadata == {"format": "jsonl", "count": "2"} and out["/d/k.json"].errors


def test_op88_mail_rows(spark):
    df = files_df(spark, [("/m/a.mbox", _encode(3, "body", "mbox")), ("/m/b.eml", _encode(4, "hi", "eml"))])
    out = DOC.mail_to_rows(df).collect()
    assert len(out) == 3 and {r.subject for r in out} == {"doc 3", "doc 4"}


def test_op89_office(spark):
    df = files_df(spark, [("/o/a.docx", _encode(1, "x\ny", "docx")), ("/o/b.csv", b"k,v\n1,2\n")])
    out = {r.file_type: r.text for r in DOC.office_to_text(df).collect()}
    assert out == {"docx": "x\n\ny", "csv": "k: 1 | v: 2"}


def test_op1_quarantine(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        f.write('{"user_input": "a", "rating": 5}\nnot json\n{"user_input": "b", "rating": 2}\n')
    good, bad = SL.read_event_log(spark, d, "user_input string, rating int")
    assert good.count() == 2 and [r.raw_line for r in bad.collect()] == ["not json"]


def test_op2_op7_parts_exclude_merged(spark):
    d = tempfile.mkdtemp(dir="/tmp") + "/ds"
    df = spark.createDataFrame([("p", "c", "r", "s1"), ("p2", "c", "r", "s2")], "prompt string, chosen string, "
                               "rejected string, skill string")
    SL.write_training_set(df, d, "dpo", as_of="20240101")
    SL.write_training_set(df, d, "dpo", as_of="merged")
    assert SL.read_part_files(spark, d).count() == 2
    assert SL.read_part_files(spark, d, skill="s1").count() == 1


def test_op8_step_outputs(spark):
    d = tempfile.mkdtemp(dir="/tmp") + "/steps"
    df = spark.createDataFrame([(1, "a"), (2, None)], "step int, data string")
    SL.write_step_outputs(df, d)
    assert [x for x in sorted(os.listdir(d)) if x.startswith("step=")] == ["step=1"]


def test_op3_op5_scan_and_metadata(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    os.makedirs(d + "/docs/sub")
    open(d + "/docs/sub/a.md", "w").write("x")
    open(d + "/docs/b.bin", "w").write("x")
    assert [r.ext for r in SF.scan_documents(spark, d + "/docs").collect()] == ["md"]
    for name, meta in (("ad1", '{"status": "completed", "final_loss": 0.2}'), ("ad2", None)):
        os.makedirs(f"{d}/ads/{name}")
        open(f"{d}/ads/{name}/adapter.bin", "w").write("w")
        if meta:
            open(f"{d}/ads/{name}/training_metadata.json", "w").write(meta)
    got = {r.adapter_name: r.status for r in SF.read_adapter_metadata(spark, d + "/ads").collect()}
    assert got == {"ad1": "completed", "ad2": "unknown"}


def test_op6_op9(spark):
    df = spark.createDataFrame([(1, '["a"]'), (2, None), (3, "")], "id int, tags string")
    assert [r.tags for r in SC.decode_json_columns(df, {"tags": "array<string>"}).orderBy("id").collect()] == [
        ["a"], [], []]
    prof = SC.table_profile({"t": spark.createDataFrame([("a",), ("a",), ("b",)], "skill_id string")}).collect()[0]
    assert (prof.row_count, prof.distinct_skills) == (3, 2)


def test_op58_op62(spark):
    parsed = spark.createDataFrame([("a", "pdf", "document", []), ("b", "txt", "text", []),
                                    ("c", "md", "text", ["boom"])],
                                   "path string, file_type string, source_type string, errors array<string>")
    t = {r.source_type: (r.types, r.files, r.total_files) for r in DOC.types_by_category(parsed).collect()}
    assert t == {"document": (["pdf"], 1, 3), "text": (["md", "txt"], 2, 3)}
    items = spark.createDataFrame([(1,), (2,)], "x int")
    summary, errors = DOC.ingest_summary(parsed, items)
    s = summary.collect()[0]
    assert (s.files_total, s.files_ok, s.files_failed, s.items_extracted) == (3, 2, 1, 2)
    assert [tuple(r) for r in errors.collect()] == [("c", "boom")]


def test_schemas_parse_and_variant(spark):
    from convolake.schemas import DDL, schema
    assert all(len(schema(n).fields) > 3 for n in DDL)
    df = spark.createDataFrame([('{"a": {"b": 2}}',), ("not json",)], "meta string")
    out = SC.decode_json_columns(df, {"meta": "variant"})
    vals = [r.v for r in out.select(F.expr("variant_get(meta, '$.a.b', 'int')").alias("v")).collect()]
    assert vals == [2, None]
