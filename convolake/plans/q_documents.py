"""Queries for document ingestion (4, 82-89) and sources/sinks (1-3, 5-9)."""

from __future__ import annotations

import html.entities
import io
import json
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from convolake.functions import lexicons as L
from convolake.functions.sizing import broadcast_if_small
from convolake.operators import documents as DOC
from convolake.operators import curation as C
from convolake.plans import views as V
from convolake.plans.catalog import query
from convolake.session import ensure_checkpoint_dir, small_batches, staged
from convolake.sources import columns as SC
from convolake.sources import files as SF
from convolake.sources import logs as SL

def _html_sql() -> str:
    """A relational twin of the parser: a page becomes numbered tokens; windows
    over them tell what lies in head, script or style, the last link target and
    whether a link is closed; references are looked up in the standard table."""
    q = lambda v: "'" + v.replace("'", "''") + "'"
    names = ", ".join(f"({q('&' + name)}, {q(text)})" for name, text in html.entities.html5.items())
    blocks = ", ".join(q(b) for b in "p div br ul ol tr table section article header footer nav blockquote pre body html".split())
    return f"""
WITH refs(ref, ch) AS (VALUES {names}),
lists AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|&#?[A-Za-z0-9]+;?|[^<&]+|[<&]') AS l FROM pages),
tokens AS (SELECT page_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM lists),
named AS (SELECT page_id, i, t, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, t LIKE '</%' AS closing FROM tokens),
placed AS (SELECT *, sum(CASE WHEN tag NOT IN ('head', 'script', 'style') THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER w AS depth,
    sum(CASE WHEN tag <> 'title' THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER w AS in_title,
    last_value(CASE WHEN tag = 'a' AND NOT closing THEN regexp_extract(t, 'href="([^"]*)"', 1) END IGNORE NULLS) OVER w AS href
  FROM named WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
links AS (SELECT page_id, i, NOT closing AND lead(closing) OVER (PARTITION BY page_id ORDER BY i) AS closed,
    closing AND NOT lag(closing) OVER (PARTITION BY page_id ORDER BY i) AS closes FROM named WHERE tag = 'a'),
decoded AS (SELECT p.*, coalesce(r.ch, p.t) AS plain, coalesce(l.closed, false) AS closed, coalesce(l.closes, false) AS closes
  FROM placed p LEFT JOIN refs r ON p.t = r.ref LEFT JOIN links l ON p.page_id = l.page_id AND p.i = l.i),
pieces AS (SELECT page_id, i, CASE WHEN t LIKE '<!--%' THEN ' ' WHEN t LIKE '<!%' THEN '' WHEN tag = '' THEN plain WHEN tag IN ('script', 'style', 'head') THEN ' '
    WHEN regexp_matches(tag, '^h[1-6]$') THEN chr(10) || CASE WHEN closing THEN '' ELSE repeat('#', CAST(tag[2] AS INTEGER)) || ' ' END
    WHEN closed THEN '[' WHEN closes THEN '](' || href || ')' WHEN tag = 'li' AND NOT closing THEN chr(10) || '  * '
    WHEN tag IN ('b', 'strong') THEN '**' WHEN tag IN ('i', 'em') THEN '_' WHEN tag IN ({blocks}) THEN chr(10) ELSE '' END AS piece,
    depth <= 0 AS shown, in_title > 0 AND tag = '' AS titled, plain FROM decoded),
joined AS (SELECT page_id, string_agg(piece, '' ORDER BY i) FILTER (WHERE shown) AS x,
    coalesce(string_agg(plain, '' ORDER BY i) FILTER (WHERE titled), '') AS title FROM pieces GROUP BY page_id)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text,
  trim(title) AS title FROM joined"""


@query("html_to_text", _html_sql())
def q_html(t):
    return DOC.html_to_text(t.pages, "html").select("page_id", "text", "title")


PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


@query("rows_to_text", "SELECT p_partkey, concat_ws(' | ', " + ", ".join(
    f"CASE WHEN coalesce(CAST({c} AS VARCHAR), '') <> '' THEN '{c}: ' || CAST({c} AS VARCHAR) END" for c in PART_COLS)
    + ") AS text FROM part")
def q_rows_to_text(t):
    return DOC.rows_to_text(t.part.select(*PART_COLS), PART_COLS).select("p_partkey", "text")


SRT_SQL = """caps AS (SELECT conv_id, turn, CAST(turn + 1 AS VARCHAR) || chr(10) || '00:00:0' || CAST(turn AS VARCHAR)
  || ',000 --> 00:00:0' || CAST(turn + 1 AS VARCHAR) || ',000' || chr(10) || text || chr(10) AS srt FROM conversations)"""


def captions(t):
    """one subtitle block per conversation turn ← conversations."""
    c = t.conversations
    return c.select("conv_id", "turn", F.concat((c.turn + 1).cast("string"), F.lit("\n00:00:0"), c.turn.cast("string"),
                                                F.lit(",000 --> 00:00:0"), (c.turn + 1).cast("string"), F.lit(",000\n"),
                                                c.text, F.lit("\n")).alias("srt"))


@query("captions_to_text", "WITH " + SRT_SQL + """
SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(srt, chr(10)),
    lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')),
  lambda s: s <> '' AND NOT regexp_matches(s, '^[0-9]+$') AND NOT contains(s, '-->')), ' ') AS caption_text
FROM caps""")
def q_captions(t):
    return DOC.captions_to_text(captions(t), "srt", "srt").select("conv_id", "turn", "caption_text")


@query("strip_markup", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('{{\\rtf1\\ansi ' || text || '\\par}}',
  '\\\\[a-z]+[0-9]* ?', '', 'g'), '[{{}}]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS plain_text FROM documents""")
def q_strip_markup(t):
    d = t.documents.select("doc_id", F.concat(F.lit("{\\rtf1\\ansi "), "text", F.lit("\\par}")).alias("rtf"))
    return DOC.strip_markup(d, "rtf", "rtf").select("doc_id", "plain_text")


@query("redact_assignments", """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s:
  CASE WHEN contains(s, '=') AND NOT starts_with(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '#')
       THEN split_part(s, '=', 1) || '=<redacted>' ELSE regexp_replace(s, '^\\s+|\\s+$', '', 'g') END), chr(10)) AS redacted
FROM documents""")
def q_redact(t):
    return DOC.redact_assignments(t.documents).select("doc_id", "redacted")


# --- binary files derived from the document table --------------------------

FORMATS = ["txt", "html", "eml", "docx", "xlsx", "pptx", "odt", "epub", "zip", "tgz", "srt", "csv", "mbox", "rtf",
           "env", "json", "png", "pdf"]


def _encode(doc_id: int, text: str, kind: str) -> bytes:
    lines = text.split("\n")
    esc = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if kind == "txt":
        return text.encode()
    if kind == "html":
        return f"<html><head><title>doc {doc_id}</title></head><body><p>{esc}</p></body></html>".encode()
    if kind in ("eml", "mbox"):
        msg = f"Subject: doc {doc_id}\nFrom: a@example.com\nTo: b@example.com\n\n{text}\n"
        return (f"From a@example.com\n{msg}From a@example.com\n{msg}" if kind == "mbox" else msg).encode()
    buf = io.BytesIO()
    if kind == "docx":
        body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in esc.split("\n"))
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("word/document.xml", '<w:document xmlns:w="urn:w"><w:body>' + body + "</w:body></w:document>")
    elif kind == "xlsx":
        rows = "".join(f'<row><c t="inlineStr"><is><t>{line}</t></is></c></row>' for line in esc.split("\n"))
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="urn:x"><sheets><sheet name="S1"/></sheets></workbook>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="urn:x"><sheetData>{rows}</sheetData></worksheet>')
    elif kind == "pptx":
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("ppt/slides/slide1.xml", f'<sld xmlns:a="urn:a"><a:txBody><a:p><a:t>{esc}</a:t></a:p>'
                                                '</a:txBody></sld>')
    elif kind == "odt":
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("content.xml", f'<office:document-content xmlns:office="urn:o"><p>{esc}</p>'
                                      "</office:document-content>")
    elif kind == "epub":
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("ch1.xhtml", f"<html><body><p>{esc}</p></body></html>")
    elif kind == "zip":
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("a.txt", text)
            z.writestr("inner.zip", b"skipped")
    elif kind == "tgz":
        with tarfile.open(fileobj=buf, mode="w:gz") as tf:
            data = text.encode()
            info = tarfile.TarInfo("notes.md")
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
    elif kind == "srt":
        return "".join(f"{i + 1}\n00:00:0{i},000 --> 00:00:0{i + 1},000\n{line}\n\n"
                       for i, line in enumerate(lines)).encode()
    elif kind == "csv":
        return ("line,text\n" + "".join(f'{i},"{line.replace(chr(34), "")}"\n' for i, line in enumerate(lines))).encode()
    elif kind == "rtf":
        return ("{\\rtf1\\ansi " + text + "}").encode()
    elif kind == "env":
        return f"# doc {doc_id}\nDOC_ID={doc_id}\nSECRET={text[:20]}\n".encode()
    elif kind == "json":
        return json.dumps({"doc_id": doc_id, "text": text}).encode()
    else:
        return b"\x89PNG\r\n" if kind == "png" else b"%PDF-1.4"
    return buf.getvalue()


def document_files(t):
    """(path, content) binary files encoding every document in one of
    several formats ← documents (Spark distributes the encoding)."""
    d = t.documents.select("doc_id", "text")

    def enc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in DOC.slices(batch, 1):
                ids, texts = (c.to_pylist() for c in part.columns)
                kinds = [FORMATS[i % len(FORMATS)] for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"/docs/doc_{i}.{kind}" for i, kind in zip(ids, kinds)], pa.string()),
                     pa.array([_encode(i, txt or "", kind) for i, txt, kind in zip(ids, texts, kinds)], pa.binary())], ["path", "content"])

    return d.mapInArrow(enc, "path string, content binary")


@query("expand_archives")
def q_expand(t):
    return DOC.expand_archives(document_files(t)).select("path", F.length("content").alias("bytes"), "archive_error")


@query("extract_text")
def q_extract_text(t):
    x = DOC.extract_text(DOC.expand_archives(document_files(t)))
    return x.select("path", "file_type", "source_type", "pages", F.length("text").alias("chars"),
                    F.size("errors").alias("n_errors"))


@query("mail_to_rows")
def q_mail(t):
    return DOC.mail_to_rows(document_files(t)).select("path", "message_no", "subject", F.length("body").alias("chars"))


@query("office_to_text")
def q_office(t):
    return DOC.office_to_text(document_files(t)).select("path", "file_type", "pages", F.length("text").alias("chars"))


# --- sources and sinks ----------------------------------------------------

def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/convolake-io/{name}-{uuid.uuid4().hex[:8]}"


FEEDBACK_DDL = ("timestamp timestamp_ntz, user_input string, agent_response string, skill_used string, "
                "rating int, correction string")


@query("read_event_log", """
SELECT 'good' AS kind, skill_used, CAST(NULL AS VARCHAR) AS raw_line FROM v_feedback_log
UNION ALL SELECT 'quarantined', NULL, 'not json: ' || role FROM conversations""")
def q_read_log(t):
    """feedback log written as JSON lines (plus raw non-JSON conversation
    lines) and read back: good rows and quarantined lines."""
    path = _scratch(t.spark, "feedback-log")
    V.feedback_log(t).drop("conv_id", "turn").write.json(path + "/good")
    t.conversations.select(F.concat(F.lit("not json: "), F.col("role")).alias("value")).write.text(path + "/bad")
    good, bad = SL.read_event_log(t.spark, path + "/*", FEEDBACK_DDL)
    return good.select(F.lit("good").alias("kind"), "skill_used", F.lit(None).cast("string").alias("raw_line")) \
        .unionByName(bad.select(F.lit("quarantined").alias("kind"), F.lit(None).cast("string").alias("skill_used"),
                                "raw_line"))


@query("write_training_set", """
SELECT skill_used AS skill, '20240101' AS as_of, user_input AS prompt FROM v_feedback_log
WHERE correction IS NOT NULL AND correction <> ''""")
def q_write_training(t):
    path = _scratch(t.spark, "training-set")
    pairs = C.correction_pairs(V.feedback_log(t))
    SL.write_training_set(pairs, path, "dpo", skill="skill", as_of="20240101")
    return t.spark.read.json(path).select("skill", F.col("as_of").cast("string").alias("as_of"), "prompt")


@query("read_part_files", """
SELECT skill_used AS skill, '20240101' AS as_of, user_input AS prompt FROM v_feedback_log
WHERE correction IS NOT NULL AND correction <> ''""")
def q_read_parts(t):
    path = _scratch(t.spark, "parts")
    pairs = C.correction_pairs(V.feedback_log(t))
    SL.write_training_set(pairs, path, "dpo", skill="skill", as_of="20240101")
    SL.write_training_set(pairs, path, "dpo", skill="skill", as_of="merged")
    return SL.read_part_files(t.spark, path).select("skill", F.col("as_of").cast("string").alias("as_of"), "prompt")


def _steps_sql():
    from convolake.plans.q_labels import step_sql
    return f"SELECT {step_sql('name')} AS step, name AS data FROM v_files"


@query("write_step_outputs", _steps_sql())
def q_write_steps(t):
    from convolake.operators.labels import classify_files
    path = _scratch(t.spark, "steps")
    f = classify_files(V.files(t)).select("step", F.col("name").alias("data"))
    SL.write_step_outputs(f, path)
    return t.spark.read.json(path).select(F.col("step").cast("int").alias("step"), "data")


@query("read_adapter_metadata", """
SELECT 'adapter_name=' || adapter_name AS adapter_name,
  CASE WHEN status = 'completed' THEN 'completed' ELSE 'unknown' END AS status,
  CASE WHEN status = 'completed' THEN skill_id END AS skill_id
FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY coalesce(final_loss, 999) ASC, created_at DESC, id ASC)
      AS rn FROM v_adapters) WHERE rn = 1""")
def q_adapter_meta(t):
    """adapter folders ← the registry's best adapter per skill (op 65): every
    folder gets a weights file, completed adapters also a metadata file."""
    from convolake.operators.adapters import best_adapter
    root = _scratch(t.spark, "adapters")
    a = best_adapter(V.adapters(t))
    a.select("adapter_name", F.lit("weights").alias("value")).write.partitionBy("adapter_name").text(root)
    (a.where(F.col("status") == "completed").select("adapter_name", "skill_id", "final_loss", "status")
     .write.mode("append").partitionBy("adapter_name").json(root))
    out = SF.read_adapter_metadata(t.spark, root, "*/*.json")
    return out.select("adapter_name", "status", "skill_id")


@query("scan_documents", """
SELECT 'd' || CAST(doc_id % 3 AS VARCHAR) AS bucket, 'txt' AS ext, 'text' AS category,
  CAST(sum(strlen(text) + 1) AS BIGINT) AS length
FROM documents GROUP BY 1""")
def q_scan(t):
    """document texts written into one folder per bucket, where every task adds
    a file of its own, and scanned back with the binaryFile source."""
    root = _scratch(t.spark, "docs")
    d = t.documents.select(F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("bucket"), "text")
    d.write.partitionBy("bucket").text(root)
    files = SF.scan_documents(t.spark, root).withColumn("bucket", F.regexp_extract("path", r"bucket=([^/]+)/", 1))
    return files.groupBy("bucket", "ext", "category").agg(F.sum("length").alias("length"))


@query("decode_json_columns", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 1 AS n_keys FROM events""")
def q_decode_json(t):
    x = SC.decode_json_columns(t.events, {"props": "map<string,int>"})
    return x.select("event_id", F.col("props")["k"].alias("k"), F.size("props").alias("n_keys"))


@query("table_profile", """
SELECT 'interactions' AS table_name, count(*) AS row_count, count(DISTINCT skill_id) AS distinct_skills FROM v_interactions
UNION ALL SELECT 'extracted', count(*), count(DISTINCT skill_id) FROM v_extracted
UNION ALL SELECT 'adapters', count(*), count(DISTINCT skill_id) FROM v_adapters
UNION ALL SELECT 'training_data', count(*), count(DISTINCT skill_id) FROM v_training_data""")
def q_profile(t):
    return SC.table_profile({"interactions": V.interactions(t), "extracted": V.extracted(t),
                             "adapters": V.adapters(t), "training_data": V.training_data(t)})


@query("types_by_category", """
WITH ft AS (SELECT * FROM (VALUES """ + ", ".join(f"('{e}', '{c}')" for e, c, _ in L.FILE_TYPES) + """) AS t(ext, category)),
f AS (SELECT lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1)) AS ext FROM v_files),
j AS (SELECT f.ext, ft.category FROM f JOIN ft ON f.ext = ft.ext)
SELECT category, list_sort(list(DISTINCT ext)) AS types, count(*) AS files, (SELECT count(*) FROM j) AS total_files
FROM j GROUP BY category""")
def q_types_by_category(t):
    f = V.files(t).select(F.lower(F.regexp_extract("name", r"\.([^./\\]+)$", 1)).alias("ext"))
    ft = SF.file_types(t.spark).select("ext", "category")
    return DOC.types_by_category(f.join(broadcast_if_small(ft, "file types"), "ext"), "ext", "category")


@query("ingest_summary")
def q_ingest_summary(t):
    from convolake.operators.items import chunk_text
    # parsed files feed two aggregates: decode once, write the result to the
    # shared folder (a checkpoint would decode twice) and read it twice
    with small_batches(t.spark):
        parsed = staged(DOC.extract_text(DOC.expand_archives(document_files(t))), "parsed")
    items = chunk_text(parsed.where(DOC.ingested(parsed)), "text", 2000, "\n")
    summary, _ = DOC.ingest_summary(parsed, items)
    return summary
