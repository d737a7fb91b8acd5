"""Document ingestion as Spark jobs.

Text formats are decoded with column expressions (``decode`` +
``regexp_replace`` chains, JVM only).  Zipped office formats, e-mail and
archives go through ``mapInPandas`` with the stdlib decoders of
``operators/decoders.py``; one file is one row, so Spark spreads the files
over tasks and no decoder ever sees more than one file.  A file that fails
to decode yields an error entry, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions.columns import strip
from convolake.functions.html import page_column, page_text
from convolake.functions import lexicons as L
from convolake.operators import decoders as D

ALLOWED_EXT = {e for e, _, _ in L.FILE_TYPES}
ARCHIVE_EXT = ("zip", "tar", "gz", "tgz")

# How each extension is decoded (our routing; media need OCR / speech models
# that are not part of this engine, some formats need absent native libraries).
HANDLERS: dict[str, str] = {}
for _ext, _cat, _ in L.FILE_TYPES:
    if _cat in ("text", "code") or _ext in ("doc", "ini", "css", "scss", "less", "yaml", "yml", "toml"):
        HANDLERS[_ext] = "text"
    elif _cat == "image" and _ext != "svg":
        HANDLERS[_ext] = "ocr"
    elif _cat in ("audio", "video"):
        HANDLERS[_ext] = "transcribe"
HANDLERS.update({"rtf": "rtf", "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "xml": "xml",
                 "svg": "xml", "env": "env", "html": "html", "htm": "html", "xhtml": "html", "srt": "srt",
                 "vtt": "srt", "ass": "ass", "ssa": "ass", "eml": "eml", "mbox": "mbox", "docx": "docx",
                 "xlsx": "xlsx", "pptx": "pptx", "odt": "odf", "ods": "odf", "odp": "odf", "pages": "odf",
                 "key": "odf", "epub": "epub", "zip": "archive", "tar": "archive", "gz": "archive",
                 "tgz": "archive"})
TEXT_HANDLERS = ("text", "rtf", "xml", "env", "html", "srt", "ass")
PY_HANDLERS = ("csv", "tsv", "json", "jsonl", "eml", "mbox", "docx", "xlsx", "pptx", "odf", "epub")

PARSED_SCHEMA = ("path string, text string, pages int, errors array<string>, metadata map<string,string>, "
                 "source_type string, file_type string")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_strip = strip


# --- 83-87: column-expression text transforms ----------------------------

def html_text(c) -> Column:
    """HTML → Markdown-flavoured text: head, script, style and comments
    dropped; headings become ``#`` lines, links ``[text](href)``, list items
    ``* ``, bold ``**``, italics ``_``; other block tags become line breaks,
    remaining tags vanish, character references are decoded and blank runs
    squeezed (no line wrapping).  A link that is never closed is plain text."""
    return page_column(_c(c))["text"]


def html_title(c) -> Column:
    return page_column(_c(c))["title"]


def html_to_text(df: DataFrame, col: str = "html", out: str = "text") -> DataFrame:
    """Op 83: text and title of HTML pages."""
    return (df.withColumn("__page", page_column(F.col(col)))
            .withColumn(out, F.col("__page.text")).withColumn("title", F.col("__page.title")).drop("__page"))


def rows_to_text(df: DataFrame, cols: list[str] | None = None, out: str = "text") -> DataFrame:
    """Op 84: each record as ``k: v | k: v``; null and empty values dropped."""
    cols = cols or df.columns
    parts = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "",
                    F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cols]
    return df.withColumn(out, F.concat_ws(" | ", *parts))


def srt_text(c) -> Column:
    """SRT/VTT: drop empty lines, counters and timing lines; join by space."""
    lines = F.transform(F.split(_c(c), "\n"), lambda s: _strip(s))
    keep = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^[0-9]+$") & ~s.contains("-->"))
    return F.array_join(keep, " ")


def ass_text(c) -> Column:
    """ASS/SSA: the 10th comma field of ``Dialogue:`` lines without ``{…}``."""
    lines = F.filter(F.split(_c(c), "\n"), lambda s: s.startswith("Dialogue:"))
    texts = F.transform(lines, lambda s: _strip(F.regexp_replace(
        F.regexp_extract(s, r"^(?:[^,]*,){9}(.*)$", 1), r"\{[^}]+\}", "")))
    return F.array_join(F.filter(texts, lambda s: s != ""), " ")


def captions_to_text(df: DataFrame, col: str = "text", fmt: str = "srt", out: str = "caption_text") -> DataFrame:
    """Op 85: subtitle files to plain text (``fmt`` srt/vtt or ass/ssa)."""
    f = ass_text(col) if fmt in ("ass", "ssa") else srt_text(col)
    return df.withColumn(out, f)


def rtf_text(c) -> Column:
    return _strip(F.regexp_replace(F.regexp_replace(_c(c), r"\\[a-z]+[0-9]* ?", ""), r"[{}]", ""))


# References decoded in XML text (&amp; last).
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def _entities(x: Column) -> Column:
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def xml_text(c) -> Column:
    """XML text content: every text node concatenated in document order
    (markup removed, no separators added), entities decoded, stripped."""
    x = F.regexp_replace(_c(c), r"(?s)<\?.*?\?>|<!--.*?-->|<!\[CDATA\[|\]\]>", "")
    return _strip(_entities(F.regexp_replace(x, r"<[^>]*>", "")))


def svg_text(c) -> Column:
    """SVG text: one line per non-blank text node."""
    x = F.regexp_replace(_c(c), r"(?s)<\?.*?\?>|<!--.*?-->", "")
    nodes = F.transform(F.split(F.regexp_replace(x, r"<[^>]*>", "\n"), "\n"), lambda s: _strip(s))
    return _entities(F.array_join(F.filter(nodes, lambda s: s != ""), "\n"))


def strip_markup(df: DataFrame, col: str = "text", fmt: str = "rtf", out: str = "plain_text") -> DataFrame:
    """Op 86: RTF control words and braces (``rtf``), XML text content
    (``xml``: concatenated text nodes) or SVG text (``svg``: one line per
    text node)."""
    f = {"rtf": rtf_text, "xml": xml_text, "svg": svg_text}[fmt]
    return df.withColumn(out, f(col))


def redact_text(c) -> Column:
    lines = F.split(_c(c), "\n")
    red = F.transform(lines, lambda s: F.when(s.contains("=") & ~_strip(s).startswith("#"),
                                              F.concat(F.substring_index(s, "=", 1), F.lit("=<redacted>")))
                      .otherwise(_strip(s)))
    return F.array_join(red, "\n")


def redact_assignments(df: DataFrame, col: str = "text", out: str = "redacted") -> DataFrame:
    """Op 87: ``KEY=value`` lines become ``KEY=<redacted>``; comments kept."""
    return df.withColumn(out, redact_text(col))


# --- 4, 82, 88, 89: binary decoders through mapInPandas ---------------------

def _ext_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


#: bytes of files or texts that a Python worker turns into values at once
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """Views of ``batch`` with about ``SLICE_BYTES`` in ``columns`` each, a row at least."""
    sizes = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns]
    begin = held = 0
    for k, size in enumerate(sum(sizes).tolist() if batch.num_rows else []):
        held += size
        if held >= SLICE_BYTES or k + 1 == batch.num_rows:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0


def expand_archives(files: DataFrame, flush_bytes: int = SLICE_BYTES) -> DataFrame:
    """Op 4: one row per supported member of zip / tar / tar.gz files
    (nested archives skipped for zip); other files pass through.

    Member paths are ``archive!/member``.  Members are emitted in batches of
    at most ``flush_bytes`` so a large archive never materialises as one
    pandas frame, and the members are repartitioned by path afterwards so
    the (CPU-heavy) decoding of one big archive spreads over many tasks.
    """
    ext = _ext_of(F.col("path"))
    is_arc = ext.isin(*ARCHIVE_EXT)
    plain = files.where(~is_arc).select("path", "content")
    arcs = files.where(is_arc).select("path", "content")
    allowed = ALLOWED_EXT
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("archive_error", pa.string())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for p, b in zip(batch.column(0), batch.column(1)):
                p = p.as_py()
                try:
                    found = 0
                    for name, data in D.archive_members(p, b.as_py(), allowed):
                        rows.append((f"{p}!/{name}", data, None))
                        found += 1
                        size += len(data)
                        if size >= flush_bytes:
                            yield _record_batch(rows, schema)
                            rows, size = [], 0
                    if not found:  # keep the archive itself so no input file disappears
                        rows.append((p, None, None))
                except Exception as e:  # noqa: BLE001 - one bad archive must not fail the job
                    rows.append((p, None, f"Parse error: {e}"))
        if rows:
            yield _record_batch(rows, schema)

    members = arcs.mapInArrow(expand, "path string, content binary, archive_error string").repartition("path")
    return plain.withColumn("archive_error", F.lit(None).cast("string")).unionByName(members)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _decode_one(raw: bytes, h: str) -> tuple[str, int, list, dict]:
    """Decode one binary file; errors are returned as data."""
    try:
        if h in ("json", "jsonl"):
            text, meta = D.json_text(raw) if h == "json" else D.jsonl_text(raw)
            return text, 1, [], meta
        if h in ("eml", "mbox"):
            msgs = D.mail_messages(raw, h == "mbox")
            if h == "eml":
                m = msgs[0]
                text = (f"Subject: {m['subject']}\nFrom: {m['from']}\nTo: {m['to']}\nDate: {m['date']}"
                        f"\n\n{m['body']}")
                return text, 1, [], {"subject": m["subject"], "from": m["from"]}
            text = "\n\n---\n\n".join(f"[Email: {m['subject'] or 'No Subject'}]\n{m['body']}" for m in msgs)
            return text, len(msgs), [], {"email_count": str(len(msgs))}
        text, pages = D.BINARY_DECODERS[h](raw)
        return text, int(pages), [], {}
    except Exception as e:  # noqa: BLE001 - errors are data, not job failures
        return "", 0, [f"Parse error: {e}"], {}


_PARSED = pa.schema([("path", pa.string()), ("text", pa.string()), ("pages", pa.int32()), ("errors", pa.list_(pa.string())),
                     ("metadata", pa.map_(pa.string(), pa.string())), ("source_type", pa.string()), ("file_type", pa.string())])


def _pairs(metadata: dict | None) -> list | None:
    return None if metadata is None else list(metadata.items())


def _py_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content, handler, source_type, file_type → parsed files."""
    for batch in batches:
        for part in slices(batch, 1):
            out = []
            for p, b, h, cat, ext in zip(*(c.to_pylist() for c in part.columns)):
                text, pages, errors, meta = _decode_one(b if b is not None else b"", h)
                out.append((p, text, pages, errors, _pairs(meta), cat, ext))
            yield _record_batch(out, _PARSED)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decodes the binary formats and HTML; all else comes decoded and passes."""
    for batch in batches:
        for part in slices(batch, 0, 3):
            out = []
            for b, h, p, text, pages, errors, meta, cat, ext in zip(*(c.to_pylist() for c in part.columns)):
                if h == "html":
                    text, title = page_text(text) if text is not None else ("", None)
                    meta = [("title", title)]
                elif h in PY_HANDLERS:
                    text, pages, errors, meta = _decode_one(b, h) if b is not None else (None, None, None, None)
                    meta = _pairs(meta)
                out.append((p, text, pages, errors, meta, cat, ext))
            yield _record_batch(out, _PARSED)


def office_to_text(files: DataFrame) -> DataFrame:
    """Op 89: zipped office formats (docx, xlsx, pptx, odt/ods/odp, epub)
    and the other Python-decoded types (csv/tsv, json/jsonl, e-mail) → text per file via stdlib decoders."""
    x = _route(files).where(F.col("handler").isin(*PY_HANDLERS))
    return x.select("path", "content", "handler", "source_type", "file_type").mapInArrow(_py_decode, PARSED_SCHEMA)


def mail_to_rows(files: DataFrame) -> DataFrame:
    """Op 88: eml / mbox files → one row per message (subject, from, to,
    date, first text/plain body)."""
    x = _route(files).where(F.col("handler").isin("eml", "mbox")).select("path", "content", "handler")

    cols = ["path", "message_no", "subject", "from", "to", "date", "body", "error"]

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for p, b, h in zip(pdf["path"], pdf["content"], pdf["handler"]):
                try:
                    for i, m in enumerate(D.mail_messages(bytes(b), h == "mbox")):
                        out.append((p, i, m["subject"], m["from"], m["to"], m["date"], m["body"], None))
                        if len(out) >= 10_000:  # a large mailbox is emitted in bounded batches
                            yield pd.DataFrame(out, columns=cols)
                            out = []
                except Exception as e:  # noqa: BLE001
                    out.append((p, 0, None, None, None, None, None, f"Parse error: {e}"))
            if out:
                yield pd.DataFrame(out, columns=cols)

    return x.mapInPandas(rows, "path string, message_no int, subject string, from string, to string, "
                               "date string, body string, error string")


def _route(files: DataFrame) -> DataFrame:
    ext = F.coalesce(F.col("ext"), _ext_of(F.col("path"))) if "ext" in files.columns else _ext_of(F.col("path"))
    cat = None
    for e, c, _ in L.FILE_TYPES:
        cat = F.when(ext == e, c) if cat is None else cat.when(ext == e, c)
    handler = None
    for e, h in HANDLERS.items():
        handler = F.when(ext == e, h) if handler is None else handler.when(ext == e, h)
    failed = F.col("archive_error") if "archive_error" in files.columns else F.lit(None).cast("string")
    return files.select("path", "content", ext.alias("file_type"), cat.alias("source_type"),
                        F.coalesce(handler, F.lit("unsupported")).alias("handler"), failed.alias("archive_error"))


def extract_text(files: DataFrame) -> DataFrame:
    """Op 82: route every file by extension and return text, pages,
    errors, metadata, source_type and file_type; never fails the job on one
    file.

    One pass over the files: text formats are decoded by column expressions
    in the JVM, media and unsupported types get their metadata / error entry
    there as well; one Python step decodes the binary formats (only their
    content goes there) and HTML, a few megabytes at a time, and hands the
    other rows through.
    """
    r = _route(files)
    h = F.col("handler")
    # lenient UTF-8: a binary→string cast never fails on malformed bytes
    # (``decode`` raises); the replacement characters are dropped, which is
    # reading with errors ignored
    raw = F.regexp_replace(F.col("content").cast("string"), "\ufffd", "")
    text = (F.when(h == "rtf", rtf_text(raw))
            .when((h == "xml") & (F.col("file_type") == "svg"), svg_text(raw)).when(h == "xml", xml_text(raw))
            .when(h == "env", redact_text(raw))
            .when(h == "srt", srt_text(raw)).when(h == "ass", ass_text(raw))
            .when(h.isin(*TEXT_HANDLERS), raw))
    meta = (F.when(h.isin("xml", "env"), F.create_map(F.lit("format"), F.col("file_type")))
            .when(h == "srt", F.create_map(F.lit("format"), F.lit("srt")))
            .when(h == "ass", F.create_map(F.lit("format"), F.lit("ass")))
            .when(F.col("source_type") == "code", F.create_map(F.lit("language"), F.col("file_type")))
            .when(h == "ocr", F.create_map(F.lit("needs_ocr"), F.lit("true")))
            .when(h == "transcribe", F.create_map(F.lit("needs_transcription"), F.lit("true")))
            .when(h == "archive", F.create_map(F.lit("archive"), F.lit("true")))
            .otherwise(F.create_map().cast("map<string,string>")))
    unsupported = ~h.isin(*TEXT_HANDLERS, *PY_HANDLERS, "ocr", "transcribe", "archive")
    err = F.when(F.col("archive_error").isNotNull(), F.array("archive_error")).when(unsupported, F.array(
        F.when(F.col("source_type").isNull(), F.concat(F.lit("Unsupported: "), F.col("file_type")))
        .otherwise(F.concat(F.lit("Decoder not available: "), F.col("file_type"))))) \
        .otherwise(F.array().cast("array<string>"))
    # archives reaching this point had no supported member or could not be
    # opened (expand_archives first): they stay as one empty row, the latter
    # with the error
    x = r.select(
        F.when(h.isin(*PY_HANDLERS), F.col("content")).alias("content"), "handler", "path",
        F.when(h == "html", raw).otherwise(F.coalesce(text, F.lit(""))).alias("text"),
        F.when(unsupported | (h == "archive"), F.lit(0)).otherwise(F.lit(1)).alias("pages"),
        err.alias("errors"), meta.alias("metadata"), "source_type", "file_type")
    return x.mapInArrow(_finish, PARSED_SCHEMA)


def types_by_category(files: DataFrame, ext: str = "file_type", category: str = "source_type") -> DataFrame:
    """Op 58: file types grouped by category – sorted distinct extensions,
    file count per category and the overall total."""
    g = files.groupBy(category).agg(F.array_sort(F.collect_set(ext)).alias("types"),
                                    F.count("*").alias("files"))
    return g.withColumn("total_files", files.select(F.count("*")).scalar())


def ingested(parsed: DataFrame) -> Column:
    """Whether a parsed file gave text: it has no errors and, if there is a
    column ``text``, some text (media still to be read and archives without a
    supported member have none)."""
    clean = F.coalesce(F.size("errors"), F.lit(-1)) == 0
    return clean & (F.coalesce(F.col("text"), F.lit("")) != "") if "text" in parsed.columns else clean


def ingest_summary(parsed: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Op 62: files ok / failed and items extracted (one row), plus one row
    per error with its file name (never a list of all errors in one row).
    Every file is either ok or failed; a failed one has an error at least."""
    summary = parsed.agg(F.count("*").alias("files_total"),
                         F.count_if(ingested(parsed)).alias("files_ok"),
                         F.count_if(~ingested(parsed)).alias("files_failed")) \
        .withColumn("items_extracted", items.select(F.count("*")).scalar())
    said = F.when(F.coalesce(F.size("errors"), F.lit(-1)) > 0, F.col("errors")).otherwise(F.array(F.lit("No text")))
    errors = parsed.where(~ingested(parsed)).select(F.col("path").alias("file"), F.explode(said).alias("error"))
    return summary, errors
