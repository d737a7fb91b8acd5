"""What fails is told apart from what is done."""

import tempfile

from pyspark.sql import functions as F

from convolake.operators import documents as DOC
from convolake.plans import catalog


def test_files_without_text_are_failed(spark):
    """Before, an archive that can't be opened and an image still to be read counted as ok."""
    files = spark.createDataFrame([("/a.txt", b"text"), ("/bad.zip", b"no zip"), ("/cut.gz", b"\x1f\x8b"), ("/i.png", b"\x89PNG"),
                                   ("/none.csv", None), ("/p.pdf", b"%PDF"), ("/empty.txt", b"")], "path string, content binary")
    parsed = DOC.extract_text(DOC.expand_archives(files))
    assert [r.errors[0][:11] for r in parsed.where("path = '/bad.zip'").collect()] == ["Parse error"]
    summary, errors = DOC.ingest_summary(parsed, parsed.where(DOC.ingested(parsed)))
    assert tuple(summary.first()) == (7, 1, 6, 1)
    assert sorted(r.file for r in errors.collect()) == ["/bad.zip", "/cut.gz", "/empty.txt", "/i.png", "/none.csv", "/p.pdf"]


def test_summary_counts_no_items_of_failed_files(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    texts = spark.range(36).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    texts.write.parquet(d + "/documents.parquet")
    assert tuple(catalog.queries()["ingest_summary"](spark, d).first()) == (36, 32, 4, 32)  # png and pdf give no text
