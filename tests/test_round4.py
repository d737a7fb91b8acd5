"""Memory and time of a task stay bounded while the tables grow."""

import datetime as dt
import os
import random
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from convolake.functions.ordering import fits_one_task, sort_tasks
from convolake.functions.scan import Blocks
from convolake.operators import documents as DOC
from convolake.plans import catalog
from convolake.session import ensure_checkpoint_dir, rocksdb_session
from convolake.streaming import turns as ST


def test_sorts_get_tasks_by_their_input(spark):
    few, many = spark.range(1000), spark.range(2_000_000)  # 8 KB and 16 MB by the estimate
    assert fits_one_task(few) and not fits_one_task(many)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sort_tasks(few) == shuffled and sort_tasks(many) == 16 > shuffled
    assert sort_tasks(few.crossJoin(few.withColumnRenamed("id", "b"))) == shuffled  # what a join makes doesn't count


def test_block_windows_get_as_many_tasks(spark):
    blocks = Blocks(spark.range(1_500_000).withColumn("k", F.lit(1)), ["k"], [F.asc("id")])
    assert blocks.rows.rdd.getNumPartitions() == 12
    got = blocks.previous(blocks.rows, F.col("id"), "previous").agg(F.count("previous"), F.sum(F.col("id") - F.col("previous"))).first()
    assert tuple(got) == (1_499_999, 1_499_999)


def test_checks_that_come_together_are_one_value_of_the_state(spark):
    rng, t0 = random.Random(1), dt.datetime(2024, 1, 1, 20)
    rows = [(t0 + dt.timedelta(seconds=rng.randrange(28_000)), *[rng.random() < 0.5 for _ in ST.SERVICES]) for _ in range(400)]
    schema = "checked_at timestamp, " + ", ".join(f"{s}_healthy boolean" for s in ST.SERVICES)
    d = tempfile.mkdtemp(dir="/tmp")
    table = spark.createDataFrame(rows, schema)
    table.coalesce(1).write.parquet(d + "/in")
    own = rocksdb_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    ST.stream_health(own.readStream.schema(schema).parquet(d + "/in")).writeStream.format("parquet").option("checkpointLocation", d + "/c") \
        .trigger(availableNow=True).start(d + "/out").awaitTermination()
    state = own.read.format("statestore").option("path", d + "/c").option("operatorId", 1).option("stateVarName", "rows").option("flattenCollectionTypes", True)
    assert 0 < state.load().count() <= 2 * len(ST.SERVICES)
    batch = ST.health_batch(table)
    got = spark.read.schema(batch.schema).parquet(d + "/out").collect() + ST.pending_health(own, d + "/c").collect()
    assert sorted(map(str, got)) == sorted(map(str, batch.collect()))


def test_a_bucket_is_written_by_every_task(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    texts.repartition(4).write.parquet(d + "/documents.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 20))  # a task per file
    try:
        known = {r.path for r in _written(spark)}
        got = catalog.queries()["scan_documents"](spark, d).collect()
        files = [r.path for r in _written(spark) if r.path not in known]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    want = {f"d{k}": sum(len(f"é{i}\n".encode()) for i in range(k, 60, 3)) for k in range(3)}
    assert {r.bucket: r.length for r in got} == want and len(got) == 3
    assert len(files) > 6


def _written(spark):
    folder = ensure_checkpoint_dir(spark).rstrip("/") + "/convolake-io"
    os.makedirs(folder.removeprefix("file:"), exist_ok=True)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).select("path").collect()


def test_files_are_decoded_by_slices(monkeypatch):
    monkeypatch.setattr(DOC, "SLICE_BYTES", 100)
    none = [None] * 50
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"a,b\n1,%d\n" % k if k % 2 else None for k in range(50)], pa.binary()), pa.array(["csv" if k % 2 else "html" for k in range(50)]),
         pa.array([f"/f{k}" for k in range(50)]), pa.array(["" if k % 2 else f"<title>t{k}</title><b>{k}" for k in range(50)]),
         pa.array([1] * 50, pa.int32()), pa.array([[]] * 50, pa.list_(pa.string())), pa.array(none, pa.map_(pa.string(), pa.string())),
         pa.array(none, pa.string()), pa.array(none, pa.string())],
        ["content", "handler", "path", "text", "pages", "errors", "metadata", "source_type", "file_type"])
    parts = list(DOC._finish(iter([batch])))
    assert len(parts) > 4 and max(p.num_rows for p in parts) < 20
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["path"] for r in rows] == [f"/f{k}" for k in range(50)]
    assert rows[3]["text"] == "a: 1 | b: 3" and rows[4]["text"] == "t4**4" and rows[4]["metadata"] == [("title", "t4")]


def test_one_python_step_decodes(spark):
    files = spark.createDataFrame([("/a.html", b"<p>x"), ("/b.csv", b"a\n1\n")], "path string, content binary")
    plan = DOC.extract_text(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1


def test_parsed_files_are_written_once(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    texts = spark.range(36).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    texts.write.parquet(d + "/documents.parquet")
    plan = catalog.queries()["ingest_summary"](spark, d)
    assert plan.first().files_total == 36
    assert any("convolake-parsed" in f for f in plan.inputFiles())


def test_parsing_hands_python_few_rows_at_once(spark, monkeypatch):
    """Before, a Python worker held 10,000 whole files at once."""
    d = tempfile.mkdtemp(dir="/tmp")
    texts = spark.range(0, 1800, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    texts.write.parquet(d + "/documents.parquet")
    whole = DOC._finish

    def counted(batches):
        def each():
            for batch in batches:
                assert batch.num_rows <= 500, f"{batch.num_rows} files at once"
                yield batch

        return whole(each())

    monkeypatch.setattr(DOC, "_finish", counted)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    assert catalog.queries()["ingest_summary"](spark, d).first().files_total == 1800
    assert spark.conf.get(rows) == before
