"""Platform tables derived from the driver tables.

Each function takes a :class:`Tables` accessor and returns a DataFrame
with the schema of the platform table it stands for.  Derivations are
plain column expressions over whole tables – no filters, no samples – so
the work grows with the input.  ``plans/oracle.py`` holds the same
derivations in DuckDB SQL.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.functions.sizing import param_table
from pyspark.sql import Window

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()

# Skill names the driver-table mapping assigns (by event id).
SKILLS = ["receptionist", "electrician", "plumber", "solar", "general"]
BASE_TS = "2024-01-01 00:00:00"


class Tables:
    """Lazy parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str, max_files: int | None = None) -> DataFrame:
        """The same table as a streaming source (file source over the folder,
        filtered to the table's file)."""
        r = (self.spark.readStream.schema(self.read(name).schema)
             .option("pathGlobFilter", f"{name}.parquet"))
        if max_files:
            r = r.option("maxFilesPerTrigger", max_files)
        return r.parquet(self.sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.read(name)
        raise AttributeError(name)


# Invented error texts of failed calls (picked by event id).
ERROR_TEXTS = ["TimeoutError: upstream took too long", "ConnectionError: reset by peer",
               "ValueError: invalid format in payload", "CUDA out of memory while decoding",
               "model not found: 404", "No CUDA GPUs are available", "unexpected failure"]


def _pick(n, values):
    expr = None
    for i, v in enumerate(values):
        expr = F.when(n == i, v) if expr is None else expr.when(n == i, v)
    return expr


def _base_ts():
    return F.lit(BASE_TS).cast("timestamp_ntz")


def _skill_of(n):
    """SKILLS[n % 5] as a column expression."""
    expr = None
    for i, s in enumerate(SKILLS):
        cond = (n % 5) == i
        expr = F.when(cond, s) if expr is None else expr.when(cond, s)
    return expr


def interactions(t: Tables) -> DataFrame:
    """voice interactions ← events (one call turn per event)."""
    return interactions_of(t.events)


def interactions_of(e: DataFrame) -> DataFrame:
    """The interactions mapping applied to an events frame (batch or stream)."""
    deep = e.event_type.isin("purchase", "signup")
    err = e.event_type == "error"
    lat = F.floor(e.value * 10).cast("int")
    return e.select(
        e.event_id.alias("id"),
        e.ts.alias("created_at"),
        e.user_id.alias("session_id"),
        F.when(e.event_id % 23 == 0, F.lit(None).cast("string"))
         .otherwise(_skill_of(e.event_id)).alias("skill_id"),
        F.concat(F.lit("+1555"), F.lpad(e.user_id.cast("string"), 7, "0")).alias("phone_number"),
        F.concat_ws(" ", e.event_type, e.props).alias("user_input"),
        F.concat(F.lit("re: "), e.event_type).alias("agent_response"),
        F.when(deep, "deep").otherwise("fast").alias("system_used"),
        F.when(deep, F.concat(F.lit("complex_"), e.event_type)).alias("routing_reason"),
        F.when(deep, (50 + e.event_id % 100).cast("int")).otherwise(lat).alias("fast_latency_ms"),
        F.when(deep, lat).alias("deep_latency_ms"),
        F.lit(None).cast("int").alias("total_latency_ms"),
        (80 + e.event_id % 40).cast("int").alias("stt_latency_ms"),
        (30 + e.event_id % 20).cast("int").alias("tts_latency_ms"),
        F.when(e.event_id % 3 != 0, (1 + e.event_id % 5).cast("int")).alias("user_feedback"),
        (e.event_id % 4 != 0).alias("call_completed"),
        err.alias("error_occurred"),
        F.when(err, F.concat(_pick(e.event_id % 7, ERROR_TEXTS), F.lit(" #"), e.event_id.cast("string")))
         .alias("error_message"),
        (20 + e.event_id % 180).cast("int").alias("input_tokens"),
        (10 + (e.event_id * 7) % 300).cast("int").alias("output_tokens"),
        (e.event_id % 11 == 0).alias("exported_for_training"),
    )


def prices(spark: SparkSession) -> DataFrame:
    """Price table per routing system (USD per token)."""
    # Per-token prices of the two systems.
    rows = [("fast", "0.00000059", "0.00000079"), ("deep", "0.000003", "0.000015")]
    return param_table(spark, rows, "system_used string, in_price string, out_price string") \
        .select("system_used", F.col("in_price").cast("decimal(12,10)").alias("in_price"),
                F.col("out_price").cast("decimal(12,10)").alias("out_price"))


def turns(t: Tables) -> DataFrame:
    """conversation turns as they come (conv_id, turn, role, text)."""
    return t.conversations


def feedback_log(t: Tables) -> DataFrame:
    """feedback log ← conversations: each user turn and the next assistant turn
    form one logged interaction; rating 1 + conv_id % 5; a correction
    (upper-cased response) exists when the rating is ≤ 2."""
    from convolake.operators.curation import exchange_pairs
    x = exchange_pairs(t.conversations)
    rating = (1 + x.conv_id % 5).cast("int")
    return x.select(
        F.timestamp_add("MINUTE", x.conv_id * 10 + x.turn, _base_ts()).alias("timestamp"),
        x.user_input.alias("user_input"),
        x.agent_response.alias("agent_response"),
        F.concat(F.lit("src"), (x.conv_id % 20).cast("string")).alias("skill_used"),
        rating.alias("rating"),
        F.when(rating <= 2, F.concat(F.lit("[corrected] "), x.agent_response)).alias("correction"),
        x.conv_id, x.turn,
    )


def extracted(t: Tables) -> DataFrame:
    """extracted items ← documents ⟕ labels."""
    d, lab = t.documents, t.labels
    j = d.join(lab, "doc_id", "left")
    return j.select(
        j.doc_id.alias("id"),
        j.source.alias("skill_id"),
        F.lit("qa").alias("content_type"),
        F.split_part(j.text, F.lit("\n"), F.lit(1)).alias("user_input"),
        j.text.alias("assistant_response"),
        j.text.alias("raw_content"),
        F.concat(F.lit("doc_"), j.doc_id.cast("string"), F.lit(".txt")).alias("source_filename"),
        F.lit("txt").alias("source_type"),
        j.lang.alias("category"),
        F.array(j.lang, F.concat(F.lit("s"), (j.n_chars % 7).cast("string"))).alias("tags"),
        (j.n_chars % 101).cast("double").alias("importance_score"),
        F.lit(0.8).alias("confidence"),
        j.n_chars.alias("n_chars"),
        F.floor(j.n_chars / 4).cast("int").alias("tokens"),
        F.coalesce(j.quality == 1, F.lit(False)).alias("is_approved"),
        F.coalesce(j.toxic == 1, F.lit(False)).alias("is_archived"),
        F.timestamp_add("MINUTE", j.doc_id, _base_ts()).alias("created_at"),
    )


def adapters(t: Tables) -> DataFrame:
    """trained adapters ← orders."""
    o = t.orders
    return o.select(
        o.o_orderkey.alias("id"),
        F.concat(F.lit("skill"), (o.o_custkey % 200).cast("string")).alias("skill_id"),
        F.concat(F.lit("adapter_"), o.o_orderkey.cast("string")).alias("adapter_name"),
        F.when(o.o_orderstatus != "P", o.o_totalprice / 1e5).alias("final_loss"),
        F.when(o.o_orderstatus == "F", "completed").when(o.o_orderstatus == "P", "failed")
         .otherwise("training").alias("status"),
        (1 + o.o_orderkey % 3).cast("int").alias("epochs"),
        (60 + o.o_orderkey % 900).cast("int").alias("training_time_seconds"),
        o.o_orderdate.alias("created_at"),
    )


def skills(t: Tables) -> DataFrame:
    """skills ← distinct document sources (one skill per source)."""
    d = t.documents
    g = d.groupBy("source").agg(F.min("doc_id").alias("first_doc"),
                                F.count("*").alias("n_docs"))
    return g.select(
        g.source.alias("id"),
        F.concat(F.lit("Skill "), g.source).alias("name"),
        F.concat(F.lit("You are the "), g.source, F.lit(" assistant.")).alias("system_prompt"),
        (g.first_doc % 2 == 0).alias("is_builtin"),
        g.n_docs,
    )


def exchanges(t: Tables) -> DataFrame:
    """user turn + the next turn when it is the assistant's (op 46 form)."""
    from convolake.operators.curation import exchange_pairs
    return exchange_pairs(t.conversations)


def training_data(t: Tables) -> DataFrame:
    """manually curated examples ← exchanges."""
    x = exchanges(t)
    k = x.conv_id + x.turn
    return x.select(
        (x.conv_id * 100 + x.turn).alias("id"),
        F.concat(F.lit("src"), (x.conv_id % 20).cast("string")).alias("skill_id"),
        x.user_input.alias("user_message"),
        x.agent_response.alias("assistant_response"),
        (1 + k % 5).cast("int").alias("rating"),
        F.when(k % 4 == 0, F.concat(F.lit("[corrected] "), x.agent_response)).when(k % 4 == 1, F.lit(""))
         .alias("corrected_response"),
        F.timestamp_add("MINUTE", x.conv_id * 10 + x.turn, _base_ts()).alias("created_at"),
    )


def knowledge(t: Tables) -> DataFrame:
    """skill knowledge in long form (skill_id, ord, item) ← first line of
    each document of the skill's source."""
    d = t.documents
    return d.select(d.source.alias("skill_id"), d.doc_id.alias("ord"),
                    F.split_part(d.text, F.lit("\n"), F.lit(1)).alias("item"))


def jobs(t: Tables) -> DataFrame:
    """training jobs ← orders."""
    o = t.orders
    return o.select(
        o.o_orderkey.alias("id"),
        F.concat(F.lit("skill"), (o.o_custkey % 200).cast("string")).alias("skill_id"),
        F.when(o.o_orderstatus == "F", "completed").when(o.o_orderstatus == "P", "failed")
         .otherwise("running").alias("status"),
        (60 + o.o_orderkey % 900).cast("int").alias("training_time_seconds"),
        (o.o_totalprice.cast("decimal(18,2)") / 1000).cast("decimal(18,5)").alias("cost_usd"),
        o.o_orderdate.alias("created_at"),
    )


def steps(t: Tables) -> DataFrame:
    """training step events ← events (job = user, step in time order)."""
    e = t.events
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        e.ts.alias("timestamp"),
        F.concat(F.lit("job"), e.user_id.cast("string")).alias("job_id"),
        F.row_number().over(w).alias("step"),
        F.count("*").over(Window.partitionBy("user_id")).alias("total_steps"),
        (e.value / 100).alias("loss"),
        ((e.event_id % 30) + 1).cast("double").alias("step_time_seconds"),
    )


def turns_labelled(t: Tables) -> DataFrame:
    """conversation turns with a skill and a speech duration attached."""
    c = t.conversations
    skills6 = ["receptionist", "electrician", "plumber", "solar", "lawyer", "general"]
    sk = None
    for i, s in enumerate(skills6):
        sk = F.when(c.conv_id % 6 == i, s) if sk is None else sk.when(c.conv_id % 6 == i, s)
    return c.select("conv_id", "turn", "role", "text", sk.alias("skill_id"),
                    ((c.conv_id * 37 + c.turn * 101) % 1500).cast("int").alias("duration_ms"))


# Invented project file names (stem, extension) picked by document id.
FILE_NAMES = [("Scope of Work ", ".docx"), ("Section 07 5423 ", ".pdf"), ("271-mech plan ", ".pdf"),
              ("GAF warranty ", ".pdf"), ("field sketch ", ".pdf"), ("taper ", ".pdf"), ("typical ", ".pdf"),
              ("takeoff ", ".xlsx"), ("contract ", ".pdf"), ("photo ", ".jpg"), ("IMG_", ".dxf"),
              ("302-product data ", ".pdf"), ("261 plumbing riser ", ".pdf"), ("282-E ", ".dxf")]


def files(t: Tables) -> DataFrame:
    """project files ← documents (project = source, text = document text)."""
    d = t.documents
    k = d.doc_id % len(FILE_NAMES)
    name = F.concat(_pick(k, [s for s, _ in FILE_NAMES]), d.doc_id.cast("string"),
                    _pick(k, [e for _, e in FILE_NAMES]))
    return d.select(d.doc_id.alias("file_id"), d.source.alias("project_id"), name.alias("name"),
                    "text", d.n_chars.alias("size"))


def entities(t: Tables) -> DataFrame:
    """drawing entities ← lineitem (lines, circles, texts, blocks, dimensions,
    leaders; one drawing per supplier) ∪ embeddings (polylines whose vertices
    are consecutive embedding pairs)."""
    li = t.lineitem
    n = li.l_linenumber
    typ = (F.when(n <= 2, "LINE").when(n == 3, "CIRCLE").when(n == 4, "TEXT").when(n == 5, "INSERT")
           .when(n == 6, "DIMENSION").when(li.l_returnflag == "R", "LEADER").otherwise("MTEXT"))
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = (F.when(n <= 2, F.array(pt(li.l_quantity, li.l_discount * 100),
                                     pt(li.l_extendedprice / 1000, li.l_tax * 100)))
              .otherwise(F.array(pt(li.l_quantity, li.l_tax * 100))))
    a = li.select(
        F.concat(F.lit("s"), li.l_suppkey.cast("string")).alias("drawing"),
        (li.l_orderkey * 10 + n).alias("entity_id"),
        typ.alias("type"),
        F.concat(F.lit("L-"), li.l_returnflag).alias("layer"),
        n.alias("color"),
        points.alias("points"),
        F.lit(False).alias("closed"),
        F.when(n == 3, li.l_discount * 100).alias("radius"),
        F.when(n.isin(4, 7), F.concat(F.lit(" NOTE P"), li.l_partkey.cast("string"), F.lit(" "))).alias("text"),
        F.when(n.isin(4, 7), li.l_tax * 10).alias("height"),
        F.when(n == 5, F.concat(F.lit("BLK-"), li.l_linestatus)).alias("block_name"),
        F.when(n == 6, li.l_extendedprice / 100).alias("measurement"),
        (li.l_suppkey % 7).cast("int").alias("units_code"),
    )
    e = t.embeddings
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)),
                      lambda i: F.struct(F.element_at(e.embedding, i * 2 + 1).cast("double").alias("x"),
                                         F.element_at(e.embedding, i * 2 + 2).cast("double").alias("y")))
    b = e.select(
        F.concat(F.lit("e"), (e.vec_id % 10).cast("string")).alias("drawing"),
        (e.vec_id + 10**12).alias("entity_id"),
        F.lit("LWPOLYLINE").alias("type"),
        F.concat(F.lit("POLY-"), e.label.cast("string")).alias("layer"),
        F.lit(7).alias("color"),
        F.when(F.size(e.embedding) >= 64, pts).otherwise(F.array()).alias("points"),
        (e.vec_id % 2 == 0).alias("closed"),
        F.lit(None).cast("double").alias("radius"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("double").alias("height"), F.lit(None).cast("string").alias("block_name"),
        F.lit(None).cast("double").alias("measurement"),
        ((e.vec_id % 10) % 7).cast("int").alias("units_code"),
    )
    return a.unionByName(b)


def units(spark: SparkSession) -> DataFrame:
    """drawing unit codes → feet (miles corrected to 5280 feet, Q12)."""
    from convolake.operators.takeoff import UNITS
    return param_table(spark, [(c, nm, f) for c, (nm, f) in UNITS.items()],
                                 "code int, name string, to_feet double")


def health(t: Tables) -> DataFrame:
    """service health checks ← events (one check per event)."""
    return health_of(t.events)


def health_of(e: DataFrame) -> DataFrame:
    """The health mapping applied to an events frame (batch or stream)."""
    return e.select(
        e.event_id.alias("id"), e.ts.alias("checked_at"),
        (e.event_id % 7 != 0).alias("groq_healthy"), (e.event_id % 11 != 0).alias("anthropic_healthy"),
        (e.event_id % 13 != 0).alias("deepgram_healthy"), (e.event_id % 17 != 0).alias("cartesia_healthy"),
        (e.event_id % 19 != 0).alias("livekit_healthy"),
        F.floor(e.value).cast("int").alias("groq_latency_ms"),
        F.floor(e.value * 3).cast("int").alias("anthropic_latency_ms"),
    )
