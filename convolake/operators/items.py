"""Extracted items: search, paging, stats, scoring, bulk edits, chunking,
model-output parsing and item building (SURVEY §2 ops 31-32, 35, 38,
53-56, 72, 80-81, 90-92, 124).

Items follow the ``extracted_data`` schema (FIXTURES §1).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.columns import round_half_up, word_count
from convolake.functions.ordering import row_number_within

# Sortable columns of the item listing, item defaults.
VALID_SORTS = ["importance_score", "created_at", "tokens", "category"]
ITEM_DEFAULTS = {"content_type": "qa_pair", "category": "general", "importance": 50.0,
                 "confidence": 0.8, "source_type": "unknown"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- search and paging (31-32) --------------------------------------------

def item_filter(skill: str | None = None, category: str | None = None, tag: str | None = None,
                min_importance: float | None = None, search: str | None = None,
                approved: bool | None = None, archived: bool = False) -> Column:
    """The composed predicate of the item listing (all filters optional)."""
    cond = F.lit(True)
    if skill is not None:
        cond &= F.col("skill_id") == skill
    if category:
        cond &= F.col("category") == category
    if tag:
        cond &= F.array_contains(F.col("tags"), tag)
    if min_importance is not None:
        cond &= F.col("importance_score") >= float(min_importance)
    if search:
        pat = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        cond &= F.col("user_input").ilike(pat) | F.col("assistant_response").ilike(pat)
    if approved is not None:
        cond &= F.col("is_approved") == F.lit(bool(approved))
    cond &= F.col("is_archived") == F.lit(bool(archived))
    return cond


def search_items(df: DataFrame, **filters) -> DataFrame:
    """Op 31: filter items (category, tag member, min importance,
    case-insensitive substring over question/answer, approved, archived)."""
    return df.where(item_filter(**filters))


def page_items(df: DataFrame, sort: str = "importance_score", order: str = "desc",
               page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """Op 32: one page of the filtered, sorted listing with total and pages.

    The sort column is whitelisted; ``id`` breaks ties so pages are stable.
    The total counts the *filtered* rows (Q7) as a scalar subquery.  Spark
    plans sort+offset+limit as a per-partition top-k, never a full sort.
    """
    sort = sort if sort in VALID_SORTS else "importance_score"
    key = F.desc(sort) if order == "desc" else F.asc(sort)
    f = df.where(item_filter(**filters))
    total = f.select(F.count("*")).scalar()
    page = max(int(page), 1)
    out = f.orderBy(key, F.asc("id")).offset((page - 1) * per_page).limit(per_page)
    return (out.withColumn("total", total)
            .withColumn("page", F.lit(page))
            .withColumn("pages", F.floor((total + per_page - 1) / per_page).cast("bigint")))


# --- validation, scores, batches (35, 38, 72) ----------------------------

def valid_qa_items(df: DataFrame, q: str = "user_input", a: str = "assistant_response") -> DataFrame:
    """Op 35: both fields present, question > 5 chars, answer > 10 chars."""
    return df.where(F.col(q).isNotNull() & F.col(a).isNotNull()
                    & (F.length(q) > 5) & (F.length(a) > 10))


def apply_scores(items: DataFrame, scores: DataFrame, default: float = 50.0) -> DataFrame:
    """Op 38: attach scores by id (default 50), best first."""
    s = scores.select(F.col("id").alias("__sid"), F.col("score").alias("__score"))
    out = items.join(s, items["id"] == s["__sid"], "left")
    return (out.withColumn("importance_score", F.coalesce(F.col("__score").cast("double"), F.lit(default)))
            .drop("__sid", "__score")
            .orderBy(F.desc("importance_score"), "id"))


def batch_rows(df: DataFrame, key: str = "skill_id", size: int = 20,
               order: Sequence = ("id",)) -> DataFrame:
    """Op 72: number rows in batches of ``size`` within each key.

    Row numbers come from :func:`row_number_within` (range-partitioned sort,
    no per-key window), so one huge skill is spread over many tasks."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    x = row_number_within(df, [key], cols, "__rn")
    return x.withColumn("batch_no", F.floor((F.col("__rn") - 1) / size).cast("int")).drop("__rn")


# --- stats (53-56) -------------------------------------------------------

def item_stats(df: DataFrame, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Op 53: totals over unarchived items; archived counted before the
    filter (Q6).  Distinct counts are exact by default, in the same pass: the
    input is read once, and only distinct (group, value) pairs of a task are
    shuffled; ``approx=True`` uses HyperLogLog sketches."""
    live = ~F.col("is_archived")
    aggs = [
        F.count_if(live).alias("total"),
        F.count_if(live & F.col("is_approved")).alias("approved"),
        F.count_if(live & ~F.col("is_approved")).alias("pending"),
        F.count_if(F.col("is_archived")).alias("archived"),
        round_half_up(F.coalesce(F.avg(F.when(live, F.col("importance_score"))), F.lit(0.0)), 1)
        .alias("avg_importance"),
        F.coalesce(F.sum(F.when(live, F.col("tokens"))), F.lit(0)).cast("bigint").alias("total_tokens"),
    ]
    distinct = {"categories_count": F.when(live, F.col("category")),
                "sources_count": F.when(live, F.col("source_filename"))}
    count = (lambda e: F.approx_count_distinct(e, 0.01)) if approx else F.count_distinct
    return df.groupBy(*by).agg(*aggs, *[count(e).alias(a) for a, e in distinct.items()])


def category_counts(df: DataFrame, by: Sequence[str] = ("skill_id",)) -> DataFrame:
    """Op 54: unarchived items per category."""
    return (df.where(~F.col("is_archived")).groupBy(*by, "category")
            .agg(F.count("*").alias("count")))


def top_tags(df: DataFrame, n: int = 20, by: Sequence[str] = ("skill_id",)) -> DataFrame:
    """Op 55: the ``n`` most used tags of unarchived items (ties by tag).

    Tags are counted first (map-side combined); the ranking window then
    runs over distinct (group, tag) pairs only."""
    counts = (df.where(~F.col("is_archived"))
              .select(*by, F.explode("tags").alias("tag"))
              .groupBy(*by, "tag").agg(F.count("*").alias("count")))
    if not by:
        return counts.orderBy(F.desc("count"), "tag").limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("count"), "tag")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def skill_token_totals(df: DataFrame) -> DataFrame:
    """Op 56: unarchived items and their tokens per skill."""
    return (df.where(~F.col("is_archived")).groupBy("skill_id")
            .agg(F.count("*").alias("items"), F.sum("tokens").cast("bigint").alias("tokens")))


# --- bulk edits and promotion (80-81) -----------------------------------

def _in_set(df: DataFrame, ids: DataFrame, skill: str | None) -> DataFrame:
    """df with a boolean ``__sel``: id in the id set (and in the skill)."""
    hit = ids.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    x = df.join(hit, df["id"] == hit["__id"], "left")
    sel = F.coalesce(F.col("__hit"), F.lit(False))
    if skill is not None:
        sel = sel & (F.col("skill_id") == skill)
    return x.withColumn("__sel", sel).drop("__id", "__hit")


def bulk_edit(df: DataFrame, ids: DataFrame, action: str, value: str | None = None,
              skill: str | None = None) -> DataFrame:
    """Op 80: approve / archive / delete / tag / categorize an id set
    (optionally within one skill) in one join – no per-id loop."""
    x = _in_set(df, ids, skill)
    sel = F.col("__sel")
    if action == "approve":
        x = x.withColumn("is_approved", F.when(sel, F.lit(True)).otherwise(F.col("is_approved")))
    elif action == "archive":
        x = x.withColumn("is_archived", F.when(sel, F.lit(True)).otherwise(F.col("is_archived")))
    elif action == "delete":
        x = x.where(~sel)
    elif action == "tag" and value:
        tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
        x = x.withColumn("tags", F.when(sel & ~F.array_contains(tags, value), F.array_append(tags, F.lit(value)))
                         .otherwise(F.col("tags")))
    elif action == "categorize" and value:
        x = x.withColumn("category", F.when(sel, F.lit(value)).otherwise(F.col("category")))
    else:
        raise ValueError(f"unknown action {action!r}")
    return x.drop("__sel")


def promote_items(df: DataFrame, ids: DataFrame, skill: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Op 81: selected items → training rows; the originals are archived.

    quality = clamp(round(importance / 20), 1, 5) rounding half up (Q10);
    the archive step honours the skill filter too (Q7).
    """
    x = _in_set(df, ids, skill)
    q = F.greatest(F.lit(1), F.least(F.lit(5), F.round((F.col("importance_score") / 20).cast("decimal(38,10)"), 0)
                                     .cast("int")))
    new_rows = x.where(F.col("__sel")).select(
        "id", "skill_id", "user_input", "assistant_response", "category",
        q.alias("quality_score"), "tokens",
        F.concat(F.lit("extracted:"), F.col("source_filename")).alias("source"))
    updated = (x.withColumn("is_archived", F.when(F.col("__sel"), F.lit(True)).otherwise(F.col("is_archived")))
               .drop("__sel"))
    return new_rows, updated


# --- chunking, model output, items (90-92, 124) ---------------------------

def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def chunk_text(df: DataFrame, col: str = "text", max_chars: int = 10000, sep: str = "\n\n",
               out: str = "chunk") -> DataFrame:
    """Op 90: greedy paragraph packing into chunks shorter than ``max_chars``.

    A text that fits is one chunk.  Otherwise paragraphs (split on ``sep``)
    are appended while ``len(current) + len(paragraph) < max_chars``; a
    paragraph that does not fit closes the current chunk.  The fold is an
    ``aggregate()`` over the row's own paragraph array (JVM only), then
    ``posexplode`` emits one row per chunk with its index.
    """
    text = F.col(col)
    paras = F.split(text, re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", sep))
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, p):
        fits = F.length(acc["cur"]) + F.length(p) < max_chars
        closed = F.when(acc["cur"] != "", F.concat(acc["done"], F.array(_strip(acc["cur"])))) \
            .otherwise(acc["done"])
        return F.when(fits, F.struct(acc["done"].alias("done"),
                                     F.concat(acc["cur"], p, F.lit(sep)).alias("cur"))) \
            .otherwise(F.struct(closed.alias("done"), F.concat(p, F.lit(sep)).alias("cur")))

    def finish(acc):
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(_strip(acc["cur"])))) \
            .otherwise(acc["done"])

    packed = F.aggregate(paras, init, step, finish)
    chunks = F.when(F.length(text) <= max_chars, F.array(text)) \
        .otherwise(F.when(F.size(packed) > 0, packed).otherwise(F.array(F.left(text, F.lit(max_chars)))))
    return df.select("*", F.posexplode(chunks).alias("chunk_no", out))


def parse_model_json(df: DataFrame, col: str, schema, out: str = "parsed") -> DataFrame:
    """Op 91: JSON out of a model reply – fenced block first, else the
    outermost ``[…]``/``{…}`` span, else empty (an empty array for array
    schemas).  Spark's JSON reader accepts a value followed by trailing
    text, so "[a] and [b]" yields the first array where a strict parser
    would fall through to empty."""
    c = F.trim(F.col(col))
    fenced_json = F.regexp_extract(c, r"(?s)```json(.*?)(?:```|$)", 1)
    fenced = F.regexp_extract(c, r"(?s)```(.*?)(?:```|$)", 1)
    body = (F.when(c.contains("```json"), fenced_json)
            .when(c.contains("```"), fenced).otherwise(c))
    span = F.regexp_extract(body, r"(?s)[\[{].*[\]}]", 0)
    opts = {"mode": "PERMISSIVE"}
    # a struct schema gives a struct of nulls for text that is no JSON; the variant parser says which it is
    whole = F.try_parse_json(body).isNotNull()
    parsed = F.coalesce(F.when(whole, F.from_json(body, schema, opts)), F.when(F.try_parse_json(span).isNotNull(), F.from_json(span, schema, opts)))
    from pyspark.sql.types import ArrayType, _parse_datatype_string
    dt = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    if isinstance(dt, ArrayType):  # nothing parseable → empty list
        parsed = F.coalesce(parsed, F.array().cast(dt))
    return df.withColumn(out, parsed)


def build_items(df: DataFrame) -> DataFrame:
    """Op 92: extracted records with defaults, the whole raw text, word
    tokens and a content-hash id (Q9: same content → same id)."""
    def opt(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in df.columns \
        else F.array().cast("array<string>")
    raw = F.coalesce(F.col("raw"), F.lit("")) if "raw" in df.columns else F.lit("")
    # each field with its length, so that different fields never give one key
    key = F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
                     for c in ("skill_id", "source_filename", "user_input", "assistant_response")])
    return df.select(
        F.sha2(key.cast("binary"), 256).alias("id"),
        "skill_id",
        opt("type", ITEM_DEFAULTS["content_type"]).alias("content_type"),
        "user_input", "assistant_response",
        raw.alias("raw_content"),
        "source_filename",
        opt("source_type", ITEM_DEFAULTS["source_type"]).alias("source_type"),
        opt("category", ITEM_DEFAULTS["category"]).alias("category"),
        tags.alias("tags"),
        opt("importance", ITEM_DEFAULTS["importance"]).cast("double").alias("importance_score"),
        opt("confidence", ITEM_DEFAULTS["confidence"]).cast("double").alias("confidence"),
        (word_count("user_input") + word_count("assistant_response")).alias("tokens"),
        F.lit(False).alias("is_approved"), F.lit(False).alias("is_archived"),
    )


QA_ARROW = r'^\s*"(.+?)"\s*->\s*(.+?)\s*$'
QA_QA = r"^\s*Q:\s*(.+?)\s+A:\s*(.+?)\s*$"


def extract_qa_pairs(df: DataFrame, col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Op 124: rule-based pairs from text lines – ``"question" -> answer``
    and ``Q: … A: …`` on one line."""
    lines = df.select(*keep, F.posexplode(F.split(F.col(col), "\n")).alias("line_no", "line"))
    q = F.coalesce(F.nullif(F.regexp_extract("line", QA_ARROW, 1), F.lit("")),
                   F.nullif(F.regexp_extract("line", QA_QA, 1), F.lit("")))
    a = F.when(F.regexp_extract("line", QA_ARROW, 1) != "", F.regexp_extract("line", QA_ARROW, 2)) \
        .otherwise(F.regexp_extract("line", QA_QA, 2))
    return (lines.select(*keep, "line_no", q.alias("user_input"), a.alias("assistant_response"))
            .where(F.col("user_input").isNotNull()))
