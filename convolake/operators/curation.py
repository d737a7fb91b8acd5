"""Training-data curation: shaping, prompts, corrections, preference data
(SURVEY §2 ops 13-21, 29-30, 33, 36, 46, 60-61, 74, 93-95).

Per-conversation work uses windows partitioned by conversation (the
window buffer spills, so a very long conversation costs time, not
memory); everything else is row-local or a map-side-combined aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.columns import word_count
from convolake.functions.sizing import broadcast_if_small

# The default instruction of the instruction format, the
# chat-template markers, the greeting inputs and the knowledge header.
DEFAULT_INSTRUCTION = "You are a helpful voice assistant. Respond naturally and conversationally."
CHAT_MARKERS = {
    "begin": "<|begin_of_text|>",
    "header": "<|start_header_id|>{role}<|end_header_id|>\n\n",
    "end": "<|eot_id|>",
}
GREETINGS = ["Hello", "Hi", "Hey there", "Good morning", "I need help"]
KNOWLEDGE_HEADER = "\n\n## Quick Reference\n"
PREFILL_TOKENS_PER_SEC = 6000
# Secret masking – longer than 8 characters shows the first and last 4.
MASK_MIN_LEN, MASK_KEEP = 8, 4


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- shaping (13-15) -------------------------------------------------------

def shape_instruction(df: DataFrame, instruction=DEFAULT_INSTRUCTION,
                      input_col: str = "user_input", output_col: str = "agent_response") -> DataFrame:
    """Op 13: rows → {instruction, input, output}."""
    ins = instruction if isinstance(instruction, Column) else F.lit(instruction)
    return df.select(ins.alias("instruction"), F.col(input_col).alias("input"),
                     F.col(output_col).alias("output"))


def best_response(response: str = "assistant_response", corrected: str = "corrected_response") -> Column:
    """Corrected response when present and non-empty, else the response."""
    return F.coalesce(F.nullif(F.col(corrected), F.lit("")), F.col(response))


def shape_messages(df: DataFrame, user: str = "user_message",
                   response: str = "assistant_response",
                   corrected: str | None = "corrected_response") -> DataFrame:
    """Op 14: rows → ``{"messages": [{role, content}, …]}`` JSON lines."""
    content = best_response(response, corrected) if corrected else F.col(response)
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col(user).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), content.alias("content")))
    return df.withColumn("messages", F.to_json(F.struct(msgs.alias("messages"))))


def shape_chat_template(df: DataFrame, system: str = "instruction", user: str = "input",
                        assistant: str = "output") -> DataFrame:
    """Op 15: one ``text`` column in the header/end-marker chat template."""
    def part(role, col):
        return [F.lit(CHAT_MARKERS["header"].format(role=role)), F.coalesce(F.col(col), F.lit("")),
                F.lit(CHAT_MARKERS["end"])]
    return df.withColumn("text", F.concat(F.lit(CHAT_MARKERS["begin"]), *part("system", system),
                                          *part("user", user), *part("assistant", assistant)))


# --- prompts (16-18) -------------------------------------------------------

def render_prompt(turns: DataFrame, conv: str = "conv_id", order: str = "turn",
                  role: str = "role", text: str = "text", system_prompt: str | None = None,
                  history: int | None = 10, balanced: bool = True, bucket: int = 1024) -> DataFrame:
    """Op 16: the model prompt before each user turn.

    For every user turn: optional ``System:`` line, the previous
    ``history`` turns as ``Role: text`` lines, the current ``User:`` line
    and a final ``Assistant:``.  With the default bounded history (the
    10-turn cap of the voice path, Q19) each output row has bounded size
    however long the conversation is; ``history=None`` renders the whole
    preceding conversation (row size then grows with the conversation, one
    window per conversation).

    Default plan (``balanced=True``, bounded history): turns are cut into
    ranges of ``bucket`` turn numbers; each row takes its in-range history
    from a bounded window frame, and the first rows of a range complete it
    from a carry of the last ``history`` turns of the preceding ranges
    (a per-range summary of at most ``history`` items).  One huge
    conversation is spread over all its ranges.  ``balanced=False``: one
    bounded window frame per conversation.
    """
    line = F.concat(F.initcap(F.col(role)), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    item = F.struct(F.col(order).alias("o"), line.alias("l"))

    def last_k(arr, k):
        return F.slice(arr, F.greatest(F.size(arr) - k + 1, F.lit(1)), k)

    if history is not None and balanced:
        k = history
        x = turns.select(conv, order, role, text).withColumn("__b", F.floor(F.col(order) / bucket))
        wb = Window.partitionBy(conv, "__b").orderBy(order)
        x = x.withColumn("__in", F.collect_list(item).over(wb.rowsBetween(-k, -1)))
        tails = (x.withColumn("__rd", F.row_number().over(Window.partitionBy(conv, "__b").orderBy(F.desc(order))))
                 .where(F.col("__rd") <= k)
                 .groupBy(conv, "__b").agg(F.collect_list(item).alias("__tail")))
        wn = Window.partitionBy(conv).orderBy("__b").rowsBetween(-k, -1)
        carry = tails.select(F.col(conv).alias("__c"), F.col("__b").alias("__bb"),
                             F.collect_list("__tail").over(wn).alias("__prev"))
        carry = carry.select("__c", "__bb", last_k(F.array_sort(F.flatten("__prev")), k).alias("__carry"))
        x = x.where(F.col(role) == "user").join(
            carry, (F.col(conv) == F.col("__c")) & (F.col("__b") == F.col("__bb")), "left")
        x = x.withColumn("__hist", last_k(F.concat(F.coalesce("__carry", F.array().cast(
            "array<struct<o:" + turns.schema[order].dataType.simpleString() + ",l:string>>")), F.col("__in")), k))
    else:
        lo = Window.unboundedPreceding if history is None else -history
        w = Window.partitionBy(conv).orderBy(order).rowsBetween(lo, -1)
        x = turns.withColumn("__hist", F.collect_list(item).over(w))
        x = x.where(F.col(role) == "user")
    hist = F.transform(F.array_sort(F.col("__hist")), lambda s: s["l"])
    parts = F.concat(
        F.array(F.lit(f"System: {system_prompt}")) if system_prompt else F.array().cast("array<string>"),
        hist,
        F.array(F.concat(F.lit("User: "), F.coalesce(F.col(text), F.lit(""))), F.lit("Assistant:")))
    return x.select(conv, order, F.array_join(parts, "\n").alias("prompt"))


def fill_template(df: DataFrame, templates: DataFrame, ctx_col: str = "ctx",
                  skill_col: str = "skill_id", default_skill: str = "general") -> DataFrame:
    """Op 17: pick the skill's template (unknown skill → ``general``) and
    replace ``{key}`` placeholders from the row's context map; unknown
    placeholders stay."""
    tpl = broadcast_if_small(templates.select(F.col("skill_id").alias("__sk"),
                                              F.col("template").alias("__tpl")), "templates")
    dflt = templates.where(F.col("skill_id") == default_skill).select("template").scalar()
    x = (df.join(tpl, F.col(skill_col) == F.col("__sk"), "left")
         .withColumn("__tpl", F.coalesce(F.col("__tpl"), dflt)))
    filled = F.aggregate(F.map_entries(F.col(ctx_col)), F.col("__tpl"),
                         lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")),
                                                  F.coalesce(e["value"], F.lit(""))))
    return x.withColumn("prompt", filled).drop("__sk", "__tpl")


def append_knowledge(df: DataFrame, prompt: str = "system_prompt", knowledge: str = "knowledge",
                     name: str = "name", greeting: str | None = "greeting") -> DataFrame:
    """Op 18: system prompt + "Quick Reference" bullet list; default greeting."""
    k = F.col(knowledge)
    bullets = F.array_join(F.transform(k, lambda x: F.concat(F.lit("- "), x)), "\n")
    full = F.when(F.size(k) > 0, F.concat(F.col(prompt), F.lit(KNOWLEDGE_HEADER), bullets)) \
        .otherwise(F.col(prompt))
    out = df.withColumn("full_prompt", full)
    dflt = F.concat(F.lit("Hello! I'm "), F.col(name), F.lit(". How can I help?"))
    g = F.coalesce(F.nullif(F.col(greeting), F.lit("")), dflt) if greeting and greeting in df.columns else dflt
    return out.withColumn("greeting_text", g)


# --- display helpers (19-21) ----------------------------------------------

def mask_secret(c) -> Column:
    """First 4 + ``...`` + last 4 when longer than 8 characters, else ``***``."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None)).when(
        F.length(c) > MASK_MIN_LEN,
        F.concat(F.left(c, F.lit(MASK_KEEP)), F.lit("..."), F.right(c, F.lit(MASK_KEEP)))
    ).otherwise(F.lit("***"))


def mask_secrets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Op 19: mask the given columns in place."""
    for c in cols:
        df = df.withColumn(c, mask_secret(c))
    return df


def time_ago(df: DataFrame, ts: str, as_of=None, out: str = "ago") -> DataFrame:
    """Op 20: "just now / N minutes ago / N hours ago / N days ago".

    Uses the total elapsed seconds (Q3 corrected).  ``as_of`` defaults to
    the newest ``ts`` of the input (one-row aggregate, broadcast).
    """
    anchor = as_of if isinstance(as_of, Column) else _anchor(df, ts, as_of)
    x = df.withColumn("__as_of", anchor)
    secs = F.floor(F.timestamp_diff("MICROSECOND", F.col(ts), F.col("__as_of")) / F.lit(1000000))
    label = (F.when(secs < 60, F.lit("just now"))
             .when(secs < 3600, F.concat(F.floor(secs / 60).cast("string"), F.lit(" minutes ago")))
             .when(secs < 86400, F.concat(F.floor(secs / 3600).cast("string"), F.lit(" hours ago")))
             .otherwise(F.concat(F.floor(secs / 86400).cast("string"), F.lit(" days ago"))))
    return x.withColumn(out, label).drop("__as_of")


def token_estimates(df: DataFrame, col: str = "text") -> DataFrame:
    """Op 21: word count, chars/4 token estimate, prefill milliseconds."""
    tokens = F.floor(F.length(col) / 4).cast("bigint")
    return (df.withColumn("words", word_count(col))
            .withColumn("approx_tokens", tokens)
            .withColumn("prefill_ms", F.floor(tokens * 1000 / F.lit(PREFILL_TOKENS_PER_SEC)).cast("bigint")))


# --- corrections and preference data (29-30, 60, 93-94) -------------------

def _anchor(df: DataFrame, ts: str, as_of) -> Column:
    """``as_of`` as a column: the given time, else the newest ``ts`` of the
    input as a scalar subquery (one small aggregate, evaluated once)."""
    if as_of is None:
        return df.agg(F.max(ts)).scalar()
    return F.lit(as_of).cast("timestamp_ntz")


def recent(df: DataFrame, ts: str = "timestamp", as_of=None, days: int = 7) -> DataFrame:
    """Rows with ``ts > as_of − days`` (strict)."""
    cutoff = _anchor(df, ts, as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(ts) > cutoff)


def recent_corrections(df: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Op 29: corrections newer than ``as_of − days``."""
    return recent(df, "timestamp", as_of, days)


def low_rated(df: DataFrame, as_of=None, days: int = 7, threshold: int = 3) -> DataFrame:
    """Op 30: recent log rows whose rating is set, non-zero and ≤ threshold."""
    r = F.col("rating")
    return recent(df, "timestamp", as_of, days).where(r.isNotNull() & (r != 0) & (r <= threshold))


def correction_pairs(log: DataFrame) -> DataFrame:
    """Op 93: logged interactions with a correction → preference pairs."""
    c = F.col("correction")
    return log.where(c.isNotNull() & (c != "")).select(
        "timestamp", F.col("user_input").alias("prompt"), c.alias("chosen"),
        F.col("agent_response").alias("rejected"), F.col("skill_used").alias("skill"))


def preference_dataset(corrections: DataFrame, log: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Op 94: recent corrections per skill, deduplicated over all parts
    (Q5), with the skill's recent low-rated count alongside."""
    pairs = (recent_corrections(corrections, as_of, days)
             .dropDuplicates(["skill", "prompt", "chosen", "rejected"])
             .select("skill", "prompt", "chosen", "rejected"))
    lows = (low_rated(log, as_of, days).groupBy(F.col("skill_used").alias("skill"))
            .agg(F.count("*").alias("low_rated_count")))
    return (pairs.join(lows, "skill", "left")
            .withColumn("low_rated_count", F.coalesce(F.col("low_rated_count"), F.lit(0))))


def enough_to_train(pairs: DataFrame, min_examples: int = 10, skill: str = "skill") -> DataFrame:
    """Op 60: skills whose distinct pair count reaches ``min_examples``."""
    return (pairs.groupBy(skill)
            .agg(F.countDistinct("prompt", "chosen", "rejected").alias("n_pairs"))
            .where(F.col("n_pairs") >= min_examples))


# --- examples (33, 36, 46, 74, 95) ----------------------------------------

def training_examples_filter(df: DataFrame, skill: str | None = None,
                             min_rating: int | None = None) -> DataFrame:
    """Op 33: optional skill and minimum rating; newest first."""
    if skill:
        df = df.where(F.col("skill_id") == skill)
    if min_rating:
        df = df.where(F.col("rating") >= min_rating)
    return df.orderBy(F.desc("created_at"), "id")


def exchange_pairs(turns: DataFrame, conv: str = "conv_id", order: str = "turn",
                   balanced: bool = True, bucket: int = 1024) -> DataFrame:
    """Op 46: each user turn with the following turn when it is the
    assistant's.

    Default (``balanced=True``): turns are cut into ranges of ``bucket``
    turn numbers, ``lead`` runs inside each (conversation, range) window, and
    the last turn of a range takes the first turn of the next non-empty range
    from a small per-range summary (one row per range).  Exact for any
    integer turn numbering, and one huge conversation is spread over all its
    ranges.  ``balanced=False``: plain ``lead`` over the whole conversation
    (one task per conversation).
    """
    if balanced:
        x = turns.select(conv, order, "role", "text").withColumn("__b", F.floor(F.col(order) / bucket))
        wb = Window.partitionBy(conv, "__b").orderBy(order)
        x = (x.withColumn("__lt", F.lead(order).over(wb))
             .withColumn("__lr", F.lead("role").over(wb)).withColumn("__lx", F.lead("text").over(wb)))
        firsts = x.groupBy(conv, "__b").agg(F.min_by(F.struct("role", "text"), F.col(order)).alias("__f"))
        wn = Window.partitionBy(conv).orderBy("__b")
        nxt = firsts.select(F.col(conv).alias("__c"), F.col("__b").alias("__bb"),
                            F.lead("__f").over(wn).alias("__nf"))
        x = x.join(nxt, (F.col(conv) == F.col("__c")) & (F.col("__b") == F.col("__bb")), "left")
        last = F.col("__lt").isNull()
        x = (x.withColumn("__nr", F.when(last, F.col("__nf.role")).otherwise(F.col("__lr")))
             .withColumn("__nt", F.when(last, F.col("__nf.text")).otherwise(F.col("__lx"))))
    else:
        w = Window.partitionBy(conv).orderBy(order)
        x = turns.select(conv, order, "role", "text",
                         F.lead("role").over(w).alias("__nr"), F.lead("text").over(w).alias("__nt"))
    return (x.where((F.col("role") == "user") & (F.col("__nr") == "assistant"))
            .select(conv, order, F.col("text").alias("user_input"), F.col("__nt").alias("agent_response")))


def examples_with_skill(examples: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Op 36: attach the skill's system prompt as instruction.

    Returns ``(joined, missing)`` – examples whose skill is unknown are
    reported by a ``left_anti`` join instead of failing the run.
    """
    sk = broadcast_if_small(skills.select(F.col("id").alias("skill_id"), "system_prompt"), "skills")
    joined = examples.join(sk, "skill_id", "inner").select(
        "skill_id", F.col("system_prompt").alias("instruction"),
        F.col("user_message").alias("input"), F.col("assistant_response").alias("output"))
    missing = examples.join(sk, "skill_id", "left_anti")
    return joined, missing


def all_training_examples(manual: DataFrame, extracted: DataFrame, skill: str | None = None) -> DataFrame:
    """Op 74: manual examples ∪ unarchived extracted items, source tagged.

    The approval flag is intentionally not used (all unarchived items
    train)."""
    a = manual.select("skill_id", "user_message", "assistant_response",
                      F.lit("training_data").alias("source"))
    b = extracted.where(~F.col("is_archived")).select(
        "skill_id", F.col("user_input").alias("user_message"), "assistant_response",
        F.lit("extracted_data").alias("source"))
    out = a.unionByName(b)
    return out.where(F.col("skill_id") == skill) if skill else out


def knowledge_examples(skills: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Op 95: Q/A rows from knowledge items plus five greeting rows per skill.

    ``knowledge`` is long form (skill_id, ord, item) so no per-skill list is
    ever assembled; greetings come from exploding a literal array.
    """
    sk = skills.select(F.col("id").alias("skill_id"), "name",
                       F.coalesce("system_prompt", F.lit("You are a helpful assistant.")).alias("instruction"))
    greet = sk.select("skill_id", "instruction",
                      F.explode(F.array(*[F.lit(g) for g in GREETINGS])).alias("input"),
                      F.concat(F.lit("Hello! I'm "), F.col("name"), F.lit(". How can I help you today?"))
                      .alias("output"), F.lit("greeting").alias("kind"))
    item = F.col("item")
    topic = F.when(item.contains(":"), F.substring_index(item, ":", 1)).otherwise(item)
    k = (knowledge.where(item.isNotNull() & (F.trim(item) != ""))
         .join(broadcast_if_small(sk, "skills"), "skill_id", "inner")
         .select("skill_id", "instruction", F.concat(F.lit("Tell me about "), topic).alias("input"),
                 item.alias("output"), F.lit("knowledge").alias("kind")))
    return greet.unionByName(k)


def recent_activity(df: DataFrame, n: int = 20, category: str | None = None, ts: str = "created_at",
                    id_col: str = "id", as_of=None) -> DataFrame:
    """Op 34: the newest ``n`` activity rows (optionally one category) with
    their "ago" text; planned as a top-k (TakeOrderedAndProject), not a sort."""
    x = df.where(F.col("category") == category) if category else df
    top = x.orderBy(F.desc(ts), F.desc(id_col)).limit(n)
    return time_ago(top, ts, as_of if as_of is not None else df.agg(F.max(ts)).scalar())


def nest_children(parent: DataFrame, child: DataFrame, key: str, order: Sequence[str],
                  out: str = "children") -> DataFrame:
    """Op 37: each parent row with its children as an ordered array.

    Children are grouped per key (one shuffle) and the parent is joined on
    the grouped side; the array of a parent is as large as its child set,
    so this is meant for bounded child sets (samples of a project, lines of
    an order)."""
    cols = [c for c in child.columns if c != key]
    g = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order],
                                                                     *[F.col(c) for c in cols if c not in order])))
                               .alias(out))
    return parent.join(g, key, "left").withColumn(out, F.coalesce(F.col(out), F.array()))
