"""Set operations and table changes as functions from a table and a change
set to the new table (SURVEY §2 ops 43-44, 68-69, 75-79).

There is no row-level UPDATE on parquet here, so every change is one
join plan over the whole table – never a loop over keys.  Id sets are
joined without a forced broadcast: they may be as large as the table,
and AQE switches to a broadcast at run time when they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_ids(df: DataFrame, ids: DataFrame, skill: str | None = None, key: str = "id") -> DataFrame:
    """Op 43: rows whose id is in the id set (and skill) – ``id = ANY(…)``."""
    k = ids.select(F.col(key).alias(key)).distinct()
    out = df.join(k, key, "left_semi")
    return out.where(F.col("skill_id") == skill) if skill is not None else out


def rows_to_retire(df: DataFrame, keep: DataFrame, key: str = "id") -> DataFrame:
    """Op 44: rows whose id is not in the keep set (null-safe anti join,
    unlike SQL ``NOT IN`` which returns nothing when the set holds a null)."""
    return df.join(keep.select(key), key, "left_anti")


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Op 68: last write wins per key.

    ``max_by`` over a struct of the ordering columns is a plain hash
    aggregate with map-side partial results – a hot key is reduced on the
    map side instead of being sorted in one task like a window would be.
    """
    ocols = [F.col(o) if isinstance(o, str) else o for o in order]
    data_cols = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in data_cols])
    g = df.groupBy(*keys).agg(F.max_by(packed, F.struct(*ocols)).alias("__row"))
    return g.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in data_cols])


def _row_hash(columns: Sequence[str], schema) -> Column:
    """A hash of a row, to choose among rows that nothing else tells apart."""
    return F.xxhash64(*[F.to_json(c) if schema[c].dataType.simpleString().startswith(("map", "struct<", "array<map")) else F.col(c) for c in columns])


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """The last row of each key by ``order``; among equals, the same one in every
    run (by a hash of the row), so that a retried task cannot choose another."""
    data = [c for c in df.columns if c not in keys]
    if not data:
        return df.dropDuplicates(list(keys))
    return latest_by_key(df, keys, [*order, _row_hash(data, df.schema)])


def merge_by_priority(sources: Sequence[tuple[str, DataFrame]], key: str,
                      priority: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Op 69: union of sources; per key the row of the highest-priority
    source wins and ``source`` tells which (Q8: priority is a parameter).

    Default priority is the order of ``sources``.  Of several rows of a key in
    one source the last by the ``order`` columns wins (a null comes first, as in
    a source that lacks the column); among equals one and the same in every run.
    """
    names = [n for n, _ in sources]
    prio = list(priority or names)
    rank = {n: i for i, n in enumerate(prio)}
    u = None
    for name, d in sources:
        d = d.withColumn("source", F.lit(name)).withColumn("__prio", F.lit(rank.get(name, len(prio))))
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    data_cols = [c for c in u.columns if c not in (key, "__prio")]
    last = F.struct(-F.col("__prio"), *order, _row_hash(data_cols, u.schema))
    g = u.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in data_cols]), last).alias("__row"))
    return g.select(key, *[F.col(f"__row.{c}").alias(c) for c in data_cols])


def distinct_ids(*dfs: DataFrame, key: str = "id") -> DataFrame:
    """Op 75: the set of ids over all sources."""
    u = None
    for d in dfs:
        s = d.select(F.col(key).alias(key))
        u = s if u is None else u.union(s)
    return u.distinct()


def insert_new_only(base: DataFrame, new: DataFrame, key: str = "id", order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Op 76: insert rows whose key is absent (``ON CONFLICT DO NOTHING``).

    Returns ``(table, inserted)``; inserting the same batch twice inserts
    nothing the second time.  Of duplicates inside the batch the last by
    ``order`` is kept, among equals one and the same in every run.
    """
    fresh = one_per_key(new, [key], order).select(*new.columns).join(base.select(key), key, "left_anti")
    return base.unionByName(fresh.select(*base.columns)), fresh


def upsert_rows(base: DataFrame, new: DataFrame, key: str | Sequence[str],
                reset: Sequence[str] = ()) -> DataFrame:
    """Op 77: on key match the new row's values replace the old ones;
    unmatched new rows are inserted.  Columns listed in ``reset`` take the
    new value even when it is null; other columns keep the old value when
    the new one is null."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in cols], F.lit(True).alias("__in_b"))
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") if c in new.columns else F.lit(None).alias(f"__n_{c}")
                            for c in cols], F.lit(True).alias("__in_n"))
    j = b.join(n, keys, "full_outer")
    out = []
    for c in cols:
        matched = F.col("__in_n").isNotNull()
        if c in reset:
            v = F.when(matched, F.col(f"__n_{c}")).otherwise(F.col(f"__b_{c}"))
        else:
            v = F.coalesce(F.col(f"__n_{c}"), F.col(f"__b_{c}"))
        out.append(v.cast(base.schema[c].dataType).alias(c))
    return j.select(*keys, *out)


def patch_rows(base: DataFrame, patches: DataFrame, key: str, allowed: Sequence[str],
               as_of, updated_col: str = "updated_at", order: Sequence[str] = (), nulls: str = "set_null") -> DataFrame:
    """Op 78: partial update from whitelisted columns; other patch columns
    are ignored; patched rows get ``updated_at = as_of``.

    A null in a patch leaves the column as it is; allowed columns that its array
    column ``nulls`` (if any) names become null.  Several patches of a key are
    applied in ``order``: each column takes its newest value or null marker;
    without an order, or among equals, by a hash, the same in every run."""
    cols = [c for c in allowed if (c in patches.columns or nulls in patches.columns) and c in base.columns]
    marked = (lambda c: F.coalesce(F.array_contains(nulls, c), F.lit(False))) if nulls in patches.columns else lambda c: F.lit(False)
    at = F.struct(*order, _row_hash([c for c in patches.columns if c != key] or [key], patches.schema))
    value = lambda c: F.col(c) if c in patches.columns else F.lit(None).cast(base.schema[c].dataType)
    said = {c: F.struct(marked(c).alias("gone"), F.when(~marked(c), value(c)).alias("v")) for c in cols}
    p = patches.groupBy(F.col(key).alias("__pk")).agg(F.lit(True).alias("__hit"), *[
        F.max_by(said[c], F.when(marked(c) | value(c).isNotNull(), at)).alias(f"__p_{c}") for c in cols])
    j = base.join(p, base[key] == p["__pk"], "left")
    hit = F.col("__pk").isNotNull()
    out = []
    for c in base.columns:
        if c in cols:
            new = F.col(f"__p_{c}")
            out.append(F.when(hit & new["gone"], F.lit(None)).otherwise(F.coalesce(new["v"].cast(base.schema[c].dataType), F.col(c))).alias(c))
        elif c == updated_col:
            continue
        else:
            out.append(F.col(c))
    prev = F.col(updated_col) if updated_col in base.columns else F.lit(None).cast("timestamp_ntz")
    out.append(F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(prev).alias(updated_col))
    return j.select(*out)


def delete_rows(base: DataFrame, ids: DataFrame, soft: bool = True, guard: str | None = "is_builtin",
                flag: str = "is_active", key: str = "id",
                children: DataFrame | None = None, child_fk: str | None = None
                ) -> tuple[DataFrame, DataFrame | None]:
    """Op 79: soft (flag) or hard delete of an id set; guarded rows (e.g.
    built-ins) are never deleted; optional cascade removes the children of
    hard-deleted parents.  Returns ``(parents, children)``."""
    target = ids.select(F.col(key).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    j = base.join(target, base[key] == target["__id"], "left")
    sel = F.coalesce(F.col("__hit"), F.lit(False))
    if guard:
        sel = sel & ~F.coalesce(F.col(guard), F.lit(False))
    j = j.withColumn("__sel", sel).drop("__id", "__hit")
    if soft:
        parents = j.withColumn(flag, F.when(F.col("__sel"), F.lit(False))
                               .otherwise(F.coalesce(F.col(flag), F.lit(True)) if flag in base.columns
                                          else F.lit(True))).drop("__sel")
        return parents, children
    parents = j.where(~F.col("__sel")).drop("__sel")
    if children is None:
        return parents, None
    gone = j.where(F.col("__sel")).select(F.col(key).alias(child_fk))
    return parents, children.join(gone, child_fk, "left_anti")
