"""Changes to stored tables, written as new tables.

The upsert is a fold: per column a rule says which of several values of a key survives.  The
rules are associative, so rows of one batch, of many batches and of the stored table fold
alike, in one shuffle with partial aggregation, however many versions a key has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecat.operators.order import first_per_key, one_per_key, sortable

LONGER_WINS = ("abstract", "overall_design")
ALWAYS_NEW = ("last_updated", "version", "change_log", "availability_status",
              "availability_note", "availability_checked_at", "access_type", "has_gse",
              "metadata_hash", "series_matrix_available")
ALWAYS_OLD = ("first_seen_at",)


def _survivor(field: T.StructField, order: Column) -> Column:
    name, kind, value = field.name, field.dataType, F.col(field.name)
    if name in ALWAYS_OLD:
        return F.min_by(value, F.when(value.isNotNull(), order))
    if name in LONGER_WINS:
        place = F.struct(F.length(value).alias("n"), (-order).alias("first"))
        return F.max_by(value, F.when(value.isNotNull(), place))
    if name in ALWAYS_NEW:
        return F.max_by(value, order)
    if isinstance(kind, T.StringType):
        given = (value != "") & ((value != "unknown") if name == "omics_granularity"
                                 else F.lit(True))
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        given = F.size(value) > 0
    elif isinstance(kind, T.NumericType):
        given = value > 0
    else:
        given = value.isNotNull()
    empty = F.min_by(value, order)
    return F.coalesce(F.max_by(value, F.when(given, order)), empty)


def fold_versions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key out of all its versions; ``order`` is a unique number per key."""
    fields = [f for f in rows.schema.fields if f.name not in (key, order)]
    return rows.groupBy(key).agg(
        *[_survivor(f, F.col(order)).alias(f.name) for f in fields])


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "gse_id",
           order: str = "arrival") -> DataFrame:
    """Stored rows updated by incoming ones (U1).  Columns one side lacks are filled with
    nulls, which never win over a value (P9)."""
    old = stored.withColumn(order, F.lit(-1).cast("long"))
    both = old.unionByName(incoming.withColumn(order, F.col(order).cast("long")),
                           allowMissingColumns=True)
    return fold_versions(both, key, order)


def metadata_hash(fields: Sequence[str], lists: Sequence[str] = ()) -> Column:
    """First 16 hex digits over the fields, lists sorted."""
    parts = [*[F.col(f).alias(f) for f in fields],
             *[F.array_sort(F.col(f)).alias(f) for f in lists]]
    return F.left(F.sha2(F.to_json(F.struct(*parts)), 256), F.lit(16))


def detect_changes(stored: DataFrame, incoming: DataFrame, key: str = "gse_id",
                   order: Sequence[Column] | None = None) -> DataFrame:
    """Incoming rows with version and change flag against the stored hash (U15); of several of one
    key the last by ``order``, so that one version follows another."""
    before = stored.select(key, F.col("metadata_hash").alias("_old"),
                           F.col("version").alias("_version"))
    changed = F.coalesce(F.col("_old") != F.col("metadata_hash"), F.lit(False))
    return (one_per_key(incoming, [key], order).drop("version").join(before, key, "left")
            .withColumn("version", F.coalesce("_version", F.lit(0)) + F.when(
                F.col("_old").isNull() | changed, 1).otherwise(0))
            .withColumn("change", F.when(F.col("_old").isNull(), "new")
                        .when(changed, "changed").otherwise("same"))
            .drop("_old", "_version"))


def union_sources(sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """All given sources in their order; one that failed gives nothing."""
    parts = [df.withColumn("source_rank", F.lit(i))
             for i, df in enumerate(sources.values()) if df is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def insert_new(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert or ignore."""
    once = first_per_key(incoming, [key], sortable(incoming, [c for c in incoming.columns if c != key]))
    return stored.unionByName(once.join(stored.select(key), key, "left_anti"))


def insert_or_replace(stored: DataFrame, incoming: DataFrame, key: str,
                      order: Sequence[Column] | None = None) -> DataFrame:
    """Incoming rows replace stored ones of the same key; of several the last by ``order``."""
    once = one_per_key(incoming, [key], order)
    return stored.join(once.select(key), key, "left_anti").unionByName(once)


def append(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """History and logs only grow (U8)."""
    return stored.unionByName(incoming, allowMissingColumns=True)


def update_fields(stored: DataFrame, changes: DataFrame, key: str, fields: Sequence[str],
                  keep_when_empty: bool = True, order: Sequence[Column] | None = None) -> DataFrame:
    """Chosen fields by key (U9, U14); empty text and null keep the stored value.

    Of several changes of a key the last by ``order`` counts."""
    given = changes if order else changes.select(key, *fields)
    side = one_per_key(given, [key], order).select(key, F.lit(True).alias("_hit"),
                          *[F.col(f).alias(f"_c_{f}") for f in fields])
    out = stored.join(side, key, "left")
    new = {}
    for f in fields:
        value = F.col(f"_c_{f}")
        if keep_when_empty and isinstance(stored.schema[f].dataType, T.StringType):
            value = F.nullif(value, F.lit(""))
            new[f] = F.coalesce(value, F.col(f))
        elif keep_when_empty:
            new[f] = F.coalesce(value, F.col(f))
        else:
            new[f] = F.when(F.col("_hit"), value).otherwise(F.col(f))
    return out.withColumns(new).drop("_hit", *[f"_c_{f}" for f in fields])


def refresh(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Title if given, samples if any, availability open again for fetched rows."""
    side = one_per_key(fetched.select("gse_id", "title", "n_samples"), ["gse_id"]).select("gse_id", F.col("title").alias("_t"), F.col("n_samples").alias("_n"),
                          F.lit(True).alias("_hit"))
    return (stored.join(side, "gse_id", "left")
            .withColumn("title", F.coalesce(F.nullif("_t", F.lit("")), "title"))
            .withColumn("sample_count", F.when(F.col("_n") > 0, F.col("_n"))
                        .otherwise(F.col("sample_count")))
            .withColumn("availability_status", F.when(F.col("_hit"), "unverified")
                        .otherwise(F.col("availability_status")))
            .drop("_t", "_n", "_hit"))


def delete_topics(topics: DataFrame, edges: DataFrame,
                  gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and their edges go, datasets stay."""
    ids = gone.select("topic_id")
    return (topics.join(ids, "topic_id", "left_anti"), edges.join(ids, "topic_id", "left_anti"))


REPORT_KEY = ["query_hash", "mode", "sources"]


def query_hash(query: Column) -> Column:
    return F.left(F.sha2(query, 256), F.lit(16))


def save_reports(reports: DataFrame, items: DataFrame, new_reports: DataFrame,
                 new_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report for a known (query, mode, sources) keeps its id and changes its items; any
    other is added (U12).  Of several new reports of one key that of the greatest id stays, with
    its items."""
    new_reports = first_per_key(new_reports, REPORT_KEY, [F.col("report_id")], last=True)
    known = reports.select(*REPORT_KEY, F.col("report_id").alias("_known"))
    placed = new_reports.join(known, REPORT_KEY, "left").withColumn(
        "_id", F.coalesce("_known", "report_id"))
    moved = placed.select("report_id", "_id")
    heads = (reports.join(placed.select(*REPORT_KEY), REPORT_KEY, "left_anti")
             .unionByName(placed.withColumn("report_id", F.col("_id")).drop("_known", "_id")))
    fresh = (new_items.join(moved, "report_id").withColumn("report_id", F.col("_id"))
             .drop("_id"))
    kept = items.join(moved.select(F.col("_id").alias("report_id")), "report_id", "left_anti")
    return heads, kept.unionByName(fresh)


def delete_reports(reports: DataFrame, items: DataFrame, ids: DataFrame | None = None,
                   query: str | None = None,
                   mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports by id, or by query and mode, with their items."""
    if ids is None:
        hit = reports.filter(F.col("query_hash") == query_hash(F.lit(query)))
        ids = hit.filter(F.col("mode") == mode) if mode else hit
    gone = ids.select("report_id")
    return (reports.join(gone, "report_id", "left_anti"),
            items.join(gone, "report_id", "left_anti"))


def expire(rows: DataFrame, time: str, ttl_hours: float, as_of: datetime) -> DataFrame:
    """Rows not older than the time to live; rows without a time stay."""
    oldest = F.lit(as_of - timedelta(hours=ttl_hours)).cast("timestamp")
    return rows.filter(F.col(time).isNull() | (F.col(time) >= oldest))


def invalidate(index: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Cache entries without the given keys; without keys, none."""
    return index.limit(0) if keys is None else index.join(keys.select("key"), "key", "left_anti")
