"""Review actions, their log, and the state they leave."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.operators.order import first_per_key, global_positions

PAIR = ["topic_id", "gse_id"]


def valid_transition(old: Column, new: Column) -> Column:
    """Allowed change, or none at all."""
    out = old == new
    for before, after in terms.REVIEW_TRANSITIONS:
        out = out | ((old == before) & (new == after))
    return out


def apply_actions(edges: DataFrame, actions: DataFrame) -> DataFrame:
    """Result row per action: old and new status, success, error, transition check.

    ``actions`` has action_id, topic_id, gse_id, action, new_status, note.  A transition
    outside the table is applied but marked.
    """
    current = (edges.groupBy(*PAIR).agg(
        F.min(F.coalesce("review_status", F.lit("pending"))).alias("old_status")))
    out = actions.join(current, PAIR, "left")
    valid = F.col("new_status").isin(*terms.REVIEW_STATUSES)
    known = F.col("old_status").isNotNull()
    return out.select(
        "action_id", *PAIR, "action",
        F.when(valid & known, F.col("old_status")).otherwise("").alias("old_status"),
        "new_status", "note", (valid & known).alias("success"),
        F.when(~valid, F.concat(F.lit("Invalid status: "), "new_status"))
        .when(~known, "No topic-dataset relation found").otherwise("").alias("error"),
        F.when(valid & known, valid_transition(F.col("old_status"), F.col("new_status")))
        .otherwise(False).alias("allowed"))


def batch_actions(edges: DataFrame, topic_id: str, status: str,
                  current_status: str | None = None,
                  ids: DataFrame | None = None) -> DataFrame:
    """One action per dataset of a topic, chosen by id list or by current status."""
    chosen = edges.filter(F.col("topic_id") == topic_id)
    if ids is not None:
        chosen = chosen.join(ids.select("gse_id"), "gse_id", "left_semi")
    elif current_status:
        chosen = chosen.filter(F.coalesce("review_status", F.lit("pending")) == current_status)
    return chosen.select(*PAIR).distinct().select(
        F.concat_ws(":", *PAIR).alias("action_id"), *PAIR, F.lit("batch_mark").alias("action"),
        F.lit(status).alias("new_status"), F.lit("").alias("note"))


def update_status(edges: DataFrame, results: DataFrame, as_of: datetime | None = None,
                  order: Sequence[Column] | None = None) -> DataFrame:
    """New status, note and time on every edge of each pair with a successful action (U16).

    Of several actions of a pair the last by ``order`` counts; without it, that of the greatest
    id, read as a number where it is one.  An empty note keeps the stored one.  Note and time
    change where the edges have ``review_note`` and ``reviewed_at``; the time needs ``as_of``.
    """
    by = order or [F.col("action_id").try_cast("decimal(38,0)"), F.col("action_id")]
    side = first_per_key(results.filter("success"), PAIR, by, last=True).select(
        *PAIR, F.col("new_status").alias("_new"), F.nullif("note", F.lit("")).alias("_note"))
    new = {"review_status": F.coalesce("_new", "review_status")}
    if "review_note" in edges.columns:
        new["review_note"] = F.coalesce("_note", "review_note")
    if "reviewed_at" in edges.columns and as_of is not None:
        time = F.lit(as_of).cast(edges.schema["reviewed_at"].dataType)
        new["reviewed_at"] = F.when(F.col("_new").isNotNull(), time).otherwise(F.col("reviewed_at"))
    return edges.join(side, PAIR, "left").withColumns(new).drop("_new", "_note")


def log_rows(results: DataFrame, as_of: datetime) -> DataFrame:
    """One log row per successful action, to be appended to the review log (U16)."""
    return results.filter("success").select(
        F.col("action_id").alias("log_id"), *PAIR, "action", "old_status", "new_status", "note",
        F.lit(as_of).cast("timestamp").alias("acted_at"))


def latest_entry(log: DataFrame) -> DataFrame:
    """Last log entry per topic and dataset."""
    return first_per_key(log, PAIR, [F.col("acted_at"), F.col("log_id")], last=True)


def review_state(log: DataFrame) -> DataFrame:
    """Current status per pair after all actions and undos, pending when all are undone.

    An undo takes the latest action that still stands.  Read from the end, with undo as +1
    and any other action as -1, the surviving action is the first at which the sum reaches
    -1.  The sums run over the whole log ordered by pair and time, so one pair with very
    many actions spreads over tasks.
    """
    step = F.when(F.col("action") == "undo", 1).otherwise(-1)
    placed = global_positions(
        log, [F.col("topic_id"), F.col("gse_id"), F.col("acted_at"), F.col("log_id")], "_at",
        {"_through": step.cast("long")})
    ends = placed.groupBy(*PAIR).agg(F.max_by("_through", "_at").alias("_end"))
    own = F.when(F.col("action") == "undo", 1).otherwise(-1)
    after = placed.join(ends, PAIR).withColumn(
        "_suffix", F.col("_end") - F.col("_through") + own)
    standing = after.filter((F.col("_suffix") == -1) & (F.col("action") != "undo"))
    top = standing.groupBy(*PAIR).agg(F.max_by("new_status", "_at").alias("status"))
    return (ends.select(*PAIR).join(top, PAIR, "left")
            .withColumn("status", F.coalesce("status", F.lit("pending"))))
