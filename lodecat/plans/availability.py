"""Availability of datasets from landed study documents (C17)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecat.functions.parse import availability
from lodecat.operators.filters import to_check
from lodecat.operators.store import update_fields

FIELDS = ["availability_status", "access_type", "availability_note"]


def study_status(studies: DataFrame) -> DataFrame:
    """Status fields out of landed study XML in ``body``: one row per study."""
    text = F.concat_ws(" ", F.expr("xpath(body, '//STUDY//text()')"))
    return studies.select(
        "srp_id", F.lower(F.expr("xpath_string(body, '//STUDY/@status')")).alias("study_status"),
        text.alias("access_text"),
        F.expr("xpath_string(body, '//CONSENT')").alias("consent"),
        F.size(F.expr("xpath(body, '//RUN/@accession')")).alias("run_count"))


def check_availability(datasets: DataFrame, studies: DataFrame, min_samples: int = 1,
                       recheck: bool = False) -> DataFrame:
    """Result row per dataset that was due and whose study is known."""
    due = to_check(datasets, recheck).select("gse_id", "srp_id")
    state = availability(F.col("study_status"), F.col("access_text"), F.col("consent"),
                         F.col("run_count"), min_samples)
    return due.join(studies, "srp_id").select(
        "gse_id", "srp_id", *[v.alias(k) for k, v in state.items()])


def apply_checks(datasets: DataFrame, results: DataFrame, checked_at: datetime) -> DataFrame:
    """Check results written to the datasets."""
    stamped = results.withColumn("availability_checked_at", F.lit(checked_at).cast("timestamp"))
    fields = [f for f in [*FIELDS, "availability_checked_at"] if f in datasets.columns]
    return update_fields(datasets, stamped, "gse_id", fields, keep_when_empty=False)
