"""Selections over catalogue, topic and review tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodecat.fixed import terms
from lodecat.functions.normalize import catalogue_species
from lodecat.functions.parse import loose_date
from lodecat.functions.text import blank, has_any


@dataclass(frozen=True)
class Rule:
    """Include set, exclude set and range on one field (F2)."""
    field: str
    allowed: tuple | None = None
    excluded: tuple | None = None
    at_least: float | None = None
    at_most: float | None = None

    def column(self, df: DataFrame) -> Column:
        """Missing values fail an include set and pass the rest; ranges read numbers only."""
        present = self.field in df.columns
        value = F.col(self.field) if present else F.lit(None)
        numeric = present and isinstance(df.schema[self.field].dataType, NumericType)
        parts = [F.lit(True)]
        if self.excluded:
            parts.append(~F.coalesce(value.isin(*self.excluded), F.lit(False)))
        if self.allowed is not None:
            parts.append(F.coalesce(value.isin(*self.allowed), F.lit(False)))
        if numeric and self.at_least is not None:
            parts.append(F.coalesce(value >= self.at_least, F.lit(True)))
        if numeric and self.at_most is not None:
            parts.append(F.coalesce(value <= self.at_most, F.lit(True)))
        return reduce(lambda a, b: a & b, parts)


class Filters:
    """Rules and predicates that are combined with AND."""

    def __init__(self, parts: Iterable[Rule | Column] = ()):
        self.parts = list(parts)

    def add(self, part: Rule | Column) -> Filters:
        self.parts.append(part)
        return self

    def _one_of(self, field: str, value) -> Filters:
        return self.add(Rule(field, (value,) if value else None))

    def organism(self, name: str) -> Filters:
        return self._one_of("organism", name)

    def data_type(self, name: str) -> Filters:
        return self._one_of("data_type", name)

    def single_cell(self, wanted: bool = True) -> Filters:
        return self._one_of("single_cell", wanted)

    def perturbation(self, wanted: bool = True) -> Filters:
        return self._one_of("has_perturbation", wanted)

    def min_samples(self, n: int) -> Filters:
        return self.add(Rule("sample_count", at_least=n))

    def min_quality(self, score: float = 0.5) -> Filters:
        return self.add(Rule("quality_score", at_least=score))

    def clear(self) -> Filters:
        self.parts.clear()
        return self

    def column(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b,
                      [p.column(df) if isinstance(p, Rule) else p for p in self.parts],
                      F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.column(df))

    def account(self, df: DataFrame) -> DataFrame:
        """total, after_filter and filtered_out in one pass."""
        kept = F.count_if(self.column(df))
        total = F.count(F.lit(1))
        return df.agg(total.alias("total"), kept.alias("after_filter"),
                      (total - kept).alias("filtered_out"))


PRESETS = {
    "quality": lambda: Filters().min_quality(0.3),
    "single_cell": lambda: Filters().single_cell(),
    "perturbation": lambda: Filters().perturbation(),
    "human": lambda: Filters().organism("Homo sapiens"),
}


def list_datasets(datasets: DataFrame, edges: DataFrame | None = None,
                  topic_id: str | None = None, review_status: str | None = None,
                  availability: str | None = None, access_type: str | None = None,
                  granularity: str | None = None, organism: str | None = None,
                  min_samples: int | None = None, limit: int | None = 50,
                  offset: int = 0) -> DataFrame:
    """Datasets by topic and field, newest first, one page.

    The sample filter comes before the page is cut.
    """
    out = datasets
    for field, value in (("availability_status", availability), ("access_type", access_type),
                         ("omics_granularity", granularity)):
        if value:
            out = out.filter(F.col(field) == value)
    if organism:
        out = out.filter(F.contains(F.lower("organism"), F.lit(organism.lower())))
    if min_samples is not None:
        out = out.filter(F.col("sample_count") >= min_samples)
    if topic_id:
        chosen = edges.filter(F.col("topic_id") == topic_id)
        if review_status:
            chosen = chosen.filter(F.col("review_status") == review_status)
        out = out.join(chosen.select("gse_id"), "gse_id", "left_semi")
    out = out.orderBy(F.col("last_updated").desc(), F.col("gse_id"))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def between_dates(df: DataFrame, field: str, since: date | None = None,
                  until: date | None = None) -> DataFrame:
    """Rows inside the dates; rows without a readable date pass."""
    day = loose_date(F.col(field))
    keep = F.lit(True)
    if since:
        keep = keep & (day.isNull() | (day >= F.lit(since)))
    if until:
        keep = keep & (day.isNull() | (day <= F.lit(until)))
    return df.filter(keep)


def study_predicate(organisms: Sequence[str] = (), since: date | None = None,
                    until: date | None = None, strict: bool = False) -> Column:
    """Public studies with data on one vendor's machines, as a predicate over study rows
    (F11).  Names of organisms may be common or scientific."""
    keep = ((F.col("access_type") == "public") & (F.col("run_count") > 0)
            & F.contains(F.lower("platform"), F.lit("illumina")))
    if organisms:
        known = F.coalesce(catalogue_species(F.col("organism")), F.col("organism"))
        wanted = [F.coalesce(catalogue_species(F.lit(o)), F.lit(o)) for o in organisms]
        keep = keep & known.isin(*wanted)
    if since and until:
        keep = keep & loose_date(F.col("publication_date")).between(F.lit(since), F.lit(until))
    if strict:
        keep = keep & ~has_any(F.lower(blank(F.col("title"))), terms.LOW_THROUGHPUT)
    return keep


def boolean_terms(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """(a OR b) AND (c OR d) over a lower-cased text."""
    return reduce(lambda a, b: a & b,
                  [has_any(text, [t.lower() for t in g]) for g in groups if g], F.lit(True))


def boolean_terms_column(text: Column, groups: Column) -> Column:
    """The same with the term groups in a column."""
    return F.forall(groups, lambda g: F.exists(g, lambda t: F.contains(text, F.lower(t))))


def review_listing(edges: DataFrame, datasets: DataFrame, status: str = "pending",
                   topic_id: str | None = None, limit: int = 50) -> DataFrame:
    """Edges of one review status with their dataset columns."""
    chosen = edges.filter(F.coalesce("review_status", F.lit("pending")) == status)
    if topic_id:
        chosen = chosen.filter(F.col("topic_id") == topic_id)
    newest = F.col("added_at").desc() if topic_id or status == "pending" \
        else F.col("reviewed_at").desc_nulls_last()
    return chosen.join(datasets, "gse_id").orderBy(newest, "edge_id").limit(limit)


def review_log(log: DataFrame, topic_id: str | None = None, gse_id: str | None = None,
               limit: int = 20) -> DataFrame:
    """Newest log entries."""
    if topic_id:
        log = log.filter(F.col("topic_id") == topic_id)
    if gse_id:
        log = log.filter(F.col("gse_id") == gse_id)
    return log.orderBy(F.col("acted_at").desc(), F.col("log_id").desc()).limit(limit)


def to_check(datasets: DataFrame, recheck: bool = False) -> DataFrame:
    """Datasets with a study id whose availability is open (F16)."""
    study = F.get(F.filter("sra_ids", lambda x: x.rlike("^(SRP|ERP|DRP)")), F.lit(0))
    open_ = F.coalesce("availability_status", F.lit("")).isin("", "unverified")
    out = datasets.withColumn("srp_id", study).filter(F.col("srp_id").isNotNull())
    return out if recheck else out.filter(open_)
