"""Reports on topics and results, as tables and as text of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.functions.text import blank
from lodecat.operators import aggregates as agg
from lodecat.operators.joins import topic_view
from lodecat.operators.order import global_positions


def topic_report(edges: DataFrame, datasets: DataFrame,
                 topic_id: str | None = None) -> DataFrame:
    """(topic_id, section, item, n): totals, review states and availability per topic."""
    view = topic_view(edges, datasets, topic_id)
    totals = view.groupBy("topic_id").agg(F.count(F.lit(1)).alias("datasets"))
    review = agg.review_summary(edges if topic_id is None
                                else edges.filter(F.col("topic_id") == topic_id), ["topic_id"])
    access = agg.topic_availability(view, ["topic_id"])

    def long(df: DataFrame, section: str) -> DataFrame:
        items = [c for c in df.columns if c != "topic_id"]
        return df.select("topic_id", F.lit(section).alias("section"), F.inline(F.array(*[
            F.struct(F.lit(i).alias("item"), F.col(i).cast("long").alias("n")) for i in items])))

    return (long(totals, "total").unionByName(long(review.drop("total"), "review"))
            .unionByName(long(access, "availability")))


def topic_lines(edges: DataFrame, datasets: DataFrame, topic_id: str) -> DataFrame:
    """Display rows of one topic: cut titles and status marks."""
    mark = lambda col, pairs: F.coalesce(
        *[F.when(F.col(col) == k, v) for k, v in pairs.items()], F.lit("[?]"))
    view = topic_view(edges, datasets, topic_id)
    return view.select(
        "gse_id", F.left(blank(F.col("title")), F.lit(50)).alias("title"), "organism",
        "omics_type", F.when(F.col("sample_count") > 0, F.col("sample_count").cast("string"))
        .otherwise("").alias("samples"),
        F.left(blank(F.col("platform")), F.lit(20)).alias("platform"),
        mark("availability_status", {"available": "[OK]", "unavailable": "[X]",
                                     "restricted": "[!!]"}).alias("availability"),
        mark("review_status", {"approved": "[OK]", "irrelevant": "[--]", "deleted": "[DEL]",
                               "pending": "[...]"}).alias("review"), "added_at")


def summary_report(datasets: DataFrame, topics: DataFrame) -> DataFrame:
    """(section, item, n): sizes, availability counts and the ten commonest organisms."""
    long = lambda df, section, item: df.select(
        F.lit(section).alias("section"), F.col(item).alias("item"), "n")
    return (long(agg.overview(datasets, topics), "overview", "what")
            .unionByName(long(agg.availability_counts(datasets), "availability",
                              "availability_status"))
            .unionByName(long(agg.top_organisms(datasets), "organisms", "organism")))


def report_lines(table: DataFrame, title: str, order: Sequence[str | Column]) -> DataFrame:
    """(line_no, line): a whole report table as text for people, every row of it.

    Rows are numbered by one total order cut into ranges, so no task holds the report.  Line
    breaks in a cell become blanks and bars are escaped; a null cell is empty.
    """
    cell = lambda name: F.regexp_replace(F.regexp_replace(blank(
        F.col(name).cast("string")), r"[\r\n]+", " "), r"\|", r"\\|")
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, table.columns)), F.lit(" |"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    head = [f"# {title}", "", f"| {' | '.join(table.columns)} |", "|" + "---|" * len(table.columns)]
    top = table.sparkSession.range(1).select(
        F.posexplode(F.array(*map(F.lit, head))).alias("n", "line")).select(
        (F.col("n") + 1).cast("long").alias("line_no"), "line")
    return top.unionByName(global_positions(table, keys, "_n").select(
        (F.col("_n") + len(head)).cast("long").alias("line_no"), body.alias("line")))


def write_report(lines: DataFrame, folder: str) -> None:
    """Text files that give the report when read one after the other by name."""
    (lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line")
     .write.mode("overwrite").text(folder))


def evaluate(results: DataFrame) -> DataFrame:
    """Results per verdict."""
    text = F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("abstract"))))
    return results.select(agg.verdict(text).alias("verdict")).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"))
