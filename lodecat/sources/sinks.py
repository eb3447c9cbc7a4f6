"""Tables to files people and other programs read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecat.fixed import terms
from lodecat.functions.text import blank


def flat_columns(df: DataFrame, fields: Sequence[str], joint: str = ";") -> DataFrame:
    """Chosen fields; missing ones are empty, lists are joined."""
    out = []
    for f in fields:
        if f not in df.columns:
            out.append(F.lit("").alias(f))
        elif isinstance(df.schema[f].dataType, T.ArrayType):
            out.append(F.concat_ws(joint, F.col(f).cast("array<string>")).alias(f))
        else:
            out.append(F.col(f))
    return df.select(*out)


def write_json(df: DataFrame, path: str, fields: Sequence[str] = terms.EXPORT_FIELDS) -> None:
    """One JSON object per row (K1)."""
    df.select(*[F.col(f) if f in df.columns else F.lit("").alias(f) for f in fields]) \
        .write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_delimited(df: DataFrame, path: str, fields: Sequence[str] = terms.EXPORT_FIELDS,
                    kind: str = "tsv") -> None:
    """Tab or comma separated, lists joined with semicolons (K2)."""
    flat_columns(df, fields).write.mode("overwrite").csv(
        path, sep="\t" if kind == "tsv" else ",", header=True, escape='"', emptyValue="")


def plain_lines(df: DataFrame, fields: Sequence[str] = ("gse_id",)) -> DataFrame:
    """One value per line of the first field; lists give a line per item (K3)."""
    field = fields[0] if fields else "gse_id"
    value = F.col(field) if field in df.columns else F.lit("")
    if field in df.columns and isinstance(df.schema[field].dataType, T.ArrayType):
        value = F.explode(field)
    return df.select(value.alias("value")).select(blank(F.col("value").cast("string"))
                                                  .alias("value"))


def write_plain(df: DataFrame, path: str, fields: Sequence[str] = ("gse_id",)) -> None:
    plain_lines(df, fields).write.mode("overwrite").text(path)


def download_manifest(df: DataFrame) -> DataFrame:
    """One row per thing to fetch: studies and supplementary folders of public datasets,
    and a notice per controlled study (K4)."""
    controlled = F.col("access_type") == "controlled"
    kind = lambda k, target, command: F.struct(
        F.lit(k).alias("kind"), target.alias("target"), command.alias("command"))
    fetch = lambda s: kind("study", s, F.concat(
        F.lit("prefetch "), s, F.lit(" && fasterq-dump --split-files --outdir "), s, F.lit(" "), s))
    notice = lambda s: kind("controlled", s, F.concat(
        F.lit("# "), s, F.lit(" - requires dbGaP authorization")))
    stem = F.expr("left(gse_id, length(gse_id) - 3)")
    url = F.concat(F.lit("https://ftp.ncbi.nlm.nih.gov/geo/series/"), stem, F.lit("nnn/"),
                   F.col("gse_id"), F.lit("/suppl/"))
    folder = F.array(kind("supplementary", F.col("gse_id"),
                          F.concat(F.lit("wget -r -np -nH --cut-dirs=4 "), url)))
    none = F.array(kind("none", F.col("gse_id"),
                        F.concat(F.lit("# "), F.col("gse_id"), F.lit(": No SRA IDs found"))))
    studies = F.when(F.size("sra_ids") > 0, F.transform("sra_ids", fetch)).otherwise(none)
    has_folder = F.col("has_gse") & ~F.startswith("gse_id", F.lit("SRP:"))
    empty = F.slice(folder, 1, 0)
    jobs = F.when(controlled, F.transform("sra_ids", notice)).otherwise(
        F.concat(studies, F.when(has_folder, folder).otherwise(empty)))
    return df.select("gse_id", F.inline(jobs))


def result_csv_columns(df: DataFrame) -> DataFrame:
    """The 25 columns of a result file; lists joined with bars, scores with four digits (K5).

    ``df`` carries its rank already.
    """
    out = flat_columns(df, terms.RESULT_CSV_FIELDS, "|")
    return out.withColumns({c: F.format_string("%.4f", F.col(c))
                            for c in ("relevance_score", "total_score")})


def write_search_csv(df: DataFrame, path: str) -> None:
    result_csv_columns(df).write.mode("overwrite").csv(path, header=True, escape='"',
                                                       emptyValue="")


# Fields of the short result payload.
ID_PAYLOAD = ["gse_id", "title", "organism", "data_type", "sample_count", "single_cell",
              "relevance_score", "total_score"]


def json_view(df: DataFrame, fields: Sequence[str] | None = None) -> Column:
    """A row as JSON, nulls written out (K6)."""
    return F.to_json(F.struct(*(fields or df.columns)), {"ignoreNullFields": "false"})


def result_summary(ranked: DataFrame, top_n: int = 10) -> DataFrame:
    """Top rows of a ranked result as short payloads, for the head of a report (K7)."""
    top = ranked.filter(F.col("rank") <= top_n)
    return top.select("rank", json_view(top, ID_PAYLOAD).alias("payload"))


def result_json(ranked: DataFrame, query: str, top_n: int, searched_at: str,
                expansions: Sequence[str] = ()) -> DataFrame:
    """One JSON document for a ranked, cut result (K9).

    The list holds at most ``top_n`` rows: the cut is what a result page is.
    """
    from lodecat.operators.aggregates import result_stats
    page = ranked.filter(F.col("rank") <= top_n)
    rows = page.select(F.struct("rank", F.struct(*ID_PAYLOAD).alias("row")).alias("r")).agg(
        F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("results"))
    stats = result_stats(page).select(F.struct("*").alias("stats"))
    body = F.struct(
        F.lit(query).alias("query"), F.col("stats.total_found").alias("total_found"),
        "results", "stats", F.array(*[F.lit(e) for e in expansions]).cast("array<string>")
        .alias("expanded_queries"),
        F.left(F.sha2(F.lit(f"{query}|{searched_at}"), 256), F.lit(12)).alias("query_hash"),
        F.lit(searched_at).alias("searched_at"))
    return (rows.withColumn("_k", F.lit(1)).join(stats.withColumn("_k", F.lit(1)), "_k")
            .select(F.to_json(body).alias("document")))


def export(datasets: DataFrame, path: str, kind: str = "tsv",
           fields: Sequence[str] | None = None, edges: DataFrame | None = None,
           topic_id: str | None = None, limit: int | None = None, **filters) -> DataFrame:
    """Filter, cut if a limit is given, and write in one go; returns what was written (K8)."""
    from lodecat.operators.filters import list_datasets
    rows = list_datasets(datasets, edges, topic_id, limit=limit, **filters)
    fields = list(fields or terms.EXPORT_FIELDS)
    if kind == "json":
        write_json(rows, path, fields)
    elif kind in ("tsv", "csv"):
        write_delimited(rows, path, fields, kind)
    elif kind == "plain":
        write_plain(rows, path, fields)
    elif kind == "script":
        download_manifest(rows).select("command").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown export kind: {kind}")
    return rows
