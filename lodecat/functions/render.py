"""Text for people and for scoring models: truncation, sizes, sentences, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodecat.functions.text import blank


def shorten(col: Column, n: int, tail: str = "...") -> Column:
    """At most ``n`` characters, with ``tail`` when cut."""
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n)), F.lit(tail))).otherwise(col)


def dash_if_empty(col: Column) -> Column:
    return F.when(blank(col) == "", "—").otherwise(col)


def count_or_dash(n: Column) -> Column:
    return F.when(n > 0, n.cast("string")).otherwise("—")


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
            .when(n < 1 << 20, F.format_string("%.1fKB", n / 1024.0))
            .when(n < 1 << 30, F.format_string("%.1fMB", n / float(1 << 20)))
            .otherwise(F.format_string("%.2fGB", n / float(1 << 30))))


def inference_sentence(disease: Column, organ: Column, assay: Column, granularity: Column,
                       platform: Column, samples: Column, groups: Column,
                       ready: Column, n_groups: Column | None = None) -> Column:
    """One line that says what was inferred.

    ``groups`` may hold only the first three when ``n_groups`` tells how many there are.
    """
    n_groups = F.size(groups) if n_groups is None else n_groups
    known = lambda c: blank(c).isin("", "unknown") == F.lit(False)
    head = (F.when(known(disease) & known(organ), F.concat_ws(" ", disease, organ, F.lit("dataset")))
            .when(known(disease), F.concat_ws(" ", disease, F.lit("dataset")))
            .when(known(organ), F.concat_ws(" ", organ, F.lit("dataset"))))
    kind = F.when(known(assay), F.when(known(granularity) & (granularity != "bulk"),
                                       F.concat_ws(" ", granularity, assay)).otherwise(assay))
    using = F.when(blank(platform) != "", F.concat(F.lit("using "), platform))
    shown = F.array_join(F.transform(F.slice(groups, 1, 3), lambda g: F.concat(
        g["name"], F.lit(" (n="), g["n"].cast("string"), F.lit(")"))), ", ")
    more = F.when(n_groups > 3, F.concat(
        F.lit(" +"), (n_groups - 3).cast("string"), F.lit(" more"))).otherwise("")
    count = F.concat(samples.cast("string"), F.lit(" samples"))
    sized = F.when(samples > 0, F.when(F.size(groups) > 0, F.concat(
        count, F.lit(": "), shown, more)).otherwise(count))
    ready_text = F.when(ready, "suitable for comparative analysis")
    line = F.concat_ws("; ", head, kind, using, sized, ready_text)
    return F.when(line == "", "Dataset with limited metadata").otherwise(line)


def boolean_group(terms: Column, most: int | None = None, quoted: bool = False) -> Column:
    """``(a OR b)``, null for no terms."""
    kept = F.slice(terms, 1, most) if most else terms
    if quoted:
        kept = F.transform(kept, lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(terms) > 0, F.concat(
        F.lit("("), F.array_join(kept, " OR "), F.lit(")")))


def boolean_query(*groups: Column) -> Column:
    return F.concat_ws(" AND ", *groups)


def relaxed(query: Column, words) -> Column:
    """Restrictive words dropped; a star appended when none was there."""
    tokens = F.filter(F.split(F.trim(query), r"\s+"), lambda t: ~F.lower(t).isin(*words))
    out = F.array_join(tokens, " ")
    return F.when(out == query, F.concat(query, F.lit("*"))).otherwise(out)


def refined(query: Column, words) -> Column:
    """Each modifier that is not in the query yet is appended in order."""
    out = query
    for word in words:
        out = F.when(F.contains(F.lower(out), F.lit(word)), out).otherwise(
            F.concat(out, F.lit(f" {word}")))
    return out


def score_prompt(query: str) -> Column:
    """Facts of one record for a scoring model."""
    c = F.col
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    or_unknown = lambda col: F.when(blank(col) == "", "unknown").otherwise(col)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(
        c("supplementary_files"), lambda f: or_unknown(f["type"])))), ", ")
    return F.concat_ws(
        "\n", F.lit(f"Query: {query}"), line("Title", c("title")),
        line("Summary", shorten(blank(c("summary")), 500)),
        line("Design", F.left(blank(c("overall_design")), F.lit(200))),
        line("Organism", or_unknown(c("organism"))),
        line("Data type", or_unknown(c("data_type"))),
        line("Granularity", or_unknown(c("granularity"))),
        line("Disease", or_unknown(c("disease"))), line("Tissue", or_unknown(c("tissue"))),
        line("Perturbation", F.when(c("has_perturbation"), F.concat(
            F.lit("Yes ("), F.array_join("perturbation_types", ", "), F.lit(")")))
            .otherwise("No")),
        line("Samples", c("sample_count").cast("string")),
        line("Files", F.left(F.when(F.size("supplementary_files") > 0, kinds)
                             .otherwise("none"), F.lit(100))),
        line("Series matrix", F.when(c("series_matrix_available"), "available")
             .otherwise("not available")),
        line("Year", or_unknown(F.left(blank(c("publication_date")), F.lit(4)))),
        line("Keywords", F.when(F.size("keywords") > 0, F.array_join(
            F.slice("keywords", 1, 10), ", ")).otherwise("none")))


def analysis_prompt(query: str) -> Column:
    """Facts of one record and its first twenty samples for an analysing model."""
    c = F.col
    files = F.array_join(F.transform(F.slice("supplementary_files", 1, 10), lambda f: F.concat(
        F.left(blank(f["name"]), F.lit(60)), F.lit("("), blank(f["type"]), F.lit(")"))), "; ")
    samples = F.array_join(F.transform(F.slice("samples", 1, 20), lambda s: F.concat(
        F.lit("- "), s["gsm_id"], F.lit(": "), F.left(blank(s["title"]), F.lit(80)))), "\n")
    return F.concat_ws(
        "\n", F.concat(F.lit("Record: "), c("gse_id")), F.concat(F.lit("Title: "), c("title")),
        F.concat(F.lit("Summary: "), F.left(blank(c("summary")), F.lit(500))),
        F.concat(F.lit("Design: "), F.left(blank(c("overall_design")), F.lit(300))),
        F.concat(F.lit("Samples: "), c("sample_count").cast("string")),
        F.concat(F.lit("Files: "), F.when(F.size("supplementary_files") > 0, files)
                 .otherwise("none")),
        F.concat(F.lit("Sample list:\n"), F.when(F.size("samples") > 0, samples)
                 .otherwise("none")),
        F.lit(f"Query: {query}"))


def summary_line() -> Column:
    """One record of a result overview."""
    c = F.col
    snippet = shorten(F.replace(F.left(blank(c("summary")), F.lit(201)), F.lit("\n"), F.lit(" ")),
                      200)
    return F.concat_ws(
        "\n   ", F.concat(c("rank").cast("string"), F.lit(". "), c("gse_id"), F.lit(" - "),
                          c("title")),
        F.concat(F.lit("Organism: "), F.when(blank(c("organism")) == "", "unknown")
                 .otherwise(c("organism"))),
        F.concat(F.lit("Data type: "), c("data_type"), F.lit(" | Granularity: "),
                 c("granularity")),
        F.concat(F.lit("Samples: "), c("sample_count").cast("string")),
        F.concat(F.lit("Published: "), F.when(blank(c("publication_date")) == "", "unknown")
                 .otherwise(c("publication_date"))),
        F.concat(F.lit("Summary: "), snippet))
