"""Assay, granularity, library and file classes from record text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodecat.fixed import table, terms
from lodecat.functions.text import blank, count_terms, first_class, has_any, lit_map

UNKNOWN = "unknown"


def data_type(assay: Column, title: Column, platform: Column, compat: bool = False) -> Column:
    """Assay field, then title, then platform (H4).

    ``compat`` keeps the published order in which ``atac`` hides ``scatac``.
    """
    order = list(terms.DATA_TYPE_FROM_ASSAY)
    if not compat:
        order.insert(0, order.pop(5))
    return F.coalesce(
        first_class(F.lower(blank(assay)), order),
        first_class(F.lower(blank(title)), terms.DATA_TYPE_FROM_TITLE),
        first_class(F.lower(blank(platform)), terms.DATA_TYPE_FROM_PLATFORM),
        F.lit("other"))


def granularity(field: Column, samples: Column, title: Column, platform: Column) -> Column:
    """Stored field, then title, then platform, then more than 500 samples (H5)."""
    return F.coalesce(
        F.when(field.isin("single_cell", "bulk", "spatial"), field),
        first_class(F.lower(blank(title)), terms.GRANULARITY_FROM_TITLE),
        first_class(F.lower(blank(platform)), terms.GRANULARITY_FROM_PLATFORM),
        F.when(samples > 500, "single_cell"),
        F.lit(UNKNOWN))


def tissue_in_text(lowered: Column) -> Column:
    return first_class(lowered, terms.TISSUES, "")


def platform_mapping(platform: Column) -> Column:
    """Struct(mapped, category); an unmapped platform maps to itself (H7)."""
    low = F.lower(blank(platform))
    mapped = first_class(low, [(n, [p]) for p, n, _ in terms.PLATFORM_PATTERNS])
    category = first_class(low, [(c, [p]) for p, _, c in terms.PLATFORM_PATTERNS])
    empty = blank(platform) == ""
    return F.struct(
        F.when(empty, "").otherwise(F.coalesce(mapped, platform)).alias("mapped"),
        F.when(empty, "").otherwise(F.coalesce(category, F.lit("Unknown"))).alias("category"))


def assay_from_library(strategy: Column, title: Column, platform: Column) -> Column:
    """Library strategy, then title, then platform; empty when nothing fits (H9)."""
    return F.coalesce(
        F.element_at(lit_map(table("library_strategies")), blank(strategy)),
        first_class(F.lower(blank(title)), terms.ASSAY_FROM_TITLE),
        first_class(F.lower(blank(platform)), terms.ASSAY_FROM_PLATFORM),
        F.lit(""))


def granularity_from_library(source: Column, title: Column, samples: Column) -> Column:
    by_source = [(g, [s]) for s, g in table("library_sources").items()]
    return F.coalesce(
        first_class(F.upper(blank(source)), by_source),
        first_class(F.lower(blank(title)), terms.LIBRARY_TITLE_GRANULARITY),
        F.when(samples > 1000, "single_cell"),
        F.lit(UNKNOWN))


def access_from_study(auth: Column, alias: Column, srp_id: Column) -> Column:
    """Controlled, public or unknown from authorisation, alias and accession."""
    controlled = (has_any(F.lower(blank(auth)), ["controlled", "dbgap"])
                  | has_any(F.lower(blank(alias)), ["dbgap", "phs"]))
    return (F.when(controlled, "controlled").when(blank(srp_id) != "", "public")
            .otherwise(UNKNOWN))


def library_classes(text: Column) -> dict[str, Column]:
    """Six library fields from one squashed text, kept consistent with each other."""
    cells = has_any(text, terms.CELL_WORDS + terms.NUCLEUS_WORDS)
    single = cells | has_any(text, terms.SPATIAL_WORDS)
    prep = first_class(text, terms.LIB_PREP, UNKNOWN)
    tenx = prep == "10x_Genomics"
    return {
        "is_illumina": illumina(text),
        "is_single_cell": F.when(single, "yes").otherwise("unsure"),
        "lib_prep": F.when(tenx & ~single, "other").otherwise(prep),
        "tech_10x": F.when(tenx & single, first_class(text, terms.TECH_10X, "other"))
                     .otherwise("not_applicable"),
        "cell_prep": F.when(~single, "not_applicable")
                      .when(has_any(text, terms.NUCLEUS_WORDS), "single_nucleus")
                      .when(has_any(text, terms.CELL_WORDS), "single_cell")
                      .otherwise("unsure"),
        "granularity": F.when(has_any(text, terms.SPATIAL_WORDS), "spatial")
                        .when(cells, "single_cell")
                        .when(has_any(text, terms.BULK_WORDS), "bulk").otherwise(UNKNOWN),
    }


def illumina(text: Column) -> Column:
    return (F.when(has_any(text, terms.ILLUMINA_WORDS), "yes")
            .when(has_any(text, terms.OTHER_SEQUENCER_WORDS), "no").otherwise("unsure"))


def file_names(files: Column, *parts: str) -> Column:
    """The chosen fields of all files, lower-cased and joined."""
    one = lambda f: F.concat_ws(" ", *[blank(f[p]) for p in parts])
    return F.lower(F.array_join(F.transform(files, one), " "))


def file_format(files: Column, names_types: Column, platform: Column,
                text: Column) -> dict[str, Column]:
    """Single-cell signal, bulk flag, summary and skip reason of a file list.

    ``names_types`` comes from :func:`file_names`; ``text`` is the lower-cased record text.
    Upper-case bulk patterns never meet the lower-cased names, as published.
    """
    signal = F.least(count_terms(names_types, terms.SINGLE_CELL_FILES) * 0.25, F.lit(1.0))
    signal = F.when(has_any(F.lower(blank(platform)), terms.SINGLE_CELL_PLATFORMS),
                    F.greatest(signal, F.lit(0.5))).otherwise(signal)
    bulk = has_any(names_types, terms.BULK_FILES)
    cells = (signal > 0.1) | has_any(text, ["scrna", "single-cell", "single cell"]) \
        | has_any(names_types, ["scrna", "single-cell", "single cell"])
    size = lambda b: (
        F.when(b > 1e9, F.format_string("(%.1fGB)", b / 1e9))
        .when(b > 1e6, F.format_string("(%.1fMB)", b / 1e6))
        .when(b > 1e3, F.format_string("(%.1fKB)", b / 1e3)).otherwise(""))
    shown = F.array_join(F.transform(
        F.slice(files, 1, 5), lambda f: F.concat(F.left(f["name"], F.lit(40)), size(f["size"]))),
        "; ")
    summary = (F.when(F.size(files) == 0, "no supplementary files")
               .when(F.size(files) > 5, F.concat(
                   shown, F.lit(" ... "), F.size(files).cast("string"), F.lit(" files")))
               .otherwise(shown))
    return {
        "single_cell_signal": signal,
        "is_bulk_by_files": bulk,
        "file_format_summary": summary,
        "skip_reason": F.when(bulk & cells, "bulk files under a single-cell query")
                        .when(bulk, "bulk array data").otherwise(""),
    }


def file_flags(names: Column) -> dict[str, Column]:
    """Processed matrix and raw-only flags from lower-cased file names."""
    processed = has_any(names, terms.PROCESSED_FILES)
    return {"has_processed_matrix": processed,
            "raw_only": has_any(names, terms.RAW_FILES) & ~processed}
