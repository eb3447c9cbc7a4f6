"""Names to standard names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodecat.fixed import table, terms
from lodecat.functions.text import (
    blank, leading_phrase, lit_map, longest_alias, squash,
)


def normalize_species(col: Column) -> Column:
    """Alias, short form, or the binomial in front of a bracket; otherwise as given (H1)."""
    name = F.trim(blank(col))
    return F.coalesce(
        F.element_at(lit_map(table("species_aliases")), F.lower(name)),
        F.element_at(lit_map(terms.SPECIES_SHORT), name),
        F.nullif(F.regexp_extract(name, r"^([A-Z][a-z]+ [a-z]+)\s+\(.*\)$", 1), F.lit("")),
        name)


def catalogue_species(col: Column) -> Column:
    """Scientific name from the organism catalogue, null when it is not listed (H2)."""
    return F.element_at(lit_map(table("organism_catalogue")), F.lower(F.trim(blank(col))))


def normalize_organ(col: Column) -> Column:
    name = F.trim(blank(col))
    return F.coalesce(F.element_at(lit_map(table("organ_aliases")), F.lower(name)), name)


def normalize_condition(col: Column) -> Column:
    """Exact alias, else the longest alias that the text starts with (H3)."""
    aliases = table("disease_aliases")
    name = F.trim(blank(col))
    return F.coalesce(
        F.element_at(lit_map(aliases), leading_phrase(squash(name), aliases)), name)


def normalize_platform(col: Column) -> Column:
    """Exact alias, else the longest alias inside the text."""
    name = F.trim(blank(col))
    return longest_alias(F.lower(name), table("platform_aliases"), name)


def condition_in_text(lowered: Column) -> Column:
    """Longest condition alias inside a lower-cased text, null without one (M3)."""
    return longest_alias(lowered, table("disease_aliases"))


def organ_in_text(lowered: Column) -> Column:
    return longest_alias(lowered, table("organ_aliases"))


def dataset_key(gse_id: Column, srp_id: Column) -> Column:
    """One key rule: the series accession, else ``SRP:`` and the study accession."""
    return F.when(blank(gse_id) != "", gse_id).otherwise(F.concat(F.lit("SRP:"), srp_id))


def display_key(key: Column) -> Column:
    return F.regexp_replace(key, "^(SRP|ERP|DRP):", "")
