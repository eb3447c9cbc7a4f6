"""Scores as Column expressions.  ``as_of`` replaces the wall clock everywhere."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions.parse import loose_date
from lodecat.functions.text import (
    alnum_hit, alnum_key, alnum_term, blank, count_terms, has_any, lit_map,
)


@dataclass(frozen=True)
class Weights:
    """Weights of the catalogue rank."""
    relevance: float = 0.4
    recency: float = 0.2
    quality: float = 0.2
    sample_size: float = 0.2


RERANK_WEIGHTS = Weights(0.5, 0.2, 0.15, 0.15)


@dataclass(frozen=True)
class BioWeights:
    """Weights of the biology-aware rank."""
    relevance: float = 0.30
    recency: float = 0.15
    quality: float = 0.15
    sample_size: float = 0.15
    perturbation: float = 0.15
    single_cell: float = 0.10


BIO_PROFILES = {
    "default": BioWeights(),
    "recent": BioWeights(0.20, 0.40, 0.15, 0.10, 0.10, 0.05),
    "perturbation": BioWeights(0.20, 0.10, 0.15, 0.10, 0.35, 0.10),
}


@dataclass(frozen=True)
class Query:
    """What one query text asks for, worked out once before the plan is built."""
    terms: tuple[str, ...]
    disease: bool
    single_cell: bool

    @classmethod
    def of(cls, text: str, disease_terms: Sequence[str] = terms.DISEASE_TERMS,
           cell_terms: Sequence[str] = terms.SINGLE_CELL_TERMS) -> Query:
        low = text.lower()
        words = (re.sub("^[^a-z]+|[^a-z]+$", "", w) for w in low.split())
        key = alnum_term(low)
        return cls(
            tuple(w for w in words if w not in ("", "and", "or")),
            any(alnum_term(t) in key for t in disease_terms),
            any(alnum_term(t) in key for t in cell_terms) or ("single" in low and "cell" in low))

    @property
    def mixed(self) -> bool:
        return self.disease and self.single_cell


def text_keys(title: Column, summary: Column, keywords: Column, disease: Column,
              tissue: Column) -> dict[str, Column]:
    """Letters-and-digits forms that :func:`relevance` reads, computed once per row."""
    return {
        "_title_key": alnum_key(title),
        "_summary_key": alnum_key(summary),
        "_keyword_key": alnum_key(F.array_join(keywords, " ")),
        "_field_key": F.concat(alnum_key(disease), alnum_key(tissue)),
        "_disease_low": F.lower(blank(disease)),
    }


def relevance(query: Query, single_cell: Column,
              disease_terms: Sequence[str] = terms.DISEASE_TERMS,
              cell_terms: Sequence[str] = terms.SINGLE_CELL_TERMS) -> Column:
    """Relevance of a row that carries :func:`text_keys`.

    Evidence first, then the multipliers, which compound, then the term shares.
    """
    if not query.terms:
        return F.lit(0.0)
    text = F.concat("_title_key", "_summary_key", "_keyword_key", "_field_key")
    disease = alnum_hit(text, disease_terms)
    cells = single_cell | alnum_hit(text, cell_terms)
    score = F.when(disease, 0.45).otherwise(0.0) + F.when(cells, 0.25).otherwise(0.0)
    if query.mixed:
        score = score * F.when(disease, 1.0).otherwise(0.05)
        score = score * F.when(cells, 1.0).otherwise(0.10)
    if query.single_cell:
        score = score * F.when(cells, 1.0).otherwise(0.25)
    if query.disease:
        score = score * F.when(disease | cells, 1.0).otherwise(0.05)
    n = len(query.terms)
    add = lambda hits: reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
    in_title = add([alnum_hit(F.col("_title_key"), [t]) for t in query.terms])
    in_summary = add([alnum_hit(F.col("_summary_key"), [t]) | alnum_hit(F.col("_keyword_key"), [t])
                      for t in query.terms])
    in_field = add([F.contains(F.col("_disease_low"), F.lit(t)) for t in query.terms])
    score = (score + 0.15 * in_title / n + 0.10 * in_summary / n
             + 0.05 * F.least(in_field, F.lit(2)) / 2)
    return F.least(score, F.lit(1.0))


def recency(published: Column, as_of: date) -> Column:
    """Steps by age in years; 0 without a readable date."""
    years = F.date_diff(F.lit(as_of), loose_date(published)) / 365.25
    return (F.when(years.isNull(), 0.0).when(years <= 1, 1.0).when(years <= 2, 0.8)
            .when(years <= 3, 0.6).when(years <= 5, 0.4).when(years <= 10, 0.2).otherwise(0.1))


def recency_by_year(published: Column, as_of: date) -> Column:
    """Steps by calendar year; 0.5 without a year."""
    head = F.left(blank(published), F.lit(4))
    age = F.lit(as_of.year) - F.when(head.rlike("^[0-9]{4}$"), head.cast("int"))
    return (F.when(age.isNull(), 0.5).when(age <= 1, 1.0).when(age <= 2, 0.9)
            .when(age <= 3, 0.7).when(age <= 5, 0.5).when(age <= 10, 0.3).otherwise(0.1))


def quality(gse_id: Column, pubmed_ids: Column, sra_ids: Column, bioproject_ids: Column,
            summary: Column, samples: Column, platform: Column) -> Column:
    """Sum of seven kinds of evidence, at most 1."""
    yes = lambda cond, weight: F.when(cond, weight).otherwise(0.0)
    return F.least(
        yes(gse_id.startswith("GSE"), 0.2) + yes(F.size(pubmed_ids) > 0, 0.2)
        + yes(F.size(sra_ids) > 0, 0.15) + yes(F.size(bioproject_ids) > 0, 0.1)
        + yes(F.length(summary) > 50, 0.15)
        + F.when(samples.between(10, 1000), 0.1).when(samples > 0, 0.05).otherwise(0.0)
        + yes(blank(platform) != "", 0.1), F.lit(1.0))


def sample_share(samples: Column) -> Column:
    """Samples per thousand, at most 1."""
    return F.when(samples > 0, F.least(samples / 1000, F.lit(1.0))).otherwise(0.0)


def sample_log(samples: Column) -> Column:
    """Logarithmic sample score, 1 at ten thousand."""
    return F.when(samples > 0, F.least(
        F.ln(samples + 1) / F.ln(F.lit(10001.0)), F.lit(1.0))).otherwise(0.0)


def species_weight(organism: Column, weights=terms.SPECIES_WEIGHTS) -> Column:
    """First weight whose name holds, or is held by, the organism."""
    low = F.lower(blank(organism))
    out = F.when(low == "", 0.3)
    for name, weight in weights:
        out = out.when(F.contains(low, F.lit(name)) | F.contains(F.lit(name), low), weight)
    return out.otherwise(0.4)


def total(weights: Weights, organism: Column, samples: Column, relevance_score: Column,
          recency_score: Column, quality_score: Column,
          species=terms.SPECIES_WEIGHTS_SHORT) -> Column:
    """Weighted sum times the species weight."""
    return (weights.relevance * relevance_score + weights.recency * recency_score
            + weights.quality * quality_score
            + weights.sample_size * sample_share(samples)) * species_weight(organism, species)


def source_match(text: Column, query: str) -> Column:
    """Match score of a record from the main catalogue source.

    ``text`` is lower-cased; query words shorter than three letters do not count.
    """
    words = [w for w in (re.sub(r"^\W+|\W+$", "", w) for w in query.lower().split())
             if len(w) > 2 and w not in ("and", "not")]
    low = query.lower()
    score = (F.lit(0.4) + 0.4 * count_terms(text, words) / len(words)) if words else F.lit(0.8)
    if (any(t in low for t in terms.SOURCE_DISEASE_TERMS)
            and any(t in low for t in terms.SOURCE_SINGLE_CELL_TERMS)):
        factor = (F.when(~has_any(text, terms.SOURCE_DISEASE_TERMS), 0.05)
                  .when(~has_any(text, terms.SOURCE_SINGLE_CELL_TERMS), 0.10).otherwise(1.0))
        score = score * factor
    return score


def query_words(query: str) -> list[str]:
    return [w for w in (re.sub(r"^\W+|\W+$", "", w) for w in query.lower().split())
            if len(w) > 2 and w not in ("and", "not")]


def title_relevant(text: Column, query: str) -> Column:
    """A record from a side source needs one query word in its text."""
    words = query_words(query)
    return has_any(text, words) if words else F.lit(True)


def perturbation_patterns(compat: bool = False) -> Mapping[str, str]:
    """Two-letter words need word boundaries unless ``compat`` asks for the loose form."""
    if compat:
        return terms.PERTURBATION_REGEX
    short = "|".join(terms.SHORT_PERTURBATION_WORDS)
    return {k: re.sub(rf"(?<![a-z-])({short})(?![a-z-])", r"\\b\1\\b", v)
            for k, v in terms.PERTURBATION_REGEX.items()}


def pattern_hit(text: Column, pattern: str) -> Column:
    """``text`` fits an alternation; plain words are looked up, only the rest is a pattern.

    A pattern with word boundaries is tried only where its word is at all.
    """
    hit = F.lit(False)
    words = [p for p in pattern.split("|") if re.fullmatch("[a-z0-9 -]+", p)]
    if words:
        hit = has_any(text, words)
    for part in pattern.split("|"):
        if part not in words:
            bare = re.fullmatch(r"\\b([a-z]+)\\b", part)
            real = text.rlike(part)
            hit = hit | (F.contains(text, F.lit(bare.group(1))) & real if bare else real)
    return hit


def perturbation_bonus(types: Column, text: Column, compat: bool = False) -> Column:
    """Highest weight among stored types, else among patterns found in the text."""
    folded = {k.lower(): v for k, v in terms.PERTURBATION_WEIGHTS.items()}
    stored = F.array_max(F.transform(
        types, lambda t: F.coalesce(F.element_at(lit_map(folded), F.lower(t)), F.lit(0.0))))
    patterns = perturbation_patterns(compat)
    found = F.when(F.lit(False), 0.0)
    for name, weight in sorted(terms.PERTURBATION_WEIGHTS.items(), key=lambda kv: -kv[1]):
        found = found.when(pattern_hit(text, patterns[name]), weight)
    return F.when(F.size(types) > 0, stored).otherwise(found.otherwise(0.0))


def single_cell_bonus(flag: Column, text: Column) -> Column:
    return F.when(flag | pattern_hit(text, terms.SINGLE_CELL_REGEX), 0.10).otherwise(0.0)


def assay_bonus(kind: Column) -> Column:
    return F.coalesce(F.element_at(lit_map(terms.ASSAY_WEIGHTS), blank(kind)), F.lit(0.0))


def organism_bonus(organism: Column) -> Column:
    return F.coalesce(F.element_at(lit_map(terms.ORGANISM_WEIGHTS), blank(organism)), F.lit(0.0))


def term_relevance(title: Column, summary: Column, keywords: Column, query: str) -> Column:
    """Title hits count twice; share of the possible four per word; 0.5 without a query."""
    words = query.lower().split()
    if not words:
        return F.lit(0.5)
    hits = (2 * count_terms(F.lower(title), words) + count_terms(F.lower(blank(summary)), words)
            + count_terms(F.lower(F.array_join(keywords, " ")), words))
    return F.least(hits / (4 * len(words)), F.lit(1.0))
