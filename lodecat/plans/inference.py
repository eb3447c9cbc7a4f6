"""Condition, organ, assay, granularity, platform and groups out of record text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions import classify, groups as g, render
from lodecat.functions.text import best_of, blank, has_any, join_text, phrase_hits, squash
from lodecat.operators.matching import FIELDS, INLINE_TERMS, best_per_domain, small_vocabularies
from lodecat.session import cut_lineage, spread


@dataclass(frozen=True)
class Vocabularies:
    """Matching terms best first: (term, canonical, weight, granularity)."""
    disease: tuple
    organ: tuple
    assay: tuple

    @classmethod
    def of(cls, vocab: DataFrame, keyword_terms: DataFrame | None = None, limit: int = INLINE_TERMS) -> Vocabularies | VocabularyTable:
        """Reads the term tables once, if they have at most ``limit`` terms; a larger vocabulary
        stays a table, stored once.  Both serve wherever a vocabulary is asked for, and give the same rows."""
        if keyword_terms is not None:
            vocab = keyword_terms.unionByName(vocab)
        found = small_vocabularies(vocab, limit)
        if found is None:
            return VocabularyTable(cut_lineage(vocab))
        return cls(*(tuple(found.get(d, ())) for d in ("disease", "organ", "assay")))


@dataclass(frozen=True)
class VocabularyTable:
    """Matching terms of any number, joined with the texts by their rarest words."""
    terms: DataFrame


def single_cell_terms() -> list[tuple[str, float]]:
    """Method words and the weighted extras, longest first."""
    listed = [(t.lower(), 1.0) for t in terms.SINGLE_CELL_TERMS]
    extra = [(t, w) for t, w in terms.EXTRA_SINGLE_CELL]
    return sorted(listed + extra, key=lambda p: -len(p[0]))


def text_granularity(text: Column, hits: Column | None = None) -> Column:
    """Struct(granularity, weight): cells, then spatial, then bulk, then plain RNA (H6)."""
    lowered = [(t, w) for t, w in single_cell_terms() if t == t.lower()]
    hits = phrase_hits(text, [t for t, _ in lowered]) if hits is None else hits
    cells = best_of(hits, lowered, ["weight"])["weight"]
    value = lambda name, weight: F.struct(
        F.lit(name).alias("granularity"), weight.alias("weight"))
    return (F.when(cells.isNotNull(), value("single_cell", cells))
            .when(has_any(text, terms.SPATIAL_PHRASES), value("spatial", F.lit(0.9)))
            .when(has_any(text, terms.BULK_PHRASES), value("bulk", F.lit(0.8)))
            .when(has_any(text, ["rna-seq", "rna sequencing"]), value("bulk", F.lit(0.5)))
            .otherwise(value("unknown", F.lit(0.0))))


def infer_fields(rows: DataFrame, text: Column, vocab: Vocabularies | VocabularyTable, key: str = "gse_id") -> DataFrame:
    """Adds i_disease, i_organ, i_assay, i_granularity and their weights.

    The text is scanned once for the terms of all vocabularies together.  With a table of terms the
    found ones come back by ``key``, which is unique.
    """
    if isinstance(vocab, VocabularyTable):
        # The text is read for its granularity before the join, so that it need not be shuffled.
        out = best_per_domain(rows.withColumn("_g", text_granularity(text)), key, text, vocab.terms,
                              {"disease": "_d", "organ": "_o", "assay": "_a"})
    else:
        none = F.lit(None).cast("struct<canonical:string,weight:double,granularity:string>")
        every = [t for part in (vocab.disease, vocab.organ, vocab.assay, single_cell_terms())
                 for t, *_ in part if t == t.lower()]
        hits = F.col("_hits")
        pick = lambda found: best_of(hits, found, FIELDS) if found else none
        out = rows.withColumn("_hits", phrase_hits(text, every)).withColumns({
            "_d": pick(vocab.disease), "_o": pick(vocab.organ), "_a": pick(vocab.assay),
            "_g": text_granularity(text, hits)}).drop("_hits")
    from_assay = F.col("_a.canonical").isNotNull() & (F.col("_a.granularity") != "unknown")
    return out.withColumns({
        "i_disease": F.col("_d.canonical"), "i_disease_weight": F.coalesce("_d.weight", F.lit(0.0)),
        "i_organ": F.col("_o.canonical"), "i_organ_weight": F.coalesce("_o.weight", F.lit(0.0)),
        "i_assay": F.col("_a.canonical"), "i_assay_weight": F.coalesce("_a.weight", F.lit(0.0)),
        "i_granularity": F.when(from_assay, F.col("_a.granularity"))
                          .otherwise(F.col("_g.granularity")),
        "i_granularity_weight": F.when(from_assay, F.col("_a.weight"))
                                 .otherwise(F.col("_g.weight")),
    }).drop("_d", "_o", "_a", "_g")


def infer(records: DataFrame, vocab: Vocabularies | VocabularyTable, groups: DataFrame | None = None,
          platforms: DataFrame | None = None) -> DataFrame:
    """Inferred fields, platform, sample design and a sentence per record.

    ``groups`` holds the summary rows of ``plans.sample_groups.infer_groups``; records
    without samples are read from their design text.  ``platforms`` names platform codes (H8).
    """
    c = F.col
    rows = spread(records).withColumn("_text", squash(join_text(c("title"), c("abstract"),
                                                                c("overall_design"))))
    rows = infer_fields(rows, c("_text"), vocab)
    if platforms is not None:
        rows = name_platforms(rows, platforms)
    rows = rows.withColumn("_m", classify.platform_mapping(c("platform"))).withColumn(
        "_text_groups", g.groups_from_text(c("title"), c("overall_design"), c("sample_count")))
    if groups is not None:
        rows = rows.join(groups.select(
            "gse_id", F.col("method").alias("_method"), F.col("design").alias("_design"),
            F.col("contrast_ready").alias("_ready"), F.col("n_samples").alias("_n"),
            F.col("lead_groups").alias("_lead"), F.col("n_groups").alias("_k")),
            "gse_id", "left")
    else:
        rows = rows.withColumns({"_method": F.lit(None).cast("string"),
                                 "_design": F.lit(None).cast("string"),
                                 "_ready": F.lit(None).cast("boolean"),
                                 "_n": F.lit(None).cast("long"),
                                 "_k": F.lit(None).cast("long"),
                                 "_lead": F.lit(None).cast("array<struct<name:string,n:bigint>>")})
    rows = rows.withColumns({
        "group_method": F.coalesce("_method", F.lit("text_fallback")),
        "design": F.coalesce("_design", F.lit("unknown")),
        "contrast_ready": F.coalesce("_ready", g.contrast_ready(c("_text_groups"))),
        "n_samples": F.coalesce("_n", c("sample_count").cast("long")),
        "group_list": F.coalesce("_lead", "_text_groups"),
        "platform_mapped": c("_m.mapped"), "platform_category": c("_m.category"),
    })
    rows = rows.withColumn("sentence", render.inference_sentence(
        c("i_disease"), c("i_organ"), c("i_assay"), c("i_granularity"), c("platform_mapped"),
        c("n_samples"), c("group_list"), c("contrast_ready"),
        F.coalesce("_k", F.size("group_list"))))
    return rows.drop(*[x for x in rows.columns if x.startswith("_")])


def name_platforms(rows: DataFrame, platforms: DataFrame) -> DataFrame:
    """Platform codes to names from a landed table; unknown codes stay (H8).

    ``platforms`` has code (``GPL`` and digits) and name.
    """
    side = platforms.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    digits = F.regexp_extract(F.upper(blank(F.col("platform"))), "^(?:GPL)?0*([0-9]+)$", 1)
    code = F.when(digits != "", F.concat(F.lit("GPL"), digits))
    return (rows.withColumn("_key", code).join(side, F.col("_key") == F.col("_code"), "left")
            .withColumn("platform", F.coalesce(F.nullif("_name", F.lit("")), "platform"))
            .drop("_key", "_code", "_name"))


def needs_answer(disease: Column, organ: Column, assay: Column, granularity: Column) -> Column:
    """Two or more of four fields are unknown."""
    miss = lambda x: F.coalesce(x, F.lit("")).isin("", "unknown").cast("int")
    return miss(disease) + miss(organ) + miss(assay) + miss(granularity) >= 2


def fill_from_answers(inferred: DataFrame, answers: DataFrame) -> DataFrame:
    """Unknown fields from landed answers at weight 0.5, with their source.

    ``answers`` has gse_id, disease, organ, omics_type, granularity; only records that
    :func:`needs_answer` names are filled.
    """
    c = F.col
    side = answers.select("gse_id", *[F.col(f).alias(f"_a_{f}") for f in (
        "disease", "organ", "omics_type", "granularity")])
    asked = needs_answer(c("i_disease"), c("i_organ"), c("i_assay"), c("i_granularity"))
    rows = inferred.join(side, "gse_id", "left").withColumn("_asked", asked)
    for field, answer in (("i_disease", "disease"), ("i_organ", "organ"),
                          ("i_assay", "omics_type"), ("i_granularity", "granularity")):
        unknown = F.coalesce(c(field), F.lit("")).isin("", "unknown")
        given = F.nullif(c(f"_a_{answer}"), F.lit(""))
        use = c("_asked") & unknown & given.isNotNull()
        rows = rows.withColumns({
            f"{field}_source": F.when(use, "answer").when(~unknown, "rule").otherwise(""),
            f"{field}_weight": F.when(use, 0.5).otherwise(c(f"{field}_weight")),
            field: F.when(use, given).otherwise(c(field))})
    return rows.drop("_asked", "_a_disease", "_a_organ", "_a_omics_type", "_a_granularity")


def merge_inferred(records: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred values where the record has none or ``unknown``."""
    side = inferred.select("gse_id", "i_disease", "i_organ", "i_assay", "i_granularity")
    rows = records.join(side, "gse_id", "left")
    for field, source in (("disease", "i_disease"), ("organ", "i_organ"),
                          ("omics_type", "i_assay"), ("omics_granularity", "i_granularity")):
        rows = rows.withColumn(field, F.when(
            blank(F.col(field)).isin("", "unknown"),
            F.coalesce(source, F.lit("unknown"))).otherwise(F.col(field)))
    return rows.drop("i_disease", "i_organ", "i_assay", "i_granularity")
