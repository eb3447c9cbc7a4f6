"""Stored records to scored views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions import classify, score
from lodecat.functions.text import all_classes, blank, join_text, squash
from lodecat.plans.inference import Vocabularies, VocabularyTable, infer_fields
from lodecat.sources.landed import with_defaults
from lodecat.schemas import DATASET
from lodecat.session import spread


def to_view(records: DataFrame, query: str, as_of: date, vocab: Vocabularies | VocabularyTable | None = None,
            disease_terms: Sequence[str] = terms.DISEASE_TERMS,
            cell_terms: Sequence[str] = terms.SINGLE_CELL_TERMS,
            compat: bool = False) -> DataFrame:
    """Every record as a view with its three scores.

    A stored field wins over an inferred one, and that over plain text evidence.  One pass
    over the records: no join, no shuffle, one read of each text per derived form.  Only a
    vocabulary that is a table is joined, by gse_id.
    """
    c = F.col
    rows = spread(with_defaults(records, DATASET))
    rows = rows.withColumn("_text", squash(join_text(c("title"), c("abstract"),
                                                     c("overall_design"))))
    if vocab is not None:
        rows = infer_fields(rows, c("_text"), vocab)
    else:
        rows = rows.withColumns({"i_disease": F.lit(None).cast("string"),
                                 "i_organ": F.lit(None).cast("string"),
                                 "i_assay": F.lit(None).cast("string"),
                                 "i_granularity": F.lit("unknown")})
    own_type = classify.data_type(c("omics_type"), c("title"), c("platform"), compat)
    inferred_type = classify.data_type(c("i_assay"), F.lit(""), F.lit(""), compat)
    own_grain = classify.granularity(c("omics_granularity"), c("sample_count"), c("title"),
                                     c("platform"))
    names = classify.file_names(c("supplementary_files"), "name")
    flags = classify.file_flags(c("_names"))
    rows = rows.withColumns({
        "_low": F.lower(join_text(c("title"), c("abstract"))),
        "_names": names,
        "data_type": F.when((own_type == "other") & c("i_assay").isNotNull(), inferred_type)
                      .otherwise(own_type),
        "granularity": F.when(c("i_granularity") != "unknown", c("i_granularity"))
                        .otherwise(own_grain),
        "disease": F.coalesce(F.nullif("disease", F.lit("")), "i_disease", F.lit("")),
        "organ": F.coalesce(F.nullif("organ", F.lit("")), "i_organ", F.lit("")),
        "_mapping": classify.platform_mapping(c("platform")),
    })
    rows = rows.withColumns({
        "single_cell": c("granularity") == "single_cell",
        "perturbation_types": all_classes(c("_low"), terms.PERTURBATIONS),
        "tissue": F.coalesce(F.nullif("organ", F.lit("")), classify.tissue_in_text(c("_text"))),
        "platform": F.coalesce(F.nullif(c("_mapping.mapped"), F.lit("")), c("platform")),
        **flags,
    }).withColumn("has_perturbation", F.size("perturbation_types") > 0)
    rows = rows.withColumns(score.text_keys(
        c("title"), c("abstract"), c("keywords"), c("disease"), c("tissue")))
    rows = rows.withColumns({
        "relevance_score": score.relevance(score.Query.of(query, disease_terms, cell_terms),
                                           c("single_cell"), disease_terms, cell_terms),
        "recency_score": score.recency(c("publication_date"), as_of),
        "quality_score": score.quality(
            c("gse_id"), c("pubmed_ids"), c("sra_ids"), c("bioproject_ids"), c("abstract"),
            c("sample_count"), c("platform")),
    })
    hidden = [x for x in rows.columns if x.startswith("_") or x.startswith("i_")]
    return rows.drop(*hidden).withColumn("summary", blank(c("abstract")))
