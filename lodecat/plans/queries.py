"""Keyword queries to boolean queries and to their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions import render
from lodecat.functions.text import (
    alternation, blank, has_any, lit_array, ordered_union,
)
from lodecat.plans.knowledge import NONE, Knowledge


def query_tokens(text: Column, phrases) -> Column:
    """Tokens of a query, a known phrase of up to four words being one token (M8).

    One pattern reads the longest phrase at each place, else one word.
    """
    kept = [p for p in phrases if len(p.split()) <= 4]
    pattern = rf"(?i)(?<![^ ])((?:{alternation(kept)})(?![^ ])|[^ ]+)"
    plain = F.trim(F.regexp_replace(F.translate(blank(text), ",，", "  "), r"\s+", " "))
    return F.regexp_extract_all(plain, F.lit(pattern), F.lit(1))


def build_queries(df: DataFrame, text: str, know: Knowledge) -> DataFrame:
    """Term classes and the boolean query of every text.

    Same class: OR.  Different classes: AND.  At most 5, 5, 5 and 3 terms.
    """
    tokens = query_tokens(F.col(text), know.disease.names)
    rows = df.withColumn("_tokens", tokens)
    partial = F.array(*[F.struct(
        F.lit(k).alias("name"),
        F.lit("\n".join(x.lower() for x in (*e["keywords"], *e["aliases"], k))).alias("text"))
        for k, e in know.assay.entries.items()])

    def assay(word: Column) -> Column:
        """Exact assay name, else the first assay one of whose names holds the word."""
        near = F.get(F.filter(partial, lambda s: F.contains(s["text"], F.lower(word))), F.lit(0))
        return F.coalesce(know.assay.canonical(word), near["name"])

    kind = lambda w: (
        F.when(know.disease.canonical(w).isNotNull(), "disease")
        .when(assay(w).isNotNull(), "assay").when(know.organ.canonical(w).isNotNull(), "organ")
        .when(F.lower(w).isin(*terms.DISEASE_FALLBACK), "fallback").otherwise("other"))
    rows = rows.withColumn("_words", F.transform("_tokens", lambda w: F.struct(
        w.alias("w"), kind(w).alias("k"))))

    def of(kinds, one) -> Column:
        chosen = F.filter("_words", lambda s: s["k"].isin(*kinds))
        return F.flatten(F.transform(chosen, lambda s: one(s["w"], s["k"])))

    def condition(w: Column, k: Column) -> Column:
        return F.when(k == "disease", know.disease.of(
            know.disease.canonical(w), "search_terms", "synonyms")).otherwise(know.expand(w))

    def organ(w: Column, k: Column) -> Column:
        return F.when(k == "disease", F.flatten(F.transform(
            know.disease.of(know.disease.canonical(w), "related_organs"),
            know.organ.search_terms))).otherwise(know.expand(w))

    whole = know.assay.of(know.assay.canonical(F.col(text)), "search_terms", "aliases")
    rows = rows.withColumns({
        "diseases": ordered_union(of(["disease", "fallback"], condition)),
        "organs": ordered_union(of(["disease", "organ"], organ)),
        "omics": ordered_union(whole, of(["assay"], lambda w, k: know.assay.of(
            assay(w), "search_terms", "aliases"))),
        "other": ordered_union(of(["other"], lambda w, k: know.expand(w)))})
    built = render.boolean_query(
        render.boolean_group(F.col("diseases"), 5), render.boolean_group(F.col("organs"), 5),
        render.boolean_group(F.col("omics"), 5), render.boolean_group(F.col("other"), 3))
    return rows.withColumn("query", F.when(built == "", F.col(text)).otherwise(built)).drop(
        "_tokens", "_words")


def first_token_class(tokens: Column, classes) -> Column:
    """First declared class one of whose words is a token (M6)."""
    out = None
    for name, words in classes:
        hit = F.arrays_overlap(tokens, lit_array(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def parse_queries(df: DataFrame, text: str) -> DataFrame:
    """Assay, organism, perturbation, tissue, condition and intent of query texts (C11)."""
    low = F.lower(blank(F.col(text)))
    tokens = F.filter(F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), F.lit(1)),
                      lambda t: F.length(t) > 1)
    rows = df.withColumns({"_low": low, "tokens": tokens})
    joined = F.array_join("tokens", " ")
    t = F.col("tokens")
    compound = [(n, [w for w in ws if len(w) > 5]) for n, ws in terms.QUERY_ASSAYS]
    long_hit = F.coalesce(*[F.when(has_any(joined, ws), n) for n, ws in compound if ws])
    kinds = F.array_compact(F.array(*[
        F.when(F.arrays_overlap(t, lit_array(ws)), n) for n, ws in terms.QUERY_PERTURBATIONS]))
    rows = rows.withColumns({
        "omics_type": F.coalesce(first_token_class(t, terms.QUERY_ASSAYS), long_hit, F.lit("")),
        "organism": F.coalesce(first_token_class(t, terms.QUERY_ORGANISMS), F.lit("")),
        "single_cell": has_any(F.col("_low"), terms.QUERY_SINGLE_CELL),
        "spatial": has_any(F.col("_low"), terms.QUERY_SPATIAL),
        "perturbation_types": kinds,
        "tissue_terms": F.filter(t, lambda x: x.isin(*terms.QUERY_TISSUES)),
        "disease_terms": F.array_compact(F.array(*[
            F.when(F.contains("_low", F.lit(d)), d) for d in terms.QUERY_DISEASES])),
    })
    semantic = {w for classes in (terms.QUERY_ASSAYS, terms.QUERY_ORGANISMS,
                                  terms.QUERY_PERTURBATIONS) for _, ws in classes for w in ws}
    rows = rows.withColumns({
        "perturbation": F.size("perturbation_types") > 0,
        "intent": intent(F.col("single_cell"), F.col("spatial"),
                         F.size("perturbation_types") > 0, F.size("disease_terms") > 0),
        "raw_keywords": F.filter(t, lambda x: ~x.isin(*semantic, *terms.STOP_WORDS)
                                 & ~F.array_contains("disease_terms", x)
                                 & ~F.array_contains("tissue_terms", x)),
    })
    return rows.withColumn("has_meaning", has_meaning()).drop("_low")


def intent(single_cell: Column, spatial: Column, perturbation: Column,
           disease: Column) -> Column:
    """What a query is about, most specific first."""
    return (F.when(single_cell, "single_cell").when(spatial, "spatial")
            .when(perturbation, "drug").when(disease, "disease").otherwise("general"))


def has_meaning() -> Column:
    """A parsed query holds anything but plain words."""
    return ((F.size("disease_terms") > 0) | (F.size("tissue_terms") > 0)
            | (F.col("organism") != "") | (F.col("omics_type") != "") | F.col("perturbation")
            | F.col("single_cell") | F.col("spatial"))


def expand_queries(parsed: DataFrame, text: str, know: Knowledge, most: int = 10) -> DataFrame:
    """Condition, organ and assay expansions and the quoted boolean query (C11).

    An unknown name takes the first entry whose name or synonyms hold it.
    """
    def widen(domain, kind: str, name: Column) -> Column:
        known = domain.canonical(name)
        table = F.array(*[F.struct(
            F.lit(k).alias("name"),
            F.lit(" ".join((k, *e["synonyms"])).lower()).alias("text"))
            for k, e in domain.entries.items()])
        near = F.get(F.filter(table, lambda s: F.contains(s["text"], F.lower(name))), F.lit(0))
        return (F.when(known.isNotNull(), F.concat(F.array(name), domain.of(known, kind)))
                .when(near.isNotNull(), F.concat(F.array(near["name"]),
                                                 domain.of(near["name"], kind)))
                .otherwise(F.array().cast(NONE)))

    every = lambda col, one: F.slice(F.array_distinct(F.flatten(
        F.transform(col, one))), 1, most)
    rows = parsed.withColumns({
        "x_disease": every("disease_terms", lambda d: widen(know.disease, "synonyms", d)),
        "x_organ": every("tissue_terms", lambda o: widen(know.organ, "synonyms", o)),
        "x_omics": F.when(F.col("omics_type") == "", F.array().cast(NONE)).otherwise(
            F.concat(F.array("omics_type"),
                     know.assay.of(know.assay.canonical(F.col("omics_type")), "aliases")))})
    built = render.boolean_query(render.boolean_group(F.col("x_disease"), quoted=True),
                                 render.boolean_group(F.col("x_omics"), quoted=True))
    return rows.withColumns({
        "expanded_query": F.when(built == "", F.col(text)).otherwise(built),
        "used_vocabulary": (F.size("x_disease") > 0) | (F.size("x_organ") > 0)})


def fallback_expansion(text: Column) -> Column:
    """First listed condition, else assay, with its fixed synonyms; else the text."""
    low = F.lower(blank(text))
    out = None
    for word, others in [*terms.FALLBACK_DISEASES, *terms.FALLBACK_ASSAYS]:
        form = f"({word} OR " + " OR ".join(f'"{o}"' for o in others) + ")"
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, form) if out is None else out.when(hit, form)
    return out.otherwise(text)
