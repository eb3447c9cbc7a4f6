"""Text matching family M1-M10."""

from functools import cache

from pyspark.sql import functions as F

from lodecat.fixed import table as fixed, terms
from lodecat.functions import text as t
from lodecat.functions.normalize import condition_in_text
from lodecat.functions.score import perturbation_bonus
from lodecat.operators.matching import detect_by_keyword, match_all, match_best
from lodecat.plans.knowledge import Knowledge
from lodecat.plans.queries import parse_queries, query_tokens
from lodecat.sources.vocabulary import keyword_vocab, seed_entries, vocab_terms
from workload.derived import given, table
from workload.registry import query
from workload.sqltext import (
    all_, any_, best_, case_, count_, hits_, key_, longest_, q, seed, seed_terms, squash_,
)

TEXT = "concat(title, ' ', abstract, ' ', overall_design)"


@cache
def knowledge(spark):
    """Read once per session, as a job would."""
    return Knowledge.of(seed_entries(spark))


def disease_rows():
    """Keyword terms first, then the seed conditions, longest first."""
    words = [(w, terms.DISEASE_NAMES.get(w, w.title()), 1.0, "") for w in terms.DISEASE_TERMS]
    rows = words + [r[:4] for r in sorted(seed_terms("disease"), key=lambda r: r[4])]
    # Stable on length: keyword terms precede seed terms of equal length.
    rows = sorted(rows, key=lambda r: -len(r[0]))
    return [(*r, i) for i, r in enumerate(rows)]


def disease_vocab(spark):
    return keyword_vocab(spark, terms.DISEASE_TERMS).unionByName(
        vocab_terms(seed_entries(spark, ["disease"]), matching_only=True))


@query("m1_whole_word_best", f", d AS MATERIALIZED (SELECT gse_id, {squash_(TEXT)} AS txt FROM datasets), " + best_(
    "hit", "d", "gse_id", "txt", disease_rows())
    + " SELECT d.gse_id, coalesce(canonical, '') AS disease, coalesce(weight, 0)::DOUBLE AS weight "
      "FROM datasets d LEFT JOIN hit USING (gse_id)", "datasets")
def m1(spark, sf):
    df = table(spark, sf, "datasets")
    out = match_best(df, "gse_id", t.join_text(F.col("title"), F.col("abstract"),
                                               F.col("overall_design")),
                     disease_vocab(spark), "hit")
    return out.select("gse_id", F.coalesce("hit.canonical", F.lit("")).alias("disease"),
                      F.coalesce("hit.weight", F.lit(0.0)).alias("weight"))


def word_vocab(spark, sf):
    """Long words of the benchmark passages: a vocabulary that grows with the data."""
    words = given(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("term")).distinct()
    return words.select("term", F.upper("term").alias("canonical"), F.lit(1.0).alias("weight"),
                        F.lit("").alias("granularity"), F.col("term").alias("pos"))


_WORDS = """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS term
 FROM benchmark), w AS (SELECT DISTINCT doc_id,
 unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS term FROM documents) """


@query("m1_whole_word_join", _WORDS +
       "SELECT doc_id, arg_min(upper(term), (-length(term), term)) AS canonical "
       "FROM w JOIN v USING (term) GROUP BY doc_id")
def m1_join(spark, sf):
    """The joining form for vocabularies of any size."""
    hits = match_all(given(spark, sf, "documents"), "doc_id", F.col("text"),
                     word_vocab(spark, sf))
    return hits.groupBy("doc_id").agg(F.min_by("canonical", "rank").alias("canonical"))


@query("m2_first_declared", "SELECT gse_id, " + case_(f"lower({TEXT})", terms.TISSUES, "''")
       + " AS tissue FROM datasets", "datasets")
def m2(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_t", F.lower(t.join_text(
        F.col("title"), F.col("abstract"), F.col("overall_design"))))
    return df.select("gse_id", t.first_class(F.col("_t"), terms.TISSUES, "").alias("tissue"))


@query("m3_longest_alias", "SELECT gse_id, " + longest_(
    f"lower({TEXT})", fixed("disease_aliases")) + " AS disease FROM datasets", "datasets")
def m3(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_t", F.lower(t.join_text(
        F.col("title"), F.col("abstract"), F.col("overall_design"))))
    return df.select("gse_id", condition_in_text(F.col("_t")).alias("disease"))


@query("m4_all_classes", "SELECT gse_id, " + all_(
    "lower(concat(title, ' ', abstract))", terms.PERTURBATIONS)
    + " AS perturbations FROM datasets", "datasets")
def m4(spark, sf):
    df = table(spark, sf, "datasets").withColumn(
        "_t", F.lower(t.join_text(F.col("title"), F.col("abstract"))))
    return df.select("gse_id", F.array_join(
        t.all_classes(F.col("_t"), terms.PERTURBATIONS), "|").alias("perturbations"))


@query("m5_letters_and_digits", f"SELECT gse_id, {any_('k', map(t.alnum_term, terms.SINGLE_CELL_TERMS))} AS "
       f"single_cell, {count_('k', ['gout', 'single', 'cell', 'uric'])} AS n_terms FROM (SELECT "
       f"gse_id, {key_(TEXT)} AS k FROM datasets)", "datasets")
def m5(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_k", t.alnum_key(t.join_text(
        F.col("title"), F.col("abstract"), F.col("overall_design"))))
    return df.select("gse_id", t.alnum_hit(F.col("_k"), terms.SINGLE_CELL_TERMS)
                     .alias("single_cell"),
                     t.count_terms(F.col("_k"), ["gout", "single", "cell", "uric"])
                     .alias("n_terms"))


def _token_class(classes):
    return "coalesce(" + ", ".join(
        f"CASE WHEN list_has_any(tk, {ws!r}) THEN {q(n)} END" for n, ws in classes)


@query("m6_token_equality",
       "SELECT gse_id, " + _token_class(terms.QUERY_ASSAYS) + ", " + ", ".join(
           f"CASE WHEN {any_('array_to_string(tk, chr(32))', [w for w in ws if len(w) > 5])} "
           f"THEN {q(n)} END" for n, ws in terms.QUERY_ASSAYS if any(len(w) > 5 for w in ws))
       + ", '') AS omics_type, " + _token_class(terms.QUERY_ORGANISMS)
       + ", '') AS organism FROM (SELECT gse_id, list_filter(regexp_extract_all(lower(title), "
         "'[\\p{L}\\p{N}_]+'), lambda x: length(x) > 1) AS tk FROM datasets)", "datasets")
def m6(spark, sf):
    return parse_queries(table(spark, sf, "datasets"), "title").select(
        "gse_id", "omics_type", "organism")


def _bonus(col):
    from lodecat.functions.score import perturbation_patterns
    pats = perturbation_patterns()
    return "CASE " + " ".join(
        f"WHEN regexp_matches({col}, {q(pats[n])}) THEN {w}::DOUBLE" for n, w in sorted(
            terms.PERTURBATION_WEIGHTS.items(), key=lambda kv: -kv[1])) + " ELSE 0::DOUBLE END"


@query("m7_patterns", f"SELECT gse_id, {_bonus('lower(title)')} AS bonus FROM datasets", "datasets")
def m7(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_t", F.lower("title"))
    none = F.array().cast("array<string>")
    return df.select("gse_id", perturbation_bonus(none, F.col("_t")).alias("bonus"))


def _phrase_alt(words):
    return "|".join(w.replace("-", "\\-") for w in sorted(words, key=lambda w: -len(w)))


_DISEASE_NAMES = [n.lower() for k, e in seed("disease").items() for n in [k, *e["synonyms"]]]


@query("m8_greedy_phrases",
       f"SELECT gse_id, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace("
       f"title, '\\s+', ' ', 'g')), {q('(?i)(?:(?:' + _phrase_alt(_DISEASE_NAMES) + ')(?: |$)|[^ ]+(?: |$))')}), "
       "lambda x: rtrim(x)), '|') AS tokens FROM datasets", "datasets")
def m8(spark, sf):
    know = knowledge(spark)
    return table(spark, sf, "datasets").select("gse_id", F.array_join(
        query_tokens(F.col("title"), know.disease.names), "|").alias("tokens"))


def known_phrases():
    known = {}
    for d in ("disease", "organ"):
        for k, e in seed(d).items():
            for n in (k, *e["synonyms"]):
                known.setdefault(n.lower(), n)
    return list(known.items())


@query("m9_entities",
       ", p AS (SELECT gse_id, string_agg(label, '|' ORDER BY -length(term), n) AS found FROM ("
       + hits_("datasets", "gse_id", "lower(title)",
               [(k, v, i) for i, (k, v) in enumerate(known_phrases())], "term, label, n")
       + ") GROUP BY gse_id), "
         "w AS (SELECT gse_id, array_to_string(list_distinct_keep, '|') AS rest FROM (SELECT gse_id, "
         "list_filter(ws, lambda x, i: list_position(ws, x) = i) AS list_distinct_keep FROM (SELECT "
         "gse_id, regexp_extract_all(regexp_replace(lower(title), "
       + q("\\b(?:" + _phrase_alt([k for k, _ in known_phrases()]) + ")\\b")
       + ", ' ', 'g'), '[\\p{L}\\p{N}_]+') AS ws FROM datasets))) "
         "SELECT gse_id, concat_ws('|', found, nullif(rest, '')) AS entities FROM datasets LEFT JOIN p "
         "USING (gse_id) LEFT JOIN w USING (gse_id)", "datasets")
def m9(spark, sf):
    know = knowledge(spark)
    return table(spark, sf, "datasets").select(
        "gse_id", F.array_join(know.phrases(F.col("title")), "|").alias("entities"))


_ASSAY_WORDS = [(k, [w.lower() for w in e["keywords"]]) for k, e in seed("assay").items()]


@query("m10_keyword_detection",
       "SELECT gse_id, canonical, 0.5::DOUBLE AS confidence FROM (SELECT gse_id, unnest(string_split("
       f"{all_('lower(' + TEXT + ')', _ASSAY_WORDS)}, '|')) AS canonical FROM datasets) "
       "WHERE canonical <> ''", "datasets")
def m10(spark, sf):
    text = t.join_text(F.col("title"), F.col("abstract"), F.col("overall_design"))
    return detect_by_keyword(table(spark, sf, "datasets"), text, _ASSAY_WORDS).select(
        "gse_id", "canonical", "confidence")
