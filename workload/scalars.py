"""Scalar functions H1-H45 over whole derived tables."""

from functools import cache

from pyspark.sql import functions as F

from lodecat.fixed import table as fixed, terms
from lodecat.functions import classify, groups, normalize, parse, render, score, text as t
from lodecat.operators.review import valid_transition
from lodecat.operators.store import metadata_hash, query_hash
from lodecat.plans.inference import (
    Vocabularies, fill_from_answers, infer_fields, name_platforms, needs_answer,
    single_cell_terms, text_granularity,
)
from lodecat.plans.queries import parse_queries
from lodecat.sources.vocabulary import keyword_vocab, seed_entries, vocab_terms
from workload.derived import AS_OF, QUERY, records, table
from workload.registry import query
from workload.sqltext import (
    all_, any_, best_, case_, count_, hits_, key_, longest_, map_, q, seed_terms, squash_,
)
from workload.text import TEXT, disease_rows

c = F.col


def squashed(df):
    return df.withColumn("_t", t.squash(t.join_text(c("title"), c("abstract"),
                                                    c("overall_design"))))


# --- names ---------------------------------------------------------------------------------

@query("h1_normalize_organism", "SELECT doc_id, coalesce("
       + map_("lower(trim(species))", fixed("species_aliases")) + ", "
       + map_("trim(species)", terms.SPECIES_SHORT)
       + ", nullif(regexp_extract(trim(species), '^([A-Z][a-z]+ [a-z]+)\\s+\\(.*\\)$', 1), ''), "
         "trim(species)) AS organism FROM names", "names")
def h1(spark, sf):
    return table(spark, sf, "names").select(
        "doc_id", normalize.normalize_species(c("species")).alias("organism"))


@query("h2_catalogue_organism", "SELECT doc_id, "
       + map_("lower(trim(species))", fixed("organism_catalogue")) + " AS organism FROM names",
       "names")
def h2(spark, sf):
    return table(spark, sf, "names").select(
        "doc_id", normalize.catalogue_species(c("species")).alias("organism"))


def _leading(col):
    al = sorted(fixed("disease_aliases").items(), key=lambda kv: -len(kv[0]))
    return "CASE " + " ".join(
        f"WHEN {col} = {q(a)} OR starts_with({col}, {q(a + ' ')}) THEN {q(n)}" for a, n in al) + " END"


@query("h3_normalize_fields", f"SELECT doc_id, coalesce({_leading(squash_('condition_text'))}, "
       "trim(condition_text)) AS disease, coalesce("
       + map_("lower(trim(organ_text))", fixed("organ_aliases")) + ", trim(organ_text)) AS organ, "
       + longest_("lower(trim(platform_text))", fixed("platform_aliases"), "trim(platform_text)")
       + " AS platform FROM names", "names")
def h3(spark, sf):
    return table(spark, sf, "names").select(
        "doc_id", normalize.normalize_condition(c("condition_text")).alias("disease"),
        normalize.normalize_organ(c("organ_text")).alias("organ"),
        normalize.normalize_platform(c("platform_text")).alias("platform"))


# --- classes -------------------------------------------------------------------------------

_ASSAYS = [terms.DATA_TYPE_FROM_ASSAY[5], *[x for i, x in enumerate(terms.DATA_TYPE_FROM_ASSAY)
                                            if i != 5]]
DATA_TYPE = ("coalesce(" + case_("lower(omics_type)", _ASSAYS) + ", "
             + case_("lower(title)", terms.DATA_TYPE_FROM_TITLE) + ", "
             + case_("lower(platform)", terms.DATA_TYPE_FROM_PLATFORM) + ", 'other')")
GRANULARITY = ("coalesce(CASE WHEN omics_granularity IN ('single_cell', 'bulk', 'spatial') THEN "
               "omics_granularity END, " + case_("lower(title)", terms.GRANULARITY_FROM_TITLE)
               + ", " + case_("lower(platform)", terms.GRANULARITY_FROM_PLATFORM)
               + ", CASE WHEN sample_count > 500 THEN 'single_cell' END, 'unknown')")


@query("h4_data_type", f"SELECT gse_id, {DATA_TYPE} AS data_type FROM datasets", "datasets")
def h4(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", classify.data_type(c("omics_type"), c("title"), c("platform"))
        .alias("data_type"))


@query("h5_granularity_fields", f"SELECT gse_id, {GRANULARITY} AS granularity FROM datasets",
       "datasets")
def h5(spark, sf):
    return table(spark, sf, "datasets").select("gse_id", classify.granularity(
        c("omics_granularity"), c("sample_count"), c("title"), c("platform"))
        .alias("granularity"))


_SC = []
for _term, _w in single_cell_terms():
    if _term == _term.lower() and _term not in [r[0] for r in _SC]:
        _SC.append((_term, _w, len(_SC)))
SC_HIT = ("s AS (SELECT gse_id, arg_min(w, n) AS w FROM ("
          + hits_("d", "gse_id", "txt", _SC, "term, w, n") + ") GROUP BY gse_id)")
D_CTE = f", d AS MATERIALIZED (SELECT gse_id, {squash_(TEXT)} AS txt FROM datasets), "
GRAIN = ("CASE WHEN w IS NOT NULL THEN 'single_cell' WHEN " + any_("txt", terms.SPATIAL_PHRASES)
         + " THEN 'spatial' WHEN " + any_("txt", terms.BULK_PHRASES) + " THEN 'bulk' WHEN "
         + any_("txt", ["rna-seq", "rna sequencing"]) + " THEN 'bulk' ELSE 'unknown' END")
GRAIN_W = ("CASE WHEN w IS NOT NULL THEN w::DOUBLE WHEN " + any_("txt", terms.SPATIAL_PHRASES)
           + " THEN 0.9::DOUBLE WHEN " + any_("txt", terms.BULK_PHRASES)
           + " THEN 0.8::DOUBLE WHEN " + any_("txt", ["rna-seq", "rna sequencing"])
           + " THEN 0.5::DOUBLE ELSE 0::DOUBLE END")


@query("h6_granularity_text", D_CTE + SC_HIT + f" SELECT gse_id, {GRAIN} AS granularity, "
       f"{GRAIN_W} AS weight FROM d LEFT JOIN s USING (gse_id)", "datasets")
def h6(spark, sf):
    df = squashed(table(spark, sf, "datasets")).withColumn("_g", text_granularity(c("_t")))
    return df.select("gse_id", "_g.granularity", "_g.weight")


PLATFORM = ("CASE WHEN platform = '' THEN '' ELSE " + case_(
    "lower(platform)", [(n, [p]) for p, n, _ in terms.PLATFORM_PATTERNS], "platform") + " END")


@query("h7_platform_mapping", f"SELECT gse_id, {PLATFORM} AS mapped, CASE WHEN platform = '' THEN "
       "'' ELSE " + case_("lower(platform)", [(k, [p]) for p, _, k in terms.PLATFORM_PATTERNS],
                          "'Unknown'") + " END AS category FROM datasets", "datasets")
def h7(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_m", classify.platform_mapping(c("platform")))
    return df.select("gse_id", "_m.mapped", "_m.category")


@query("h8_platform_names", "SELECT doc_id, coalesce(name, platform_code) AS platform FROM names "
       "LEFT JOIN platforms ON platform_code = code", "names platforms")
def h8(spark, sf):
    df = table(spark, sf, "names").withColumn("platform", c("platform_code"))
    return name_platforms(df, table(spark, sf, "platforms")).select("doc_id", "platform")


@query("h9_library_fields", "SELECT srx_id, coalesce("
       + map_("library_strategy", fixed("library_strategies")) + ", "
       + case_("lower(title)", terms.ASSAY_FROM_TITLE) + ", "
       + case_("lower(platform)", terms.ASSAY_FROM_PLATFORM) + ", '') AS assay, coalesce("
       + case_("upper(library_source)", [(g, [s]) for s, g in fixed("library_sources").items()])
       + ", " + case_("lower(title)", terms.LIBRARY_TITLE_GRANULARITY)
       + ", CASE WHEN sample_count > 1000 THEN 'single_cell' END, 'unknown') AS granularity "
         "FROM sra_packages", "sra_packages")
def h9(spark, sf):
    return table(spark, sf, "sra_packages").select(
        "srx_id", classify.assay_from_library(c("library_strategy"), c("title"), c("platform"))
        .alias("assay"), classify.granularity_from_library(
            c("library_source"), c("title"), c("sample_count")).alias("granularity"))


@query("h10_access_type", "SELECT srp_id, CASE WHEN contains(lower(consent), 'controlled') OR "
       "contains(lower(consent), 'dbgap') OR contains(lower(access_text), 'dbgap') OR "
       "contains(lower(access_text), 'phs') THEN 'controlled' WHEN srp_id <> '' THEN 'public' "
       "ELSE 'unknown' END AS access_type FROM study_docs", "study_docs")
def h10(spark, sf):
    return table(spark, sf, "study_docs").select("srp_id", classify.access_from_study(
        c("consent"), c("access_text"), c("srp_id")).alias("access_type"))


def _ids(pattern):
    return (f"array_to_string(list_filter(regexp_extract_all(abstract, {q(pattern)}), lambda x, i: "
            f"list_position(regexp_extract_all(abstract, {q(pattern)}), x) = i), '|')")


@query("h11_ids_in_text", "SELECT gse_id, " + _ids(r"(?i)\b(?:SRP|ERP|DRP|SRPX)[0-9]{4,}\b")
       + " AS studies, " + _ids(r"(?i)\bSRR[0-9]{4,}\b") + " AS runs, "
       + _ids(r"\bGSE[0-9]{4,7}\b") + " AS series FROM datasets", "datasets")
def h11(spark, sf):
    join = lambda a: F.array_join(a, "|")
    a = c("abstract")
    return table(spark, sf, "datasets").select(
        "gse_id", join(parse.study_ids(a)).alias("studies"), join(parse.run_ids(a)).alias("runs"),
        join(parse.series_ids(a)).alias("series"))


@query("h12_accession_type", "SELECT accession, count(*) AS n, CASE "
       + " ".join(f"WHEN regexp_matches(upper(accession), {q(p)}) THEN {q(n)}"
                  for n, p in terms.ACCESSION_TYPES)
       + " END AS kind FROM accessions GROUP BY accession", "accessions")
def h12(spark, sf):
    return table(spark, sf, "accessions").groupBy("accession").agg(
        F.count(F.lit(1)).alias("n")).withColumn("kind", parse.accession_type(c("accession")))


_LIB = squash_("concat(title, ' ', library_strategy, ' ', library_source, ' ', platform)")
_CELLS = any_("x", terms.CELL_WORDS + terms.NUCLEUS_WORDS)
_SINGLE = any_("x", terms.CELL_WORDS + terms.NUCLEUS_WORDS + terms.SPATIAL_WORDS)
LIBRARY = f"""CASE WHEN {any_('x', terms.ILLUMINA_WORDS)} THEN 'yes'
 WHEN {any_('x', terms.OTHER_SEQUENCER_WORDS)} THEN 'no' ELSE 'unsure' END AS is_illumina,
 CASE WHEN {_SINGLE} THEN 'yes' ELSE 'unsure' END AS is_single_cell,
 CASE WHEN prep = '10x_Genomics' AND NOT {_SINGLE} THEN 'other' ELSE prep END AS lib_prep,
 CASE WHEN prep = '10x_Genomics' AND {_SINGLE} THEN {case_('x', terms.TECH_10X, "'other'")}
 ELSE 'not_applicable' END AS tech_10x,
 CASE WHEN NOT {_SINGLE} THEN 'not_applicable' WHEN {any_('x', terms.NUCLEUS_WORDS)} THEN
 'single_nucleus' WHEN {any_('x', terms.CELL_WORDS)} THEN 'single_cell' ELSE 'unsure' END AS
 cell_prep, CASE WHEN {any_('x', terms.SPATIAL_WORDS)} THEN 'spatial' WHEN {_CELLS} THEN
 'single_cell' WHEN {any_('x', terms.BULK_WORDS)} THEN 'bulk' ELSE 'unknown' END AS granularity"""


@query("h13_library_classes", f"SELECT srx_id, {LIBRARY} FROM (SELECT srx_id, x, "
       f"{case_('x', terms.LIB_PREP, chr(39) + 'unknown' + chr(39))} AS prep FROM (SELECT srx_id, "
       f"{_LIB} AS x FROM sra_packages))", "sra_packages")
def h13(spark, sf):
    df = table(spark, sf, "sra_packages").withColumn("_x", t.squash(F.concat_ws(
        " ", "title", "library_strategy", "library_source", "platform")))
    return df.withColumns(classify.library_classes(c("_x"))).select(
        "srx_id", "is_illumina", "is_single_cell", "lib_prep", "tech_10x", "cell_prep",
        "granularity")


@query("h14_illumina", f"SELECT gse_id, CASE WHEN {any_('x', terms.ILLUMINA_WORDS)} THEN 'yes' WHEN "
       f"{any_('x', terms.OTHER_SEQUENCER_WORDS)} THEN 'no' ELSE 'unsure' END AS is_illumina FROM "
       f"(SELECT gse_id, {squash_('concat(platform, chr(32), abstract)')} AS x FROM datasets)",
       "datasets")
def h14(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_x", t.squash(F.concat_ws(
        " ", "platform", "abstract")))
    return df.select("gse_id", classify.illumina(c("_x")).alias("is_illumina"))


# --- files ---------------------------------------------------------------------------------

NAMES = "lower(concat_ws(' ', nullif(file_one, ''), nullif(file_two, '')))"
NAMES_TYPES = ("lower(concat_ws(' ', CASE WHEN file_one <> '' THEN concat(file_one, ' TXT') END, "
               "CASE WHEN file_two <> '' THEN concat(file_two, ' TAR') END))")
_SIZE = ("CASE WHEN sz > 1e9 THEN printf('(%.1fGB)', sz / 1e9) WHEN sz "
         " > 1e6 THEN printf('(%.1fMB)', sz / 1e6) WHEN sz > 1e3 THEN "
         "printf('(%.1fKB)', sz / 1e3) ELSE '' END")
SIGNAL = (f"CASE WHEN {any_('lower(platform)', terms.SINGLE_CELL_PLATFORMS)} THEN greatest(least("
          f"{count_('nt', terms.SINGLE_CELL_FILES)} * 0.25::DOUBLE, 1), 0.5) ELSE least("
          f"{count_('nt', terms.SINGLE_CELL_FILES)} * 0.25::DOUBLE, 1) END")
_SCW = ["scrna", "single-cell", "single cell"]
SKIP = (f"CASE WHEN bulk AND (signal > 0.1 OR {any_('txt', _SCW)} OR {any_('nt', _SCW)}) THEN "
        "'bulk files under a single-cell query' WHEN bulk THEN 'bulk array data' ELSE '' END")
FILE_CTE = (f", f AS (SELECT *, n_chars * 1000 + 7 AS sz, {NAMES_TYPES} AS nt, lower(concat(title, ' ', abstract, ' ', "
            f"overall_design)) AS txt, {NAMES} AS nm FROM datasets), g AS (SELECT *, {SIGNAL} AS "
            f"signal, {any_('nt', terms.BULK_FILES)} AS bulk FROM f) ")


@query("h15_file_format", FILE_CTE + "SELECT gse_id, signal::DOUBLE AS single_cell_signal, bulk AS "
       f"is_bulk_by_files, {SKIP} AS skip_reason, CASE WHEN nt = '' THEN 'no supplementary files' "
       f"ELSE concat_ws('; ', CASE WHEN file_one <> '' THEN file_one || {_SIZE} END, CASE WHEN "
       f"file_two <> '' THEN file_two || {_SIZE} END) END AS file_format_summary FROM g", "datasets")
def h15(spark, sf):
    df = records(spark, sf).withColumns({
        "_n": classify.file_names(c("supplementary_files"), "name", "type"),
        "_x": F.lower(t.join_text(c("title"), c("abstract"), c("overall_design")))})
    out = classify.file_format(c("supplementary_files"), c("_n"), c("platform"), c("_x"))
    return df.select("gse_id", *[v.alias(k) for k, v in out.items()])


PROCESSED = any_("nm", terms.PROCESSED_FILES)


@query("h16_file_flags", FILE_CTE + f"SELECT gse_id, {PROCESSED} AS has_processed_matrix, "
       f"{any_('nm', terms.RAW_FILES)} AND NOT {PROCESSED} AS raw_only FROM g", "datasets")
def h16(spark, sf):
    df = records(spark, sf).withColumn("_n", classify.file_names(c("supplementary_files"), "name"))
    return df.select("gse_id", *[v.alias(k) for k, v in classify.file_flags(c("_n")).items()])


# --- scores --------------------------------------------------------------------------------

def relevance_sql(single, title="title", summary="abstract", keyword="keyword", disease="disease",
                  tissue="organ"):
    """Relevance of the fixed query, written out: three terms, condition and cells asked for."""
    keys = (f"{key_(title)} AS tk, {key_(summary)} AS sk, {key_(keyword)} AS kk, "
            f"{key_(disease)} || {key_(tissue)} AS fk, lower({disease}) AS dl")
    dis = any_("tk || sk || kk || fk", [t.alnum_term(w) for w in terms.DISEASE_TERMS])
    cells = f"({single} OR " + any_("tk || sk || kk || fk", sorted(
        {t.alnum_term(w) for w in terms.SINGLE_CELL_TERMS})) + ")"
    words = QUERY.split()
    score_ = f"""round(least(1.0, (CASE WHEN dis THEN 0.45 ELSE 0 END + CASE WHEN cells THEN 0.25
 ELSE 0 END) * CASE WHEN dis THEN 1 ELSE 0.05 END * CASE WHEN cells THEN 1 ELSE 0.10 END * CASE WHEN
 cells THEN 1 ELSE 0.25 END * CASE WHEN dis OR cells THEN 1 ELSE 0.05 END + 0.15 *
 {count_('tk', words)} / 3.0 + 0.10 * ({' + '.join(
     f"CAST(contains(sk, {q(w)}) OR contains(kk, {q(w)}) AS INT)" for w in words)}) / 3.0 + 0.05 *
 least({count_('dl', words)}, 2) / 2.0)::DOUBLE, 6)"""
    return keys, dis, cells, score_


_K, _DIS, _CEL, REL = relevance_sql("contains(title, 'Single-cell')")


@query("h17_relevance", f", k AS (SELECT gse_id, title, {_K} FROM datasets), e AS (SELECT *, {_DIS} "
       f"AS dis, {_CEL} AS cells FROM k) SELECT gse_id, {REL} AS relevance FROM e", "datasets")
def h17(spark, sf):
    df = records(spark, sf).withColumns(score.text_keys(
        c("title"), c("abstract"), c("keywords"), c("disease"), c("organ")))
    value = score.relevance(score.Query.of(QUERY), F.contains("title", F.lit("Single-cell")))
    return df.select("gse_id", F.round(value, 6).alias("relevance"))


AGE = "date_diff('day', TRY_CAST(replace(publication_date, '/', '-') AS DATE), DATE '2025-06-30') / 365.25"
RECENCY = ("CASE WHEN publication_date = '' THEN 0 WHEN age <= 1 THEN 1 WHEN age <= 2 THEN 0.8 WHEN "
           "age <= 3 THEN 0.6 WHEN age <= 5 THEN 0.4 WHEN age <= 10 THEN 0.2 ELSE 0.1 END::DOUBLE")


@query("h18_recency", f"SELECT gse_id, {RECENCY} AS recency FROM (SELECT *, {AGE} AS age FROM "
       "datasets)", "datasets")
def h18(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", score.recency(c("publication_date"), AS_OF).alias("recency"))


YEARS = ("CASE WHEN publication_date = '' THEN 0.5 WHEN y <= 1 THEN 1 WHEN y <= 2 THEN 0.9 WHEN y <= 3 "
         "THEN 0.7 WHEN y <= 5 THEN 0.5 WHEN y <= 10 THEN 0.3 ELSE 0.1 END::DOUBLE")
YEAR_AGE = "2025 - TRY_CAST(left(publication_date, 4) AS INT)"


@query("h19_recency_by_year", f"SELECT gse_id, {YEARS} AS recency FROM (SELECT *, {YEAR_AGE} AS y FROM "
       "datasets)", "datasets")
def h19(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", score.recency_by_year(c("publication_date"), AS_OF).alias("recency"))


QUALITY = ("least(1.0, (0.2 + CASE WHEN pubmed_id <> '' THEN 0.2 ELSE 0 END + CASE WHEN sra_id <> '' THEN "
           "0.15 ELSE 0 END + CASE WHEN bioproject_id <> '' THEN 0.1 ELSE 0 END + CASE WHEN "
           "length(abstract) > 50 THEN 0.15 ELSE 0 END + CASE WHEN sample_count BETWEEN 10 AND 1000 THEN "
           "0.1 WHEN sample_count > 0 THEN 0.05 ELSE 0 END + CASE WHEN platform <> '' THEN 0.1 ELSE 0 "
           "END)::DOUBLE)")


@query("h20_quality", f"SELECT gse_id, round({QUALITY}, 6) AS quality FROM datasets", "datasets")
def h20(spark, sf):
    return records(spark, sf).select("gse_id", F.round(score.quality(
        c("gse_id"), c("pubmed_ids"), c("sra_ids"), c("bioproject_ids"), c("abstract"),
        c("sample_count"), c("platform")), 6).alias("quality"))


@query("h21_sample_scores", "SELECT gse_id, round(CASE WHEN sample_count > 0 THEN least(sample_count / "
       "1000.0, 1) ELSE 0 END::DOUBLE, 6) AS linear, round(CASE WHEN sample_count > 0 THEN least("
       "ln(sample_count + 1) / ln(10001), 1) ELSE 0 END::DOUBLE, 6) AS logarithmic FROM datasets",
       "datasets")
def h21(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", F.round(score.sample_share(c("sample_count")), 6).alias("linear"),
        F.round(score.sample_log(c("sample_count")), 6).alias("logarithmic"))


def species_sql(col, weights):
    return f"CASE WHEN {col} = '' THEN 0.3 " + " ".join(
        f"WHEN contains(lower({col}), {q(n)}) OR contains({q(n)}, lower({col})) THEN {w}"
        for n, w in weights) + " ELSE 0.4 END"


@query("h22_species_weight", f"SELECT doc_id, ({species_sql('species', terms.SPECIES_WEIGHTS)})::DOUBLE AS "
       "weight FROM names", "names")
def h22(spark, sf):
    return table(spark, sf, "names").select(
        "doc_id", score.species_weight(c("species")).alias("weight"))


PERT = all_("lower(concat(title, ' ', abstract))", terms.PERTURBATIONS)
_FOLD = {k.upper(): v for k, v in terms.PERTURBATION_WEIGHTS.items()}
STORED = "greatest(" + ", ".join(
    f"CASE WHEN contains('|' || p || '|', '|{k}|') THEN {v} ELSE 0 END" for k, v in _FOLD.items()) + ")"
FOUND = "CASE " + " ".join(
    f"WHEN regexp_matches(x, {q(score.perturbation_patterns()[n])}) THEN {w}" for n, w in sorted(
        terms.PERTURBATION_WEIGHTS.items(), key=lambda kv: -kv[1])) + " ELSE 0 END"
P_BONUS = f"(CASE WHEN p <> '' THEN {STORED} ELSE {FOUND} END)::DOUBLE"
C_BONUS = f"CASE WHEN regexp_matches(x, {q(terms.SINGLE_CELL_REGEX)}) THEN 0.1 ELSE 0 END::DOUBLE"
O_BONUS = "(" + map_("organism", terms.ORGANISM_WEIGHTS, "0") + ")::DOUBLE"
A_BONUS = "(" + map_("dt", terms.ASSAY_WEIGHTS, "0") + ")::DOUBLE"
BONUS_CTE = (f", b AS (SELECT *, {PERT} AS p, lower(concat(title, ' ', abstract)) AS x, {DATA_TYPE} AS dt "
             "FROM datasets) ")


@query("h23_bonuses", BONUS_CTE + f"SELECT gse_id, {P_BONUS} AS perturbation, {C_BONUS} AS single_cell, "
       f"{A_BONUS} AS assay, {O_BONUS} AS organism FROM b", "datasets")
def h23(spark, sf):
    df = table(spark, sf, "datasets").withColumn(
        "_x", F.lower(t.join_text(c("title"), c("abstract"))))
    kinds = t.all_classes(c("_x"), terms.PERTURBATIONS)
    return df.withColumn("_k", kinds).select(
        "gse_id", score.perturbation_bonus(c("_k"), c("_x")).alias("perturbation"),
        score.single_cell_bonus(F.lit(False), c("_x")).alias("single_cell"),
        score.assay_bonus(classify.data_type(c("omics_type"), c("title"), c("platform")))
        .alias("assay"), score.organism_bonus(c("organism")).alias("organism"))


MATCH = (f"(0.4 + 0.4 * {count_('x', QUERY.split())} / 3.0) * CASE WHEN NOT "
         f"{any_('x', terms.SOURCE_DISEASE_TERMS)} THEN 0.05 WHEN NOT "
         f"{any_('x', terms.SOURCE_SINGLE_CELL_TERMS)} THEN 0.10 ELSE 1 END")


@query("h24_match_score", f"SELECT gse_id, round(({MATCH})::DOUBLE, 6) AS score FROM (SELECT gse_id, "
       f"lower({TEXT}) AS x FROM datasets)", "datasets")
def h24(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_x", F.lower(t.join_text(
        c("title"), c("abstract"), c("overall_design"))))
    return df.select("gse_id", F.round(score.source_match(c("_x"), QUERY), 6).alias("score"))


@query("h25_hashes", "SELECT gse_id, left(sha256('{\"gse_id\":\"' || gse_id || '\",\"title\":\"' || title "
       "|| '\",\"sample_count\":' || sample_count || ',\"sra_ids\":[' || CASE WHEN sra_id = '' THEN '' "
       "ELSE '\"' || sra_id || '\"' END || ']}'), 16) AS metadata_hash, left(sha256(title), 16) AS "
       "query_hash, left(md5(title || '|' || gse_id), 12) AS cache_key FROM datasets", "datasets")
def h25(spark, sf):
    return records(spark, sf).select(
        "gse_id", metadata_hash(["gse_id", "title", "sample_count"], ["sra_ids"])
        .alias("metadata_hash"), query_hash(c("title")).alias("query_hash"),
        F.left(F.md5(F.concat_ws("|", "title", "gse_id")), F.lit(12)).alias("cache_key"))


SCORE = ("CASE WHEN v > 1 THEN v / 100 ELSE v END")


@query("h26_parse_score", f"SELECT gse_id, round(CASE WHEN v IS NOT NULL THEN least({SCORE}, 1) END, 6) AS score FROM (SELECT gse_id, "
       "TRY_CAST(nullif(regexp_extract(score_text, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS v FROM "
       "answers)", "answers")
def h26(spark, sf):
    return table(spark, sf, "answers").select(
        "gse_id", F.round(parse.parse_score(c("score_text")), 6).alias("score"))


ANSWER_TEXT = {
    0: '{"one_sentence_summary": "Study §", "sample_grouping": "a(n=1)/b(n=2)", "cell_count": "15K", '
       '"relevance_reason": "fits"}',
    1: '```json\n{"one_sentence_summary": "Study §", "cell_count": "2M"}\n```',
    2: 'Here it is: {"one_sentence_summary": "Study\n§", "relevance_reason": "so"} as asked',
    3: '{"one_sentence_summary": "Study §", "sample_grouping": "x", "cell_count": "1',
    4: 'no answer §', 5: '{"other": 1, "cell_count": "§"}',
    6: '{"one_sentence_summary": "Study §", "cell_count": "7',
}
_EXPECT = {
    0: ("Study §", "a(n=1)/b(n=2)", "15K", "fits"), 1: ("Study §", "NA", "2M", "-"),
    2: ("Study §", "NA", "NA", "so"), 3: ("Study §", "x", "NA", "-"),
    4: ("NA", "NA", "NA", "unreadable answer"), 5: ("NA", "NA", "§", "-"),
    6: ("Study §", "NA", "NA", "-"),
}


def _expected(i):
    return "CASE doc_id % 7 " + " ".join(
        f"WHEN {k} THEN replace({q(v[i])}, '§', CAST(doc_id AS VARCHAR))" for k, v in _EXPECT.items()) + " END"


def answer_text(df):
    out = None
    for k, v in ANSWER_TEXT.items():
        hit = c("doc_id") % 7 == k
        value = F.replace(F.lit(v), F.lit("§"), c("doc_id").cast("string"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return df.withColumn("answer", out)


@query("h27_parse_answer", "SELECT doc_id, " + ", ".join(
    f"{_expected(i)} AS {n}" for i, n in enumerate(
        ("one_sentence_summary", "sample_grouping", "cell_count", "relevance_reason")))
    + " FROM documents")
def h27(spark, sf):
    df = answer_text(table(spark, sf, "datasets")).withColumn("_a", parse.parse_answer(c("answer")))
    return df.select("doc_id", "_a.*")


_CELLS_RE = "(?i)(?:^|[^0-9,.])([0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?)\\s*cell"
_MILLION_RE = "(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(?:million|m\\b)"
CELLS = (f"(SELECT *, TRY_CAST(replace(regexp_extract(abstract, {q(_CELLS_RE)}, 1), ',', '') AS DOUBLE) AS "
         f"n1, TRY_CAST(regexp_extract(abstract, {q(_MILLION_RE)}, 1) AS DOUBLE) AS n2 FROM datasets)")
CELL_COUNT = ("CASE WHEN n1 >= 1000 THEN CAST(floor(n1 / 1000) AS BIGINT) || 'K' WHEN n1 IS NOT NULL THEN "
              "CAST(CAST(floor(n1) AS BIGINT) AS VARCHAR) WHEN n2 IS NOT NULL THEN CAST(floor(n2) AS BIGINT) "
              "|| 'M' END")


@query("h28_cell_count", f"SELECT gse_id, {CELL_COUNT} AS cells FROM {CELLS}", "datasets")
def h28(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", parse.cell_count(c("abstract")).alias("cells"))


def _grouping(p, label):
    g1 = f"nullif(regexp_extract(lower(abstract), {q(p)}, 1), '')"
    if not label:
        return f"{g1} || ' samples'"
    return f"{g1} || ' vs ' || regexp_extract(lower(abstract), {q(p)}, 2) || {q(f' ({label})')}"


@query("h29_sample_grouping", "SELECT gse_id, coalesce(" + ", ".join(
    _grouping(p, label) for p, label in parse.GROUPING_PATTERNS) + ") AS grouping_text FROM datasets",
    "datasets")
def h29(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", parse.sample_grouping(c("abstract")).alias("grouping_text"))


# --- samples -------------------------------------------------------------------------------

def token_sql(col):
    for pattern in ("(?i)^(GSE|GSM|SRP|SRR|SRX|ERR)[0-9]*_?", "(?i)^(GSM|SRX|ERR)[0-9]+", "^[_\\-]?[0-9]+",
                    "(_[0-9]+)+$", "_[0-9]+$", "[0-9]+$", "(?i)_rep[0-9]+$", "(?i)_r[0-9]+$", "^_"):
        col = f"regexp_replace({col}, {q(pattern)}, '')"
    return f"trim(lower({col}))"


def name_sql(col, names=None, title=None):
    names = names or fixed("group_names")
    title = title or f"upper(left({col}, 1)) || substr({col}, 2)"
    return ("coalesce(" + map_(col, names) + ", CASE " + " ".join(
        f"WHEN starts_with({col}, {q(k)}) THEN {q(v)}" for k, v in names.items())
        + f" END, {title})")


@query("h30_sample_token", f"SELECT gsm_id, {token_sql('title')} AS token FROM samples", "samples")
def h30(spark, sf):
    return table(spark, sf, "samples").select("gsm_id", groups.group_token(c("title")).alias("token"))


_TITLED = {"x day": "X Day", "x week": "X Week"}


@query("h31_group_name", f"SELECT gsm_id, {name_sql('tk', title=map_('tk', _TITLED, 'upper(left(tk, 1)) || substr(tk, 2)'))} "
       f"AS name FROM (SELECT gsm_id, {token_sql('title')} AS tk FROM samples)", "samples")
def h31(spark, sf):
    return table(spark, sf, "samples").select(
        "gsm_id", groups.group_name(groups.group_token(c("title"))).alias("name"))


_G32 = """CASE WHEN doc_id % 5 = 0 THEN 'control:0|Biological:0' WHEN doc_id % 5 = 1 THEN 'treatment:0'
 WHEN doc_id % 5 = 2 THEN 'treatment:0|Untreated:0' WHEN doc_id % 5 = 3 THEN 'case:0|control:0'
 WHEN sample_count >= 4 THEN 'case:' || (sample_count // 2) || '|control:' || (sample_count -
 sample_count // 2) WHEN sample_count >= 2 THEN 'unknown:' || sample_count ELSE '' END"""


@query("h32_groups_from_text", f"SELECT gse_id, {_G32} AS groups FROM datasets", "datasets")
def h32(spark, sf):
    found = groups.groups_from_text(F.lit(""), c("overall_design"), c("sample_count"))
    return table(spark, sf, "datasets").withColumn("_g", found).select("gse_id", F.array_join(
        F.transform("_g", lambda g: F.concat(g["name"], F.lit(":"), g["n"].cast("string"))), "|")
        .alias("groups"))


@query("h33_contrast_and_design", "SELECT gse_id, doc_id % 5 = 4 AND sample_count >= 4 AS contrast_ready, "
       "CASE WHEN doc_id % 5 = 1 OR (doc_id % 5 = 4 AND sample_count BETWEEN 2 AND 3) THEN 'single-group' "
       "WHEN doc_id % 5 = 4 AND sample_count < 2 THEN 'multi-group' ELSE 'binary' END AS design FROM "
       "datasets", "datasets")
def h33(spark, sf):
    found = groups.groups_from_text(F.lit(""), c("overall_design"), c("sample_count"))
    return table(spark, sf, "datasets").withColumn("_g", found).select(
        "gse_id", groups.contrast_ready(c("_g")).alias("contrast_ready"),
        groups.design_label(F.size("_g")).alias("design"))


@query("h34_attribute_lines", "SELECT gsm_id, 'kind=' || kind || '|source_name=' || title || '|tissue=' || "
       "tissue AS attributes FROM samples", "samples")
def h34(spark, sf):
    text = F.concat(F.lit("Source Name: first\nno pair here\n Tissue :"), c("tissue"), F.lit("\nkind: "),
                    c("kind"), F.lit("\nsource name: "), c("title"))
    df = table(spark, sf, "samples").withColumn("_m", parse.attribute_lines(text))
    pairs = F.array_sort(F.transform(F.map_entries("_m"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])))
    return df.select("gsm_id", F.array_join(pairs, "|").alias("attributes"))


# --- sentences and prompts -----------------------------------------------------------------

@query("h35_sentence", "SELECT gse_id, coalesce(nullif(concat_ws('; ', CASE WHEN disease <> '' AND organ <> '' "
       "THEN disease || ' ' || organ || ' dataset' WHEN disease <> '' THEN disease || ' dataset' WHEN organ <> "
       "'' THEN organ || ' dataset' END, CASE WHEN omics_type <> '' THEN CASE WHEN omics_granularity NOT IN "
       "('unknown', 'bulk') THEN omics_granularity || ' ' || omics_type ELSE omics_type END END, CASE WHEN "
       "platform <> '' THEN 'using ' || platform END, CASE WHEN sample_count > 0 THEN sample_count || ' samples' "
       "END, CASE WHEN sample_count > 100 THEN 'suitable for comparative analysis' END), ''), "
       "'Dataset with limited metadata') AS sentence FROM datasets", "datasets")
def h35(spark, sf):
    none = F.array().cast("array<struct<name:string,n:bigint>>")
    return table(spark, sf, "datasets").select("gse_id", render.inference_sentence(
        c("disease"), c("organ"), c("omics_type"), c("omics_granularity"), c("platform"),
        c("sample_count"), none, c("sample_count") > 100).alias("sentence"))


_OR = lambda x: f"CASE WHEN {x} = '' THEN 'unknown' ELSE {x} END"
_PROMPT = f"""concat_ws(chr(10), 'Query: {QUERY}', 'Title: ' || title, 'Summary: ' || CASE WHEN
 length(abstract) > 500 THEN left(abstract, 500) || '...' ELSE abstract END, 'Design: ' ||
 left(overall_design, 200), 'Organism: ' || {_OR('organism')}, 'Data type: ' || {DATA_TYPE},
 'Granularity: ' || {GRANULARITY}, 'Disease: ' || {_OR('disease')}, 'Tissue: ' || {_OR('organ')},
 'Perturbation: ' || CASE WHEN {PERT} <> '' THEN 'Yes (' || replace({PERT}, '|', ', ') || ')' ELSE 'No'
 END, 'Samples: ' || sample_count, 'Files: ' || CASE WHEN file_one <> '' AND file_two <> '' THEN 'TAR, TXT'
 WHEN file_one <> '' THEN 'TXT' WHEN file_two <> '' THEN 'TAR' ELSE 'none' END, 'Series matrix: not available',
 'Year: ' || {_OR('left(publication_date, 4)')}, 'Keywords: ' || CASE WHEN keyword <> '' THEN keyword ELSE
 'none' END)"""


@query("h36_score_prompt", f"SELECT gse_id, {_PROMPT} AS prompt FROM datasets", "datasets")
def h36(spark, sf):
    df = records(spark, sf).withColumns({
        "data_type": classify.data_type(c("omics_type"), c("title"), c("platform")),
        "granularity": classify.granularity(c("omics_granularity"), c("sample_count"), c("title"),
                                            c("platform")),
        "summary": c("abstract"), "tissue": c("organ"),
        "perturbation_types": t.all_classes(F.lower(t.join_text(c("title"), c("abstract"))),
                                            terms.PERTURBATIONS)})
    df = df.withColumn("has_perturbation", F.size("perturbation_types") > 0)
    return df.select("gse_id", render.score_prompt(QUERY).alias("prompt"))


@query("h37_boolean_query", "SELECT gse_id, concat_ws(' AND ', CASE WHEN disease <> '' THEN '(' || disease || "
       "' OR uric acid)' END, '(' || organism || ' OR any)') AS query FROM datasets", "datasets")
def h37(spark, sf):
    first = F.when(c("disease") != "", F.array(c("disease"), F.lit("uric acid"), F.lit("cut"))).otherwise(
        F.array().cast("array<string>"))
    return table(spark, sf, "datasets").select("gse_id", render.boolean_query(
        render.boolean_group(first, 2), render.boolean_group(F.array(c("organism"), F.lit("any"))))
        .alias("query"))


_RELAX = ("array_to_string(list_filter(string_split(title, ' '), lambda x: NOT list_contains("
          f"{terms.RELAX_WORDS!r}, lower(x))), ' ')")
_REFINE = "title"
for _w in terms.REFINE_WORDS:
    _REFINE = f"CASE WHEN contains(lower({_REFINE}), '{_w}') THEN {_REFINE} ELSE {_REFINE} || ' {_w}' END"


@query("h38_relax_refine", f"SELECT gse_id, CASE WHEN {_RELAX} = title THEN title || '*' ELSE {_RELAX} END AS "
       f"relaxed, {_REFINE} AS refined FROM datasets", "datasets")
def h38(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", render.relaxed(c("title"), terms.RELAX_WORDS).alias("relaxed"),
        render.refined(c("title"), terms.REFINE_WORDS).alias("refined"))


_TK = ("list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 1)")
_PT = "list_has_any(tk, " + repr([w for _, ws in terms.QUERY_PERTURBATIONS for w in ws]) + ")"
_SCQ, _SPQ = any_("x", terms.QUERY_SINGLE_CELL), any_("x", terms.QUERY_SPATIAL)
_DSQ = any_("x", terms.QUERY_DISEASES)
PARSED = f"(SELECT gse_id, lower(title) AS x, {_TK} AS tk FROM datasets)"


@query("h39_intent", f"SELECT gse_id, CASE WHEN {_SCQ} THEN 'single_cell' WHEN {_SPQ} THEN 'spatial' WHEN {_PT} "
       f"THEN 'drug' WHEN {_DSQ} THEN 'disease' ELSE 'general' END AS intent FROM {PARSED}", "datasets")
def h39(spark, sf):
    return parse_queries(table(spark, sf, "datasets"), "title").select("gse_id", "intent")


_ST = "lower(study_status)"
_GONE = f"{_ST} IN ('withdrawn', 'suppressed', 'replaced')"
_CLOSED = any_("lower(access_text)", terms.CONTROLLED_WORDS)
_AGREED = any_("lower(consent)", ["controlled", "dbgap"])
AVAILABILITY = f"""CASE WHEN {_GONE} THEN 'unavailable' WHEN {_CLOSED} OR {_AGREED} THEN 'restricted' WHEN
 run_count = 0 THEN 'unavailable' ELSE 'available' END AS availability_status, CASE WHEN {_GONE} THEN 'unknown'
 WHEN {_CLOSED} OR {_AGREED} THEN 'controlled' ELSE 'public' END AS access_type, CASE WHEN {_GONE} THEN
 'Study status: ' || {_ST} WHEN {_CLOSED} THEN 'dbGaP controlled access detected' WHEN {_AGREED} THEN
 'Controlled access per consent' WHEN run_count = 0 THEN 'No RUN data found' WHEN run_count < 2 THEN
 'Low sample count (' || run_count || ' < 2)' ELSE '' END AS availability_note"""


@query("h40_availability", f"SELECT srp_id, {AVAILABILITY} FROM study_docs", "study_docs")
def h40(spark, sf):
    out = parse.availability(c("study_status"), c("access_text"), c("consent"), c("run_count"), 2)
    return table(spark, sf, "study_docs").select("srp_id", *[v.alias(k) for k, v in out.items()])


_MISS = "(CASE WHEN {0} IN ('', 'unknown') THEN 1 ELSE 0 END)"
NEEDS = " + ".join(_MISS.format(x) for x in ("disease", "organ", "omics_type", "omics_granularity")) + " >= 2"


@query("h41_needs_answer", f"SELECT gse_id, {NEEDS} AS needed FROM datasets", "datasets")
def h41(spark, sf):
    return table(spark, sf, "datasets").select("gse_id", needs_answer(
        c("disease"), c("organ"), c("omics_type"), c("omics_granularity")).alias("needed"))


@query("h42_transition", "SELECT event_id, old_status = new_status OR (old_status, new_status) IN ("
       + ", ".join(f"('{a}', '{b}')" for a, b in terms.REVIEW_TRANSITIONS) + ") AS allowed FROM changes",
       "changes")
def h42(spark, sf):
    return table(spark, sf, "changes").select(
        "event_id", valid_transition(c("old_status"), c("new_status")).alias("allowed"))


@query("h43_prefer_answer", f"SELECT gse_id, CASE doc_id % 7 WHEN 0 THEN '15K' WHEN 1 THEN '2M' WHEN 5 THEN "
       f"CAST(doc_id AS VARCHAR) ELSE coalesce({CELL_COUNT}, 'NA') END AS cells FROM {CELLS}", "datasets")
def h43(spark, sf):
    df = answer_text(table(spark, sf, "datasets"))
    return df.select("gse_id", parse.prefer_answer(
        parse.parse_answer(c("answer"))["cell_count"], parse.cell_count(c("abstract"))).alias("cells"))


@query("h44_fill_from_answers", "SELECT d.gse_id, CASE WHEN need AND d.disease = '' AND a.disease <> '' THEN "
       "a.disease ELSE d.disease END AS disease, CASE WHEN need AND d.organ = '' AND a.organ <> '' THEN a.organ "
       "ELSE d.organ END AS organ, CASE WHEN need AND d.disease = '' AND a.disease <> '' THEN 'answer' WHEN "
       f"d.disease <> '' THEN 'rule' ELSE '' END AS disease_source FROM (SELECT *, {NEEDS} AS need FROM datasets) d "
       "JOIN answers a USING (gse_id)", "datasets answers")
def h44(spark, sf):
    df = table(spark, sf, "datasets").select(
        "gse_id", c("disease").alias("i_disease"), c("organ").alias("i_organ"),
        c("omics_type").alias("i_assay"), c("omics_granularity").alias("i_granularity"),
        *[F.lit(1.0).alias(f"i_{x}_weight") for x in ("disease", "organ", "assay", "granularity")])
    # Fields are filled one after the other from what was unknown at the start.
    return fill_from_answers(df, table(spark, sf, "answers")).select(
        "gse_id", c("i_disease").alias("disease"), c("i_organ").alias("organ"),
        c("i_disease_source").alias("disease_source"))


@query("h45_has_meaning", f"SELECT gse_id, {_SCQ} OR {_SPQ} OR {_PT} OR {_DSQ} OR list_has_any(tk, "
       f"{terms.QUERY_TISSUES!r}) OR list_has_any(tk, {[w for _, ws in terms.QUERY_ORGANISMS for w in ws]!r}) OR "
       f"list_has_any(tk, {[w for _, ws in terms.QUERY_ASSAYS for w in ws]!r}) OR "
       f"{any_('array_to_string(tk, chr(32))', [w for _, ws in terms.QUERY_ASSAYS for w in ws if len(w) > 5])} "
       f"AS has_meaning FROM {PARSED}", "datasets")
def h45(spark, sf):
    return parse_queries(table(spark, sf, "datasets"), "title").select("gse_id", "has_meaning")


@cache
def vocabularies(spark):
    """Read once per session, as a job would."""
    return Vocabularies.of(vocab_terms(seed_entries(spark), matching_only=True),
                           keyword_vocab(spark, terms.DISEASE_TERMS))


INFER_CTE = (D_CTE + SC_HIT + ", " + best_("hd", "d", "gse_id", "txt", disease_rows()) + ", "
             + best_("ho", "d", "gse_id", "txt", seed_terms("organ")) + ", "
             + best_("ha", "d", "gse_id", "txt", seed_terms("assay")))
INFER_FROM = ("d LEFT JOIN s USING (gse_id) LEFT JOIN hd USING (gse_id) LEFT JOIN ho USING (gse_id) "
              "LEFT JOIN ha USING (gse_id)")


@query("s14_weighted_vocabulary", INFER_CTE + " SELECT gse_id, coalesce(hd.canonical, '') AS disease, "
       "coalesce(ho.canonical, '') AS organ, coalesce(ha.canonical, '') AS assay, CASE WHEN ha.canonical IS NOT "
       f"NULL THEN ha.granularity ELSE {GRAIN} END AS granularity, coalesce(ho.weight, 0)::DOUBLE AS organ_weight "
       f"FROM {INFER_FROM}", "datasets")
def s14(spark, sf):
    """Weighted vocabulary terms at work: the best condition, organ and assay of every text."""
    df = infer_fields(squashed(table(spark, sf, "datasets")), c("_t"), vocabularies(spark))
    return df.select("gse_id", F.coalesce("i_disease", F.lit("")).alias("disease"),
                     F.coalesce("i_organ", F.lit("")).alias("organ"),
                     F.coalesce("i_assay", F.lit("")).alias("assay"),
                     c("i_granularity").alias("granularity"), c("i_organ_weight").alias("organ_weight"))
