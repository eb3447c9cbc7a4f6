"""Filters and projections F1-F17, P1-P9."""

from datetime import date

from pyspark.sql import functions as F

from lodecat.fixed import table as fixed, terms
from lodecat.functions import parse, render, score, text as t
from lodecat.operators import filters as f

from lodecat.plans import inference, search
from lodecat.plans.ranking import skip_reasons
from lodecat.plans.view import to_view
from workload.derived import AS_OF, QUERY, given, records, table
from workload.registry import query
from workload.scalars import (
    DATA_TYPE, FILE_CTE, GRANULARITY, MATCH, PERT, QUALITY, RECENCY, SKIP, AGE, INFER_CTE, INFER_FROM,
    GRAIN, PLATFORM, relevance_sql, vocabularies,
)
from workload.sqltext import any_, case_, longest_
from workload.text import TEXT

c, lit = F.col, F.lit


@query("f1_list_datasets", "SELECT gse_id, title, last_updated FROM datasets d WHERE availability_status = 'available' AND contains(lower("
       "organism), 'sapiens') AND EXISTS (SELECT 1 FROM topic_datasets t WHERE t.gse_id = d.gse_id AND topic_id = 'T3' AND review_status = "
       "'pending') ORDER BY last_updated DESC, gse_id LIMIT 20 OFFSET 2", "datasets topic_datasets")
def f1(spark, sf):
    return f.list_datasets(table(spark, sf, "datasets"), table(spark, sf, "topic_datasets"), "T3", "pending",
                           availability="available", organism="Sapiens", limit=20, offset=2).select(
        "gse_id", "title", "last_updated")


@query("f2_rule_filter", "SELECT gse_id FROM datasets WHERE organism IN ('Homo sapiens', 'Mus musculus') AND access_type NOT IN ('controlled') AND "
       "sample_count BETWEEN 100 AND 900", "datasets")
def f2(spark, sf):
    rules = f.Filters([f.Rule("organism", ("Homo sapiens", "Mus musculus")), f.Rule("access_type", excluded=("controlled",)),
                       f.Rule("sample_count", at_least=100, at_most=900), f.Rule("title", at_least=3),
                       f.Rule("no_such_field", excluded=("x",))])
    return rules.apply(table(spark, sf, "datasets")).select("gse_id")


def flagged(spark, sf):
    df = records(spark, sf)
    return df.withColumns({
        "single_cell": F.contains(F.lower("title"), lit("single-cell")),
        "has_perturbation": F.size(t.all_classes(F.lower("title"), terms.PERTURBATIONS)) > 0,
        "data_type": c("omics_type"),
        "quality_score": score.quality(c("gse_id"), c("pubmed_ids"), c("sra_ids"), c("bioproject_ids"), c("abstract"),
                                       c("sample_count"), c("platform"))})


@query("f3_filter_builder", f"SELECT gse_id FROM datasets WHERE organism = 'Homo sapiens' AND omics_type = 'scRNA-seq' AND contains(lower(title), "
       f"'single-cell') AND sample_count >= 50 AND {QUALITY} >= 0.5", "datasets")
def f3(spark, sf):
    chain = f.Filters().organism("Homo sapiens").data_type("scRNA-seq").single_cell().min_samples(50).min_quality(0.5)
    return chain.apply(flagged(spark, sf)).select("gse_id")


@query("f4_custom_predicate", "SELECT gse_id FROM datasets WHERE organism = 'Homo sapiens' AND length(title) % 2 = 0", "datasets")
def f4(spark, sf):
    return f.Filters().organism("Homo sapiens").add(F.length("title") % 2 == 0).apply(
        table(spark, sf, "datasets")).select("gse_id")


@query("f5_presets", f"SELECT 'quality' AS preset, gse_id FROM datasets WHERE {QUALITY} >= 0.3 UNION ALL SELECT 'single_cell', gse_id FROM datasets "
       "WHERE contains(lower(title), 'single-cell') UNION ALL SELECT 'perturbation', gse_id FROM datasets WHERE "
       + any_("lower(title)", [w for _, ws in terms.PERTURBATIONS for w in ws])
       + " UNION ALL SELECT 'human', gse_id FROM datasets WHERE organism = 'Homo sapiens'", "datasets")
def f5(spark, sf):
    df, out = flagged(spark, sf), None
    for name, make in f.PRESETS.items():
        part = make().apply(df).select(lit(name).alias("preset"), "gse_id")
        out = part if out is None else out.unionByName(part)
    return out


_X = f"(SELECT *, lower({TEXT}) AS x FROM datasets)"


@query("f6_threshold", f"SELECT gse_id FROM {_X} WHERE round(({MATCH})::DOUBLE, 9) >= 0.3", "datasets")
def f6(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_x", F.lower(t.join_text(c("title"), c("abstract"), c("overall_design"))))
    return df.filter(F.round(score.source_match(c("_x"), QUERY), 9) >= 0.3).select("gse_id")


@query("f7_title_gate", f"SELECT pmid FROM papers WHERE {any_('lower(title)', QUERY.split())}", "papers")
def f7(spark, sf):
    return table(spark, sf, "papers").filter(score.title_relevant(F.lower("title"), QUERY)).select("pmid")


_FLOOR = "sample_count / 4000.0"


@query("f8_format_prefilter", FILE_CTE + f"SELECT gse_id, CASE WHEN sr <> '' THEN sr WHEN {_FLOOR} < 0.05 THEN 'low' ELSE '' END AS reason FROM (SELECT *, "
       f"{SKIP} AS sr FROM g)", "datasets")
def f8(spark, sf):
    df = records(spark, sf).withColumns({"summary": c("abstract"), "relevance_score": c("sample_count") / 4000.0})
    return skip_reasons(df).select("gse_id", F.when(F.startswith("skip_reason", lit("relevance")), "low")
                                   .otherwise(c("skip_reason")).alias("reason"))


@query("f9_series_ids", "SELECT pmid, gse_id FROM paper_links WHERE regexp_matches(gse_id, '^GSE[0-9]+$')", "paper_links")
def f9(spark, sf):
    return table(spark, sf, "paper_links").filter(parse.is_series_id(c("gse_id"))).select("pmid", "gse_id")


@query("f10_date_range", "SELECT gse_id FROM datasets WHERE publication_date = '' OR TRY_CAST(replace(publication_date, '/', '-') AS DATE) BETWEEN "
       "DATE '2012-03-01' AND DATE '2020-06-30'", "datasets")
def f10(spark, sf):
    return f.between_dates(table(spark, sf, "datasets"), "publication_date", date(2012, 3, 1), date(2020, 6, 30)).select("gse_id")


@query("f11_study_predicate", "SELECT srx_id FROM sra_packages WHERE contains(lower(platform), 'illumina') AND run_count > 0 AND organism = 'human' "
       "AND NOT " + any_("lower(title)", terms.LOW_THROUGHPUT), "sra_packages")
def f11(spark, sf):
    df = table(spark, sf, "sra_packages").withColumn("access_type", lit("public"))
    return df.filter(f.study_predicate(["Homo sapiens", "cow"], strict=True)).select("srx_id")


@query("f12_boolean_terms", f"SELECT gse_id, {any_('x', ['gout', 'uric acid'])} AND {any_('x', ['single', 'scrna'])} AS fixed_terms, contains(x, "
       f"lower(source)) AND contains(x, 'liver') AS row_terms FROM {_X}", "datasets")
def f12(spark, sf):
    df = table(spark, sf, "datasets").withColumn("_x", F.lower(t.join_text(c("title"), c("abstract"), c("overall_design"))))
    groups = F.array(F.array(c("source"), c("source")), F.array(lit("liver")))
    return df.select("gse_id", f.boolean_terms(c("_x"), [["gout", "uric acid"], ["single", "scRNA"]]).alias("fixed_terms"),
                     f.boolean_terms_column(c("_x"), groups).alias("row_terms"))


@query("f13_sanitise_query", "SELECT conv_id, turn, trim(regexp_replace(translate(regexp_replace(role || '  “q” – ' || text, '[\\x00-\\x1f\\x7f-"
       "\\x{9f}]', '', 'g'), '‘’“”—–' || chr(160), '''''\"\"-- '), '\\s+', ' ', 'g')) AS cleaned, CASE WHEN trim(text) = '' THEN 'empty' WHEN "
       "length(text) > 1000 THEN 'too long' END AS error FROM conversations")
def f13(spark, sf):
    df = given(spark, sf, "conversations")
    return df.select("conv_id", "turn", parse.clean_query(F.concat("role", lit("  “q” – "), "text")).alias("cleaned"),
                     parse.query_error(c("text")).alias("error"))


@query("f14_review_listing", "SELECT edge_id, gse_id, title FROM topic_datasets JOIN datasets USING (gse_id) WHERE review_status = 'pending' ORDER BY "
       "added_at DESC, edge_id LIMIT 50", "topic_datasets datasets")
def f14(spark, sf):
    return f.review_listing(table(spark, sf, "topic_datasets"), table(spark, sf, "datasets")).select("edge_id", "gse_id", "title")


@query("f15_review_log", "SELECT log_id, topic_id, gse_id, action FROM review_log WHERE topic_id = 'T4' ORDER BY acted_at DESC, log_id DESC LIMIT 20",
       "review_log")
def f15(spark, sf):
    return f.review_log(table(spark, sf, "review_log"), topic_id="T4").select("log_id", "topic_id", "gse_id", "action")


@query("f16_to_check", "SELECT gse_id, sra_id AS srp_id FROM datasets WHERE sra_id <> '' AND availability_status IN ('', 'unverified')", "datasets")
def f16(spark, sf):
    return f.to_check(records(spark, sf)).select("gse_id", "srp_id")


@query("f17_accounting", "SELECT count(*) AS total, count(*) FILTER (organism = 'Homo sapiens') AS after_filter, count(*) FILTER (organism <> "
       "'Homo sapiens') AS filtered_out FROM datasets", "datasets")
def f17(spark, sf):
    return f.Filters().organism("Homo sapiens").account(table(spark, sf, "datasets"))


# --- projections ---------------------------------------------------------------------------

@query("p1_geo_projection", f"SELECT gse_id, title, organism, sample_count, 'geo' AS match_source, round(({MATCH})::DOUBLE, 6) AS match_score FROM {_X}",
       "datasets")
def p1(spark, sf):
    df = table(spark, sf, "datasets").withColumn("pos", c("doc_id"))
    return search.from_geo(df, QUERY).select("gse_id", "title", "organism", "sample_count", "match_source",
                                             F.round("match_score", 6).alias("match_score"))


@query("p2_extract_studies", "SELECT srx_id, CASE WHEN gse_id <> '' THEN gse_id ELSE 'SRP:' || srp_id END AS gse_id, CASE organism WHEN 'human' THEN "
       "'Homo sapiens' WHEN 'R.norvegicus' THEN 'Rattus norvegicus' ELSE 'Mus musculus' END AS organism, "
       + longest_("lower(title)", fixed("disease_aliases"), "''") + " AS disease, "
       + longest_("lower(title)", fixed("organ_aliases"), "''") + " AS organ, "
       + longest_("lower(platform)", fixed("platform_aliases"), "platform") + " AS platform, gse_id <> '' AS has_gse, 'public' AS access_type "
       "FROM sra_packages", "sra_packages")
def p2(spark, sf):
    df = table(spark, sf, "sra_packages").withColumns({
        "gse_ids": F.when(c("gse_id") == "", F.array().cast("array<string>")).otherwise(F.array("gse_id")),
        "instrument": c("platform"), "bioproject_ids": F.array("bioproject_id"), "accession_auth": lit(""),
        "study_alias": c("srx_id")})
    return search.extract_studies(df.withColumn("title", F.concat_ws("\u0001", "title", "srx_id"))).select(
        F.substring_index("title", "\u0001", -1).alias("srx_id"), "gse_id", "organism", "disease", "organ", "platform", "has_gse",
        "access_type")




_PK, _PD, _PC, _PR = relevance_sql("granularity = 'single_cell'", tissue="tissue", disease="disease2")
VIEW_CTE = INFER_CTE + f""", w0 AS (SELECT x.*, coalesce(hd.canonical, '') AS i_d, coalesce(ho.canonical, '') AS i_o, coalesce(ha.canonical, '') AS i_a,
 CASE WHEN ha.canonical IS NOT NULL THEN ha.granularity ELSE {GRAIN} END AS i_g, {DATA_TYPE} AS own, {GRANULARITY} AS own_g, txt, {AGE} AS age FROM datasets x
 JOIN {INFER_FROM} USING (gse_id)),
 w1 AS (SELECT *, CASE WHEN i_g <> 'unknown' THEN i_g ELSE own_g END AS granularity, CASE WHEN disease <> '' THEN disease ELSE i_d END AS disease2,
 CASE WHEN organ <> '' THEN organ ELSE i_o END AS organ2, CASE WHEN own = 'other' AND i_a <> '' THEN coalesce({case_('lower(i_a)', [
     terms.DATA_TYPE_FROM_ASSAY[5], *[x for i, x in enumerate(terms.DATA_TYPE_FROM_ASSAY) if i != 5]])}, 'other') ELSE own END AS data_type FROM w0),
 w2 AS (SELECT *, CASE WHEN organ2 <> '' THEN organ2 ELSE {case_('txt', terms.TISSUES, "''")} END AS tissue, {PERT} AS perturbations,
 {PLATFORM} AS mapped FROM w1),
 w3 AS (SELECT *, {_PK} FROM w2), w4 AS (SELECT *, {_PD} AS dis, {_PC} AS cells FROM w3),
 viewed AS (SELECT gse_id, title, organism, sample_count, data_type, granularity, granularity = 'single_cell' AS single_cell, disease2 AS disease,
 organ2 AS organ, tissue, perturbations, mapped AS platform, {_PR} AS relevance, {RECENCY} AS recency, {QUALITY} AS quality FROM w4) """
VIEW_FIELDS = ["gse_id", "data_type", "granularity", "single_cell", "disease", "organ", "tissue", "platform"]


def view(spark, sf):
    return to_view(records(spark, sf), QUERY, AS_OF, vocabularies(spark))


@query("p3_view_conversion", VIEW_CTE + "SELECT " + ", ".join(VIEW_FIELDS) + ", perturbations, relevance, recency, round(quality, 6) AS quality FROM viewed",
       "datasets")
def p3(spark, sf):
    return view(spark, sf).select(
        *VIEW_FIELDS, F.array_join("perturbation_types", "|").alias("perturbations"), F.round("relevance_score", 6).alias("relevance"),
        c("recency_score").alias("recency"), F.round("quality_score", 6).alias("quality"))


@query("p5_api_projection", "SELECT gse_id, title, sample_count, organism, platform, match_score AS relevance_score FROM topic_datasets JOIN datasets "
       "USING (gse_id) WHERE review_status = 'approved'", "topic_datasets datasets")
def p5(spark, sf):
    from lodecat.operators.joins import topic_view
    df = table(spark, sf, "datasets")
    return topic_view(table(spark, sf, "topic_datasets"), df, review_status="approved").select(
        "gse_id", "title", "sample_count", "organism", "platform", c("match_score").alias("relevance_score"))


@query("p6_merge_inferred", INFER_CTE + " SELECT gse_id, CASE WHEN disease IN ('', 'unknown') THEN coalesce(hd.canonical, 'unknown') ELSE disease END AS "
       "disease, CASE WHEN organ IN ('', 'unknown') THEN coalesce(ho.canonical, 'unknown') ELSE organ END AS organ, CASE WHEN omics_granularity IN ('', "
       f"'unknown') THEN CASE WHEN ha.canonical IS NOT NULL THEN ha.granularity ELSE {GRAIN} END ELSE omics_granularity END AS omics_granularity FROM datasets "
       f"JOIN {INFER_FROM} USING (gse_id)", "datasets")
def p6(spark, sf):
    df = table(spark, sf, "datasets")
    inferred = inference.infer_fields(df.withColumn("_t", t.squash(t.join_text(c("title"), c("abstract"), c("overall_design")))),
                                      c("_t"), vocabularies(spark))
    return inference.merge_inferred(df, inferred).select("gse_id", "disease", "organ", "omics_granularity")


@query("p7_display_truncation", "SELECT gse_id, CASE WHEN length(title) > 42 THEN left(title, 42) || '...' ELSE title END AS title, CASE WHEN organism = '' "
       "THEN '—' ELSE organism END AS organism, CASE WHEN sample_count > 0 THEN CAST(sample_count AS VARCHAR) ELSE '—' END AS samples FROM datasets", "datasets")
def p7(spark, sf):
    return table(spark, sf, "datasets").select(
        "gse_id", render.shorten(c("title"), 42).alias("title"), render.dash_if_empty(c("organism")).alias("organism"),
        render.count_or_dash(c("sample_count")).alias("samples"))


@query("p8_human_size", "SELECT doc_id, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN "
       "printf('%.1fMB', b / 1048576.0::DOUBLE) ELSE printf('%.2fGB', b / 1073741824.0::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * n_chars * 3 + 1 AS b "
       "FROM documents)")
def p8(spark, sf):
    return given(spark, sf, "documents").select("doc_id", render.human_size(c("n_chars") * c("n_chars") * 3 + 1).alias("size"))


@query("p9_schema_evolution", "SELECT gse_id, title, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE '' END AS note, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS INT) "
       "AS revision FROM datasets", "datasets")
def p9(spark, sf):
    """Rows of an older table take part with defaults for the columns it lacks."""
    from lodecat.sources.landed import with_defaults
    df = table(spark, sf, "datasets")
    old = df.filter("doc_id % 2 = 1 AND doc_id % 3 <> 0").select("gse_id", "title")
    mid = df.filter("doc_id % 2 = 1 AND doc_id % 3 = 0").select("gse_id", "title", lit(2).alias("revision"))
    new = df.filter("doc_id % 2 = 0").select("gse_id", "title", lit("new").alias("note"),
                                             F.when(c("doc_id") % 3 == 0, 2).alias("revision"))
    both = old.unionByName(mid, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)
    return with_defaults(both, "gse_id string, title string, note string, revision int")
