"""Sources and sinks S1-S13, K1-K9: landed documents are written out of the given tables and
read back, so the checking SQL states what must come out."""

from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.operators.joins import get_datasets
from lodecat.schemas import DATASET_VIEW
from lodecat.session import run_folder
from lodecat.sources import landed, sinks, vocabulary as v
from workload.derived import given, records, table
from workload.registry import query
from workload.scalars import LIBRARY
from workload.sqltext import case_, squash_

c = F.col
lit = F.lit


def doc(df, body, seq):
    return df.select(body.alias("body"), seq.cast("string").alias("seq"))


def geo_documents(spark, sf):
    """One summary document per row; every tenth series comes twice."""
    df = table(spark, sf, "datasets").withColumn("copy", F.explode(F.when(
        c("doc_id") % 10 == 0, F.array(lit(0), lit(1))).otherwise(F.array(lit(0)))))
    item = F.to_json(F.struct(
        F.when(c("doc_id") % 9 == 4, F.concat(lit("GSM"), c("doc_id").cast("string")))
        .otherwise(c("gse_id")).alias("accession"),
        F.concat("title", F.when(c("copy") == 1, " again").otherwise("")).alias("title"),
        c("abstract").alias("summary"), c("organism").alias("taxon"),
        c("sample_count").cast("string").alias("n_samples"), lit("GSE").alias("gdstype"),
        F.array("pubmed_id").alias("pubmedids"), c("publication_date").alias("pdat"),
        F.when(c("doc_id") % 3 == 0, "MTX, Series_Matrix").otherwise("TXT").alias("suppfile")))
    body = F.concat(lit('{"result": {"uids": ["'), c("doc_id").cast("string"), lit('"], "'),
                    c("doc_id").cast("string"), lit('": '), item, lit("}}"))
    return doc(df, body, c("copy"))


@query("s1_geo_summaries", "SELECT gse_id, title, length(abstract) AS n_abstract, organism, sample_count, "
       "pubmed_id, publication_date, doc_id % 3 = 0 AS series_matrix_available FROM datasets WHERE doc_id % 9 "
       "<> 4", "datasets")
def s1(spark, sf):
    return geo_fields(landed.parse_geo_summaries(geo_documents(spark, sf)))


def geo_fields(df):
    return df.select(
        "gse_id", "title", F.length("abstract").alias("n_abstract"), "organism", "sample_count", "pubmed_id",
        "publication_date", "series_matrix_available")


def xml_packages(spark, sf):
    df = table(spark, sf, "sra_packages")
    tag = lambda name, value: F.concat(lit(f"<{name}>"), value, lit(f"</{name}>"))
    attr = lambda name, value: F.concat(lit(f' {name}="'), value, lit('"'))
    body = F.concat(
        lit("<EXPERIMENT_PACKAGE><EXPERIMENT"), attr("accession", c("srx_id")),
        lit("><DESIGN><LIBRARY_DESCRIPTOR>"), tag("LIBRARY_STRATEGY", c("library_strategy")),
        tag("LIBRARY_SOURCE", c("library_source")), tag("LIBRARY_SELECTION", lit("cDNA")),
        lit("</LIBRARY_DESCRIPTOR></DESIGN><PLATFORM><VENDOR>"),
        tag("INSTRUMENT_MODEL", c("platform")), lit("</VENDOR></PLATFORM></EXPERIMENT><STUDY"),
        attr("accession", c("srp_id")), attr("alias", F.concat(lit("from "), c("gse_id"))),
        lit('><IDENTIFIERS><EXTERNAL_ID namespace="BioProject">'), c("bioproject_id"),
        lit('</EXTERNAL_ID><EXTERNAL_ID namespace="other">x</EXTERNAL_ID></IDENTIFIERS><DESCRIPTOR>'),
        tag("STUDY_TITLE", c("title")), lit("</DESCRIPTOR></STUDY><SAMPLE><SAMPLE_NAME>"),
        tag("SCIENTIFIC_NAME", c("organism")), lit("</SAMPLE_NAME></SAMPLE><RUN_SET>"),
        F.array_join(F.transform(F.sequence(lit(1), c("run_count")), lambda i: F.concat(
            lit('<RUN accession="'), c("srr_id"), lit("_"), i.cast("string"), lit('"/>'))), ""),
        lit("</RUN_SET></EXPERIMENT_PACKAGE>"))
    return doc(df, body, c("pos"))


@query("s2_sra_packages", "SELECT srx_id AS srx_ids, srp_id, gse_id AS gse_ids, title, organism, library_strategy, "
       "library_source, platform, bioproject_id AS bioproject_ids, run_count, greatest(1, run_count) AS sample_count "
       "FROM sra_packages", "sra_packages")
def s2(spark, sf):
    return package_fields(landed.parse_sra_packages(xml_packages(spark, sf)))


def package_fields(df):
    return df.select(
        F.array_join("srx_ids", "|").alias("srx_ids"), "srp_id", F.array_join("gse_ids", "|").alias("gse_ids"),
        "title", "organism", "library_strategy", "library_source", "platform",
        F.array_join("bioproject_ids", "|").alias("bioproject_ids"), "run_count", "sample_count")


_P10 = squash_("concat_ws(' ', nullif(title, ''), nullif(library_strategy, ''), nullif(library_source, ''), 'cDNA', "
               "nullif(platform, ''))")


@query("p10_classify_packages", f"SELECT srx_id, {LIBRARY} FROM (SELECT srx_id, x, "
       f"{case_('x', terms.LIB_PREP, chr(39) + 'unknown' + chr(39))} AS prep FROM (SELECT srx_id, {_P10} AS x FROM "
       "sra_packages))", "sra_packages")
def p10(spark, sf):
    df = table(spark, sf, "sra_packages").withColumn("library_selection", lit("cDNA"))
    return landed.classify_packages(df).select(
        "srx_id", "is_illumina", "is_single_cell", "lib_prep", "tech_10x", "cell_prep", "granularity")


@query("s3_pubmed_summaries", "SELECT pmid, title, journal, CASE WHEN pos % 2 = 0 THEN title ELSE abstract END AS abstract, "
       "'Ann|Bo' AS authors, CASE WHEN pos % 3 = 0 THEN concat('GSE', 100000 + pos) ELSE '' END AS gse_ids FROM papers",
       "papers")
def s3(spark, sf):
    return paper_fields(landed.parse_pubmed_summaries(paper_documents(spark, sf)))


def paper_documents(spark, sf):
    """Every other summary lands its abstract, whatever that holds; the rest have no such field."""
    df = table(spark, sf, "papers")
    item = [c("title"), c("journal").alias("fulljournalname"), lit("2021").alias("pubdate"),
            F.array(F.struct(lit("Ann").alias("name")), F.struct(lit("Bo").alias("name"))).alias("authors")]
    item = F.when(c("pos") % 2 == 0, F.to_json(F.struct(*item))).otherwise(
        F.to_json(F.struct(*item, "abstract"), {"ignoreNullFields": "false"}))
    body = F.concat(lit('{"result": {"uids": [], "'), c("pmid"), lit('": '), item, lit("}}"))
    return doc(df, body, c("pmid"))


def paper_fields(out):
    return out.select("pmid", "title", "journal", "abstract", F.array_join("authors", "|").alias("authors"),
                      F.array_join("gse_ids", "|").alias("gse_ids"))


def page(df, body):
    return df.select("doc_id", body.alias("body"))


@query("s4_record_pages", "SELECT doc_id, trim(title) AS title, organism, trim('Public on ' || publication_date) AS status, "
       "platform AS platforms, nullif(sample_count, -1) AS sample_count FROM datasets", "datasets")
def s4(spark, sf):
    row = lambda k, x: F.concat(lit(f"<tr class='r'><td> {k} </td>\n<td><b>"), x, lit("</b></td></tr>"))
    body = F.concat(
        lit("<html><table>"), row("Status", F.concat(lit("Public on "), c("publication_date"))),
        row("Title", c("title")), row("Organism", c("organism")), row("Platforms", c("platform")),
        lit("<tr><td>Samples (all)</td><td>"), c("sample_count").cast("string"), lit(" more</td></tr></table></html>"))
    return landed.parse_record_pages(page(table(spark, sf, "datasets"), body)).select(
        "doc_id", "title", "organism", "status", "platforms", "sample_count")


@query("s5_supplementary_listing", "SELECT doc_id, concat_ws('|', nullif(file_one, ''), nullif(file_two, '')) AS names, "
       "concat_ws('|', CASE WHEN file_one <> '' THEN n_chars || ' Kb' END, CASE WHEN file_two <> '' THEN '1.5 Mb' END) "
       "AS sizes FROM datasets", "datasets")
def s5(spark, sf):
    row = lambda n, s: F.concat(
        lit("<tr><td><a>"), n, lit("</a></td><td>"), s, lit("</td><td><a href='x'>(ftp)</a></td><td>TXT</td></tr>\n"))
    body = F.concat(
        lit("<table><thead><tr><th>File</th></tr></thead><tbody>"),
        row(c("file_one"), F.concat(c("n_chars").cast("string"), lit(" Kb"))), row(c("file_two"), lit("1.5 Mb")),
        row(lit("/geo/link"), lit("0")), lit("<tr><td>short</td></tr></tbody></table>"))
    return landed.parse_supplementary_listing(page(table(spark, sf, "datasets"), body)).select(
        "doc_id", F.array_join(F.transform("files", lambda f: f["name"]), "|").alias("names"),
        F.array_join(F.transform("files", lambda f: f["size"]), "|").alias("sizes"))


@query("s6_sample_and_project_pages", "SELECT doc_id, trim(title) AS title, organism, bioproject_id AS bioproject, "
       "'sex=female|tissue=' || organ AS attributes, platform AS project_title, 'sub' AS subtitle, "
       "CAST(doc_id AS VARCHAR) AS abstract FROM datasets", "datasets")
def s6(spark, sf):
    df = table(spark, sf, "datasets")
    sample = F.concat(
        lit('<h2 class="title">'), c("title"), lit("</h2><dl><dt>Organism</dt><dd>"), c("organism"),
        lit(" <i>cellular organisms; more</i></dd><dt>BioProject</dt><dd><a>"), c("bioproject_id"),
        lit("</a></dd><dt>Attributes</dt><dd><table><tr><th>sex</th><td>male</td></tr><tr><th>tissue</th><td>"),
        c("organ"), lit("</td></tr><tr><th>sex</th><td>female</td></tr></table></dd></dl>"))
    project = F.concat(lit('<div class="Title"><h2>'), c("platform"), lit("</h2><h3>sub</h3></div>"))
    paper = F.concat(lit('<h1 class="heading-title"> T </h1><div class="abstract-content selected"><p> '),
                     c("doc_id").cast("string"), lit(" </p></div>"))
    a = landed.parse_biosample_pages(page(df, sample))
    b = landed.parse_bioproject_pages(page(df, project)).select(
        "doc_id", c("title").alias("project_title"), "subtitle")
    p = landed.parse_abstract_pages(page(df, paper)).select("doc_id", "abstract")
    flat = F.array_join(F.array_sort(F.transform(
        F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return a.withColumn("attributes", flat).join(b, "doc_id").join(p, "doc_id")


@query("s7_samples", "SELECT gse_id, gsm_id, title, kind AS sample_type, -CAST(substr(gsm_id, 4) AS BIGINT) AS place, "
       "tissue FROM samples", "samples")
def s7(spark, sf):
    return sample_fields(landed.parse_samples(sample_documents(spark, sf)))


def sample_documents(spark, sf):
    s = table(spark, sf, "samples")
    item = F.struct(c("gsm_id").alias("accession"), "title", F.array("kind").alias("sample_type"),
                    F.concat(lit("Tissue: "), c("tissue")).alias("attributes"))
    bad = F.struct(lit("GPL1").alias("accession"), lit("no").alias("title"),
                   F.array(lit("x")).alias("sample_type"), lit("").alias("attributes"))
    body = F.to_json(F.struct("gse_id", F.array(item, bad).alias("samples")))
    return doc(s, body, c("pos"))


def sample_fields(df):
    return df.select(
        "gse_id", "gsm_id", "title", F.array_join("sample_type", "|").alias("sample_type"), "place",
        F.element_at("attributes", "tissue").alias("tissue"))


def part_documents(spark, sf):
    """One vocabulary document per part: name, brand and kinds as other names, a parent."""
    df = table(spark, sf, "parts")
    entry = F.struct(
        c("name").alias("canonical"), F.array(F.concat_ws(" ", "brand", "name")).alias("synonyms"),
        F.array(c("kind"), c("brand")).alias("search_terms"), lit("").alias("adjective"), "parent",
        F.array(c("brand")).alias("related_organs"))
    body = F.concat(lit('{"organs": '), F.to_json(F.create_map(c("name"), entry)), lit("}"))
    return doc(df, body, F.lpad(c("p_partkey").cast("string"), 12, "0"))


def part_entries(spark, sf, domain="organ"):
    return v.parse_entries(part_documents(spark, sf), domain, "organs")


@query("s8_ontology", "SELECT lower(name) AS term, name AS canonical, 'canonical' AS kind, 1::DOUBLE AS weight FROM parts UNION ALL "
       "SELECT lower(concat(brand, ' ', name)), name, 'synonym', 0.9::DOUBLE FROM parts UNION ALL SELECT lower(kind), name, "
       "'search_term', 0.7::DOUBLE FROM parts UNION ALL SELECT lower(brand), name, 'search_term', 0.7::DOUBLE FROM parts", "parts")
def s8(spark, sf):
    return v.vocab_terms(part_entries(spark, sf), matching_only=True).select("term", "canonical", "kind", "weight")


@query("s9_keyword_lists", "SELECT doc_id, coalesce(CASE doc_id % 2 WHEN 0 THEN 'a|' || lang || '|b' ELSE lang || '|c' END) AS words "
       "FROM documents")
def s9(spark, sf):
    words = v.keywords(v.parse_keyword_lists(keyword_documents(spark, sf), "disease_terms"))
    return word_lists(words).select(c("seq").cast("long").alias("doc_id"), "words")


def keyword_documents(spark, sf):
    df = given(spark, sf, "documents")
    plain = F.to_json(F.struct(F.array(c("lang"), lit("c")).alias("disease_terms")))
    nested = F.to_json(F.struct(F.struct(F.array(lit("a"), c("lang"), lit("b")).alias("terms")).alias("disease_terms")))
    return doc(df, F.when(c("doc_id") % 2 == 0, nested).otherwise(plain), c("doc_id"))


def word_lists(words):
    return words.groupBy("seq").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"]), "|").alias("words"))


def abbreviation_documents(spark, sf):
    df = table(spark, sf, "parts")
    entry = F.struct(c("name").alias("full_name"), F.array(c("kind"), F.lower("kind")).alias("search_terms"),
                     F.array(c("brand")).alias("related_diseases"), F.array(c("kind")).alias("related_organs"))
    key = F.concat(lit("p"), c("p_partkey").cast("string"))
    return doc(df, F.concat(lit('{"abbreviations": '), F.to_json(F.create_map(key, entry)), lit("}")), c("p_partkey"))


@query("s10_abbreviations", "SELECT 'P' || p_partkey AS key, name AS full_name, kind || '|' || lower(kind) AS search_terms, brand AS "
       "related_diseases FROM parts", "parts")
def s10(spark, sf):
    return abbreviation_fields(v.parse_abbreviations(abbreviation_documents(spark, sf)))


def abbreviation_fields(df):
    return df.select(
        "key", "full_name", F.array_join("search_terms", "|").alias("search_terms"),
        F.array_join("related_diseases", "|").alias("related_diseases"))


@query("s11_get_dataset", "SELECT a.accession, d.gse_id, d.title FROM (SELECT DISTINCT accession FROM accessions) a JOIN datasets d ON "
       "d.gse_id = a.accession OR d.sra_id = a.accession", "accessions datasets")
def s11(spark, sf):
    """Batch form: exact key first, the rest by study id."""
    return get_datasets(table(spark, sf, "accessions"), records(spark, sf)).select("accession", "gse_id", "title")


@query("s12_study_pages", "SELECT doc_id, 'Study' || source || 'inner' || CAST(doc_id AS VARCHAR) AS text FROM documents")
def s12(spark, sf):
    body = F.concat(lit('<div id="top">no</div><div id="maincontent"><h1> Study </h1><div> '), c("source"),
                    lit(" <div>inner</div></div>"), c("doc_id").cast("string"), lit("</div><div>after</div>"))
    return landed.parse_study_pages(page(given(spark, sf, "documents"), body)).select("doc_id", "text")


@query("s12_page_titles", "SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', "
       "1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages")
def s12b(spark, sf):
    """Headings of the given raw web pages."""
    body = F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)
    return given(spark, sf, "pages").select("page_id", landed._plain(body).alias("title"))


@query("s13_stored_rows", "SELECT gse_id, title, 'other' AS data_type, CASE WHEN doc_id % 2 = 0 THEN sample_count ELSE 0 END AS "
       "sample_count, false AS single_cell, 0 AS n_keywords, 'unknown' AS granularity FROM datasets", "datasets")
def s13(spark, sf):
    return stored_fields(landed.parse_views(stored_documents(spark, sf), DATASET_VIEW))


def stored_documents(spark, sf):
    df = table(spark, sf, "datasets")
    body = F.to_json(F.struct("gse_id", "title", F.when(c("doc_id") % 2 == 0, c("sample_count")).alias("sample_count")))
    return doc(df, body, c("doc_id"))


def stored_fields(df):
    return df.select(
        "gse_id", "title", "data_type", "sample_count", "single_cell", F.size("keywords").alias("n_keywords"), "granularity")


# --- sinks ---------------------------------------------------------------------------------

EXPORT = ["gse_id", "title", "sra_ids", "sample_count", "journal", "note"]


@query("k1_write_json", "SELECT gse_id, title, sra_id AS sra_ids, sample_count, '' AS journal, '' AS note FROM datasets", "datasets")
def k1(spark, sf):
    path = run_folder(spark, "json")
    sinks.write_json(records(spark, sf), path, EXPORT)
    back = spark.read.schema("gse_id string, title string, sra_ids array<string>, sample_count bigint, journal string, "
                             "note string").json(path)
    return back.withColumn("sra_ids", F.array_join("sra_ids", ";"))


@query("k2_write_delimited", "SELECT gse_id, title, sra_id AS sra_ids, sample_count FROM datasets", "datasets")
def k2(spark, sf):
    path = run_folder(spark, "tsv")
    sinks.write_delimited(records(spark, sf), path, EXPORT[:4], "tsv")
    return spark.read.csv(path, sep="\t", header=True, escape='"',
                          schema="gse_id string, title string, sra_ids string, sample_count bigint").fillna("")


@query("k3_write_plain", "SELECT sra_id AS value, count(*) AS n FROM datasets WHERE sra_id <> '' GROUP BY 1", "datasets")
def k3(spark, sf):
    path = run_folder(spark, "txt")
    sinks.write_plain(records(spark, sf), path, ["sra_ids", "title"])
    return spark.read.text(path).groupBy("value").agg(F.count(lit(1)).alias("n"))


_URL = "'https://ftp.ncbi.nlm.nih.gov/geo/series/' || left(gse_id, length(gse_id) - 3) || 'nnn/' || gse_id || '/suppl/'"


@query("k4_download_manifest", "SELECT gse_id, 'controlled' AS kind, sra_id AS target, '# ' || sra_id || ' - requires dbGaP authorization' AS "
       "command FROM datasets WHERE access_type = 'controlled' AND sra_id <> '' UNION ALL SELECT gse_id, CASE WHEN sra_id = '' THEN 'none' "
       "ELSE 'study' END, CASE WHEN sra_id = '' THEN gse_id ELSE sra_id END, CASE WHEN sra_id = '' THEN '# ' || gse_id || ': No SRA IDs found' "
       "ELSE 'prefetch ' || sra_id || ' && fasterq-dump --split-files --outdir ' || sra_id || ' ' || sra_id END FROM datasets WHERE access_type "
       "<> 'controlled' UNION ALL SELECT gse_id, 'supplementary', gse_id, 'wget -r -np -nH --cut-dirs=4 ' || " + _URL
       + " FROM datasets WHERE access_type <> 'controlled'", "datasets")
def k4(spark, sf):
    return sinks.download_manifest(records(spark, sf))


@query("k5_search_csv", "SELECT row_number() OVER (ORDER BY sample_count DESC, gse_id) AS rank, gse_id, title, printf('%.4f', sample_count / "
       "1000.0) AS relevance_score, printf('%.4f', sample_count / 1000.0) AS total_score, sra_id AS sra_ids, '' AS llm_one_sentence_summary FROM datasets",
       "datasets")
def k5(spark, sf):
    """All rows ranked over one order, written and read back."""
    from lodecat.operators.order import global_positions
    path = run_folder(spark, "csv")
    df = global_positions(records(spark, sf), [c("sample_count").desc(), c("gse_id")])
    sinks.write_search_csv(df.withColumns({"relevance_score": c("sample_count") / 1000.0,
                                           "total_score": c("sample_count") / 1000.0}), path)
    back = spark.read.csv(path, header=True, escape='"').fillna("")
    return back.select(c("rank").cast("long").alias("rank"), "gse_id", "title", "relevance_score", "total_score", "sra_ids",
                       "llm_one_sentence_summary")


@query("k6_json_payload", "SELECT gse_id, '{\"gse_id\":\"' || gse_id || '\",\"title\":\"' || title || '\",\"sample_count\":' || sample_count || "
       "',\"sra_ids\":[' || CASE WHEN sra_id = '' THEN '' ELSE '\"' || sra_id || '\"' END || ']}' AS payload FROM datasets", "datasets")
def k6(spark, sf):
    df = records(spark, sf)
    return df.select("gse_id", sinks.json_view(df, ["gse_id", "title", "sample_count", "sra_ids"]).alias("payload"))


@query("k8_export", "SELECT gse_id, title FROM datasets WHERE sample_count >= 300 AND access_type = 'public' AND organism = 'Homo sapiens' "
       "ORDER BY last_updated DESC, gse_id", "datasets")
def k8(spark, sf):
    path = run_folder(spark, "export")
    sinks.export(records(spark, sf), path, "csv", ["gse_id", "title"], access_type="public", organism="sapiens",
                 min_samples=300)
    return spark.read.csv(path, header=True, escape='"')


@query("p4_json_lists", "SELECT gse_id, CASE WHEN doc_id % 3 = 1 THEN '' ELSE source || ',' || source END AS items FROM datasets", "datasets")
def p4(spark, sf):
    df = table(spark, sf, "datasets")
    text = F.when(c("doc_id") % 3 == 1, "not json").otherwise(F.to_json(F.array("source", "source")))
    return df.select("gse_id", F.array_join(landed.json_list(text), ",").alias("items"))
