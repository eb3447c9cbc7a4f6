"""Sources S1-S3, S7-S10 and S13 through their readers: the documents are landed as files, one per
line, and read back by path.  The checking SQL is that of the parsed form."""

from pyspark.sql import functions as F

from lodecat.schemas import DATASET_VIEW
from lodecat.session import run_folder
from lodecat.sources import landed, vocabulary as v
from workload import sources as s
from workload.registry import ORACLES, QUERIES, query

c, lit = F.col, F.lit


def files(spark, documents):
    """Landed as one compressed file per task: markup shrinks to a small part of its length."""
    folder = run_folder(spark, "landed")
    documents.select("body").write.option("compression", "gzip").text(folder)
    return folder


def read(name, of):
    """Registers a query whose SQL is that of the query ``of``."""
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, ORACLES[of]
        return fn
    return add


@read("s1_geo_files", "s1_geo_summaries")
def s1(spark, sf):
    return s.geo_fields(landed.read_geo_summaries(spark, files(spark, s.geo_documents(spark, sf)), lines=True))


@read("s2_sra_files", "s2_sra_packages")
def s2(spark, sf):
    return s.package_fields(landed.read_sra_packages(spark, files(spark, s.xml_packages(spark, sf)), lines=True))


@read("s3_pubmed_files", "s3_pubmed_summaries")
def s3(spark, sf):
    return s.paper_fields(landed.read_pubmed_summaries(spark, files(spark, s.paper_documents(spark, sf)), lines=True))


@read("s7_sample_files", "s7_samples")
def s7(spark, sf):
    return s.sample_fields(landed.read_samples(spark, files(spark, s.sample_documents(spark, sf)), lines=True))


@read("s8_ontology_files", "s8_ontology")
def s8(spark, sf):
    entries = v.read_ontology(spark, files(spark, s.part_documents(spark, sf)), "organ", "organs", lines=True)
    return v.vocab_terms(entries, matching_only=True).select("term", "canonical", "kind", "weight")


@query("s9_keyword_files", "SELECT CASE doc_id % 2 WHEN 0 THEN 'a|' || lang || '|b' ELSE lang || '|c' END AS words, count(*) AS n FROM documents GROUP BY 1")
def s9(spark, sf):
    words = v.read_keyword_lists(spark, files(spark, s.keyword_documents(spark, sf)), "disease_terms", lines=True)
    return s.word_lists(words).groupBy("words").agg(F.count(lit(1)).alias("n"))


@query("s9_keyword_override", "SELECT canonical, count(*) AS n FROM (SELECT upper(left(w, 1)) || lower(substr(w, 2)) AS canonical FROM (SELECT DISTINCT lang AS w FROM documents WHERE lang <> '') JOIN documents ON contains(lower(text), w)) GROUP BY 1")
def s9_override(spark, sf):
    """A list given at run time replaces the landed one; its words are then found in texts."""
    from lodecat.functions.text import all_classes
    from workload.derived import given
    docs = given(spark, sf, "documents")
    landed_list = v.read_keyword_lists(spark, files(spark, s.keyword_documents(spark, sf)), "disease_terms", lines=True).select("word")
    named = sorted(r[0] for r in docs.filter("lang <> ''").select("lang").distinct().collect())  # the user's own few words
    given_list = v.keyword_vocab(spark, named).select("term", "canonical")
    used = v.keywords(landed_list, given_list)
    classes = [(r["canonical"], [r["term"]]) for r in used.collect()]
    hits = docs.select(F.explode(all_classes(F.lower(F.coalesce("text", lit(""))), classes)).alias("canonical"))
    return hits.groupBy("canonical").agg(F.count(lit(1)).alias("n"))


@read("s10_abbreviation_files", "s10_abbreviations")
def s10(spark, sf):
    return s.abbreviation_fields(v.read_abbreviations(spark, files(spark, s.abbreviation_documents(spark, sf)), lines=True))


@read("s13_stored_files", "s13_stored_rows")
def s13(spark, sf):
    return s.stored_fields(landed.read_views(spark, files(spark, s.stored_documents(spark, sf)), DATASET_VIEW))
