"""Catalogue tables derived from the given ones, in expressions both engines read alike.

Whole tables and whole texts: every given row gives a row.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecat.session import spread

AS_OF = date(2025, 6, 30)
NOW = datetime(2024, 2, 1)
QUERY = "gout single cell"

_TITLE = """CASE doc_id % 8
 WHEN 0 THEN 'Single-cell RNA-seq of PBMC in gout patients'
 WHEN 1 THEN 'Bulk RNA-seq of liver fibrosis in mice'
 WHEN 2 THEN 'ATAC-seq of mouse kidney after CRISPR knockout'
 WHEN 3 THEN 'Spatial transcriptomics (Visium) of breast tumor'
 WHEN 4 THEN 'scRNA-seq of synovial tissue in hyperuricemia'
 WHEN 5 THEN 'Microarray of lung treated with inhibitor'
 WHEN 6 THEN 'ChIP-seq of heart after LPS stimulation'
 ELSE 'Unlabelled study' END"""
_SENTENCE = """CASE doc_id % 7
 WHEN 0 THEN 'We profiled 12,500 cells from 6 patients vs 6 healthy controls.'
 WHEN 1 THEN 'Urate crystals and uric acid drive gouty arthritis, see GSE12345 and SRP123456.'
 WHEN 2 THEN 'About 2 million reads of 10x Chromium nuclei (GSE12345, GSE99887).'
 WHEN 3 THEN 'Hepatocellular carcinoma and renal samples were treated with drug; 8 samples.'
 WHEN 4 THEN 'Controls: 850 cells; runs SRR1234567 and SRR7654321.'
 WHEN 5 THEN 'Smart-seq2 of pancreatic islets in type 2 diabetes, 4 treated vs 5 control.'
 ELSE '' END"""
_DESIGN = """CASE doc_id % 5
 WHEN 0 THEN 'control: 3 biological replicates' WHEN 1 THEN '3 replicates of treated'
 WHEN 2 THEN 'treated vs untreated' WHEN 3 THEN 'patient and control' ELSE '' END"""
_GSE = "concat('GSE', CAST(100000 + doc_id AS STRING))"

TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "datasets": ("documents", {
        "doc_id": "doc_id",
        "gse_id": _GSE,
        "title": f"concat({_TITLE}, ' ', source, ' no ', CAST(doc_id AS STRING))",
        "abstract": f"concat(text, ' ', {_SENTENCE})",
        "overall_design": _DESIGN,
        "organism": "CASE WHEN lang = 'en' THEN 'Homo sapiens' WHEN lang = 'fr' THEN "
                    "'Mus musculus' WHEN lang = 'de' THEN 'Rattus norvegicus' ELSE '' END",
        "disease": "CASE WHEN doc_id % 11 = 0 THEN 'gout' ELSE '' END",
        "organ": "CASE WHEN doc_id % 13 = 0 THEN 'kidney' ELSE '' END",
        "omics_type": "CASE doc_id % 6 WHEN 0 THEN 'scRNA-seq' WHEN 1 THEN 'RNA-seq' "
                      "WHEN 2 THEN 'scATAC' ELSE '' END",
        "omics_granularity": "CASE doc_id % 9 WHEN 0 THEN 'bulk' WHEN 1 THEN 'single_cell' "
                             "ELSE 'unknown' END",
        "sample_count": "CAST(n_chars % 1200 AS INT)",
        "platform": "CASE doc_id % 4 WHEN 0 THEN '10x Chromium' WHEN 1 THEN "
                    "'Illumina NovaSeq 6000' WHEN 2 THEN 'Affymetrix' ELSE '' END",
        "publication_date": "CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat(CAST(2010 + doc_id % "
                            "15 AS STRING), '/', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), "
                            "'/15') END",
        "availability_status": "CASE doc_id % 4 WHEN 0 THEN 'available' WHEN 1 THEN "
                               "'unavailable' WHEN 2 THEN 'restricted' ELSE 'unverified' END",
        "access_type": "CASE WHEN doc_id % 6 = 0 THEN 'controlled' ELSE 'public' END",
        "sra_id": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('SRP', "
                  "CAST(500000 + doc_id AS STRING)) END",
        "pubmed_id": "CASE WHEN doc_id % 2 = 0 THEN CAST(30000000 + doc_id AS STRING) ELSE '' END",
        "bioproject_id": "CASE WHEN doc_id % 5 = 0 THEN concat('PRJNA', CAST(doc_id AS STRING)) "
                         "ELSE '' END",
        "keyword": "CASE WHEN doc_id % 4 = 1 THEN 'uric acid' ELSE '' END",
        "file_one": "CASE doc_id % 5 WHEN 0 THEN 'filtered_gene_bc_matrix.h5' WHEN 1 THEN "
                    "'sample_counts.tsv.gz' WHEN 2 THEN 'reads.fastq.gz' WHEN 3 THEN "
                    "'array.CEL.gz' ELSE '' END",
        "file_two": "CASE doc_id % 3 WHEN 0 THEN 'barcodes.tsv.gz' WHEN 1 THEN 'study_RAW.tar' "
                    "ELSE '' END",
        "n_chars": "n_chars",
        "source": "source",
        "last_updated": "concat(CAST(2018 + doc_id % 7 AS STRING), '-', "
                        "lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-01')",
    }),
    "names": ("documents", {
        "doc_id": "doc_id",
        "species": "CASE doc_id % 5 WHEN 0 THEN ' Human ' WHEN 1 THEN 'M.musculus' WHEN 2 THEN "
                   "'Danio rerio (zebrafish)' WHEN 3 THEN 'Bos taurus' ELSE source END",
        "condition_text": "CASE doc_id % 5 WHEN 0 THEN 'Type 2  Diabetes in adults' WHEN 1 THEN "
                          "'HCC' WHEN 2 THEN 'covid-19 cohort' WHEN 3 THEN 'rare state' ELSE '' "
                          "END",
        "organ_text": "CASE doc_id % 4 WHEN 0 THEN ' Renal ' WHEN 1 THEN 'PBMCs' WHEN 2 THEN "
                      "'Toe' ELSE '' END",
        "platform_text": "CASE doc_id % 5 WHEN 0 THEN 'Illumina HiSeq 2500' WHEN 1 THEN "
                         "'10x Genomics Chromium v3' WHEN 2 THEN 'agilent' WHEN 3 THEN 'own "
                         "machine' ELSE 'the NovaSeq line' END",
        "platform_code": "concat('GPL', CAST(doc_id % 37 AS STRING))",
    }),
    "platforms": ("supplier", {
        "code": "concat('GPL', CAST(s_suppkey AS STRING))",
        "name": "s_name",
    }),
    "changes": ("events", {
        "event_id": "event_id",
        "old_status": "CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'irrelevant' WHEN 2 "
                      "THEN 'deleted' ELSE 'pending' END",
        "new_status": "CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'irrelevant' WHEN 2 "
                      "THEN 'deleted' ELSE 'pending' END",
    }),
    "topic_datasets": ("events", {
        "edge_id": "event_id",
        "topic_id": "concat('T', CAST(user_id % 20 AS STRING))",
        "gse_id": "concat('GSE', CAST(100000 + (event_id * 7) % 1100 AS STRING))",
        "match_keyword": "event_type",
        "match_source": "CASE event_id % 3 WHEN 0 THEN 'geo' WHEN 1 THEN 'sra' ELSE 'pubmed' END",
        "match_score": "round(value / 100, 4)",
        "review_status": "CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'irrelevant' "
                         "WHEN 2 THEN 'deleted' ELSE 'pending' END",
        "added_at": "ts",
    }),
    "review_log": ("events", {
        "log_id": "event_id",
        "topic_id": "concat('T', CAST(user_id % 20 AS STRING))",
        "gse_id": "concat('GSE', CAST(100000 + event_id % 50 AS STRING))",
        "action": "CASE event_id % 6 WHEN 0 THEN 'undo' WHEN 3 THEN 'undo' WHEN 1 THEN "
                  "'approve' WHEN 2 THEN 'delete' ELSE 'mark' END",
        "new_status": "CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'irrelevant' "
                      "WHEN 2 THEN 'deleted' ELSE 'pending' END",
        "acted_at": "ts",
    }),
    "sra_packages": ("lineitem", {
        "srp_id": "concat('SRP', CAST(l_orderkey AS STRING))",
        "srx_id": "concat('SRX', CAST(l_orderkey * 10 + l_linenumber AS STRING))",
        "srr_id": "concat('SRR', CAST(l_orderkey * 100 + l_linenumber AS STRING))",
        "gse_id": "CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('GSE', "
                  "CAST(100000 + l_orderkey % 1100 AS STRING)) END",
        "bioproject_id": "concat('PRJNA', CAST(l_suppkey AS STRING))",
        "title": "CASE l_orderkey % 4 WHEN 0 THEN 'Gout single cell atlas' WHEN 1 THEN "
                 "'Bulk RNA of liver' WHEN 2 THEN 'Cell atlas of kidney' ELSE 'Other study' END",
        "organism": "CASE l_orderkey % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'Mus musculus (mouse)' "
                    "ELSE 'R.norvegicus' END",
        "platform": "CASE l_suppkey % 3 WHEN 0 THEN 'Illumina HiSeq 2500' WHEN 1 THEN "
                    "'10x Genomics Chromium' ELSE 'PacBio RS' END",
        "library_strategy": "CASE l_partkey % 4 WHEN 0 THEN 'RNA-Seq' WHEN 1 THEN 'ATAC-Seq' "
                            "WHEN 2 THEN 'OTHER' ELSE '' END",
        "library_source": "CASE l_partkey % 3 WHEN 0 THEN 'TRANSCRIPTOMIC SINGLE CELL' WHEN 1 "
                          "THEN 'GENOMIC' ELSE '' END",
        "sample_count": "1",
        "run_count": "CAST(l_linenumber AS INT)",
        "pos": "l_orderkey * 10 + l_linenumber",
    }),
    "samples": ("lineitem", {
        "gse_id": "concat('GSE', CAST(100000 + l_orderkey % 1000 AS STRING))",
        "gsm_id": "concat('GSM', CAST(l_orderkey * 10 + l_linenumber AS STRING))",
        "title": "CASE WHEN l_orderkey % 5 = 0 THEN concat(CASE l_linenumber % 2 WHEN 0 THEN "
                 "'Con' ELSE 'GR' END, CAST(l_linenumber AS STRING)) WHEN l_orderkey % 5 = 1 THEN "
                 "concat(CASE l_linenumber % 3 WHEN 0 THEN 'control_' ELSE 'treated_' END, "
                 "CAST(l_linenumber AS STRING)) WHEN l_orderkey % 5 = 2 THEN concat('x ', CASE "
                 "l_linenumber % 2 WHEN 0 THEN 'day' ELSE 'week' END, CAST(l_linenumber AS STRING)) "
                 "WHEN l_orderkey % 5 = 3 THEN concat(CASE l_linenumber % 2 WHEN 0 THEN '24h' "
                 "ELSE 'before' END) ELSE concat('sample', CAST(l_linenumber AS STRING)) END",
        "pos": "l_orderkey * 10 + l_linenumber",
        "kind": "CASE l_linenumber % 3 WHEN 0 THEN 'control group' WHEN 1 THEN 'case 1' "
                "ELSE 'case 2' END",
        "tissue": "CASE WHEN l_orderkey % 7 = 0 THEN 'PBMC' ELSE '' END",
    }),
    "papers": ("documents", {
        "pmid": "CAST(30000000 + doc_id AS STRING)",
        "title": f"concat({_TITLE}, CASE WHEN doc_id % 3 = 0 THEN concat(' ', {_GSE}) ELSE '' "
                 "END)",
        "abstract": "text",
        "journal": "concat('Journal of ', source)",
        "pos": "doc_id",
    }),
    "paper_links": ("events", {
        "pmid": "CAST(30000000 + event_id % 997 AS STRING)",
        "gse_id": "CASE WHEN event_id % 10 = 0 THEN '100272217' ELSE concat('GSE', "
                  "CAST(100000 + (event_id * 3) % 1200 AS STRING)) END",
    }),
    "crosswalk": ("events", {
        "src_id": "concat(CASE event_id % 5 WHEN 0 THEN 'GSE' WHEN 1 THEN 'SRP' WHEN 2 THEN "
                  "'SRX' WHEN 3 THEN 'PRJNA' ELSE 'SRR' END, CAST(100000 + user_id % 40 AS STRING))",
        "dst_type": "CASE event_id % 7 WHEN 0 THEN 'sra' WHEN 1 THEN 'gds' WHEN 2 THEN "
                    "'bioproject' WHEN 3 THEN 'biosample' WHEN 4 THEN 'pubmed' ELSE 'sra' END",
        "dst_id": "CAST(event_id AS STRING)",
        "pos": "event_id",
    }),
    "accessions": ("orders", {
        "accession": "concat(CASE o_orderkey % 9 WHEN 0 THEN 'GSE' WHEN 1 THEN 'SRP' WHEN 2 "
                     "THEN 'srx' WHEN 3 THEN 'PRJNA' WHEN 4 THEN 'SRR' WHEN 5 THEN 'GSM' WHEN 6 "
                     "THEN 'SAMN' WHEN 7 THEN 'PRJDB' ELSE 'ABC' END, "
                     "CAST(100000 + o_custkey % 60 AS STRING))",
    }),
    "parts": ("part", {
        "name": "concat('part ', CAST(p_partkey AS STRING))",
        "parent": "CASE WHEN p_partkey < 7 THEN '' ELSE concat('part ', "
                  "CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS STRING)) END",
        "p_partkey": "p_partkey",
        "brand": "p_brand",
        "kind": "p_type",
    }),
    "cache_index": ("orders", {
        "key": "concat('k', CAST(o_orderkey AS STRING))",
        "cached_at": "o_orderdate",
        "bytes": "CAST(floor(o_totalprice) AS BIGINT)",
    }),
    "answers": ("documents", {
        "gse_id": _GSE,
        "score_text": "CASE doc_id % 5 WHEN 0 THEN '0.85' WHEN 1 THEN concat('Score: ', "
                      "CAST(doc_id % 100 AS STRING), ' of 100') WHEN 2 THEN '' WHEN 3 THEN "
                      "'none' ELSE '1.0' END",
        "disease": "CASE WHEN doc_id % 2 = 0 THEN 'Inferred disease' ELSE '' END",
        "organ": "CASE WHEN doc_id % 3 = 0 THEN 'Inferred organ' ELSE '' END",
        "omics_type": "CASE WHEN doc_id % 5 = 0 THEN 'Inferred assay' ELSE '' END",
        "granularity": "'bulk'",
    }),
    "study_docs": ("documents", {
        "srp_id": "concat('SRP', CAST(500000 + doc_id AS STRING))",
        "study_status": "CASE doc_id % 8 WHEN 1 THEN 'withdrawn' WHEN 2 THEN 'Suppressed' "
                        "ELSE 'public' END",
        "access_text": "CASE doc_id % 9 WHEN 4 THEN 'held in dbGaP phs000001' ELSE lang END",
        "consent": "CASE doc_id % 10 WHEN 5 THEN 'Controlled use' ELSE '' END",
        "run_count": "CAST(n_chars % 4 AS INT)",
    }),
}


def cte(*names: str) -> str:
    """WITH clause that defines the named tables for the checking SQL."""
    if not names:
        return ""
    parts = []
    for name in names:
        source, columns = TABLES[name]
        body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {body} FROM {source})")
    return "WITH " + ",\n".join(parts) + "\n"


def given(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; the large ones come as one piece each and are spread over the cores."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "lineitem", "part") else df


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return given(spark, sf, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def one_or_none(c: str) -> F.Column:
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array(c))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """datasets with the list columns of a stored record."""
    df = table(spark, sf, "datasets")
    file = lambda c, kind: F.struct(
        F.col(c).alias("name"), F.lit(kind).alias("type"),
        (F.col("n_chars") * 1000 + 7).cast("long").alias("size"))
    return df.withColumns({
        "sra_ids": one_or_none("sra_id"), "pubmed_ids": one_or_none("pubmed_id"),
        "bioproject_ids": one_or_none("bioproject_id"), "keywords": one_or_none("keyword"),
        "supplementary_files": F.filter(
            F.array(file("file_one", "TXT"), file("file_two", "TAR")), lambda f: f["name"] != ""),
        "series_matrix_available": F.lit(False), "has_gse": F.lit(True),
        "journal": F.lit(""), "ftplink": F.lit("")})
