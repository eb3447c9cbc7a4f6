"""Joins J1-J18."""

from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.operators import joins as j
from lodecat.operators.matching import resolve_alias
from lodecat.plans.topics import generate_keywords
from lodecat.sources import vocabulary as v
from workload.derived import one_or_none, records, table
from workload.registry import query
from workload.sources import abbreviation_documents, part_entries
from workload.text import knowledge

c, lit = F.col, F.lit


@query("j1_topic_view", "SELECT edge_id, gse_id, topic_id, review_status, title, organism, sample_count FROM topic_datasets JOIN datasets USING (gse_id) "
       "WHERE review_status = 'pending'", "topic_datasets datasets")
def j1(spark, sf):
    return j.topic_view(table(spark, sf, "topic_datasets"), table(spark, sf, "datasets"), review_status="pending").select(
        "edge_id", "gse_id", "topic_id", "review_status", "title", "organism", "sample_count")


@query("j2_in_topics", "SELECT gse_id, title FROM datasets WHERE gse_id IN (SELECT gse_id FROM topic_datasets WHERE topic_id IN ('T1', 'T2'))",
       "datasets topic_datasets")
def j2(spark, sf):
    edges = table(spark, sf, "topic_datasets").filter(c("topic_id").isin("T1", "T2"))
    return j.in_topics(table(spark, sf, "datasets"), edges).select("gse_id", "title")


@query("j3_answer_cache", "SELECT t.edge_id, a.score_text, a.gse_id IS NULL AS open FROM topic_datasets t LEFT JOIN (SELECT * FROM answers WHERE score_text <> '') a "
       "USING (gse_id)", "topic_datasets answers")
def j3(spark, sf):
    rows = table(spark, sf, "topic_datasets").select("edge_id", "gse_id")
    known = table(spark, sf, "answers").filter("score_text <> ''").select("gse_id", "score_text")
    hits = j.with_answers(rows.join(known, "gse_id", "left_semi"), known, ["gse_id"]).select(
        "edge_id", "score_text", lit(False).alias("open"))
    work = j.without_answers(rows, known, ["gse_id"]).select("edge_id", lit(None).cast("string").alias("score_text"),
                                                             lit(True).alias("open"))
    return hits.unionByName(work)


@query("j4_score_override", "SELECT edge_id, coalesce(o.s, match_score) AS match_score FROM topic_datasets LEFT JOIN (SELECT gse_id, doc_id / 1000.0::DOUBLE AS s "
       "FROM datasets WHERE doc_id % 2 = 0) o USING (gse_id)", "topic_datasets datasets")
def j4(spark, sf):
    other = table(spark, sf, "datasets").filter("doc_id % 2 = 0").select("gse_id", (c("doc_id") / 1000.0).alias("match_score"))
    return j.override(table(spark, sf, "topic_datasets"), other, ["gse_id"], "match_score").select("edge_id", "match_score")


@query("j5_attach_samples", "SELECT gse_id, count(gsm_id) AS n, coalesce(string_agg(gsm_id, '|' ORDER BY pos), '') AS samples FROM datasets LEFT JOIN (SELECT "
       "*, row_number() OVER (PARTITION BY gse_id ORDER BY pos, gsm_id) AS rn FROM samples) s USING (gse_id) WHERE coalesce(rn, 1) <= 50 GROUP BY gse_id",
       "datasets samples")
def j5(spark, sf):
    out = j.attach_samples(table(spark, sf, "datasets"), table(spark, sf, "samples"))
    return out.select("gse_id", F.size("samples").cast("long").alias("n"),
                      F.array_join(F.transform("samples", lambda s: s["gsm_id"]), "|").alias("samples"))


@query("j6_known_ids", "SELECT srx_id, gse_id IN (SELECT gse_id FROM datasets) AS known FROM sra_packages WHERE gse_id <> ''", "sra_packages datasets")
def j6(spark, sf):
    rows = table(spark, sf, "sra_packages").filter("gse_id <> ''").select("srx_id", "gse_id")
    authority = table(spark, sf, "datasets")
    return j.known_only(rows, authority).withColumn("known", lit(True)).unionByName(
        j.unknown_only(rows, authority).withColumn("known", lit(False))).select("srx_id", "known")


_OWN = "SELECT pmid, concat('GSE', 100000 + pos) AS gse_id FROM papers WHERE pos % 3 = 0"


def papers(spark, sf):
    df = table(spark, sf, "papers")
    return df.withColumn("gse_ids", F.when(c("pos") % 3 == 0, F.array(F.concat(lit("GSE"), (c("pos") + 100000).cast("string"))))
                         .otherwise(F.array().cast("array<string>")))


@query("j7_paper_links", f"SELECT pmid, gse_id FROM ({_OWN}) UNION SELECT pmid, gse_id FROM paper_links WHERE pmid IN (SELECT pmid FROM papers)", "papers paper_links")
def j7(spark, sf):
    return j.paper_links(papers(spark, sf), table(spark, sf, "paper_links")).select("pmid", "gse_id")


_CAPS = " ".join(f"WHEN fam = '{s}' AND target = '{t}' THEN {n}" for s, t, n in terms.CONVERSION_CAPS)
CONVERT = f""", a AS (SELECT DISTINCT accession, upper(accession) AS k FROM accessions), y AS (SELECT accession, k, CASE {' '.join(
    f"WHEN regexp_matches(k, '{p}') THEN '{n}'" for n, p in terms.ACCESSION_TYPES)} ELSE 'unknown' END AS st FROM a),
 z AS (SELECT *, CASE WHEN st IN ('PRJNA', 'PRJEB') THEN 'PRJ' ELSE st END AS fam FROM y, (VALUES ('sra'), ('gds'), ('bioproject'), ('biosample'), ('pubmed')) v(target)),
 l AS (SELECT accession, target, CASE {_CAPS} END AS cap, dst_id, row_number() OVER (PARTITION BY accession, target ORDER BY pos, dst_id) AS rn FROM z JOIN crosswalk ON
 src_id = k AND dst_type = target), p AS (SELECT accession, target, string_agg(dst_id, '|' ORDER BY rn) AS ids, count(*) AS n FROM l WHERE rn <= cap GROUP BY ALL) """
_NOTE = """CASE WHEN st = 'unknown' THEN 'Unknown accession format: ' || accession WHEN st IN ('GSM', 'BioSample') THEN 'Conversion from ' || st || ' not implemented'
 WHEN st = 'GSE' AND target = 'sra' THEN CASE WHEN n > 0 THEN 'Found ' || n || ' SRA study(ies)' ELSE 'No SRA studies linked to this GSE' END
 WHEN st = 'GSE' AND target = 'gds' THEN 'GEO Datasets IDs' WHEN st = 'GSE' AND target = 'bioproject' THEN 'Found ' || coalesce(n, 0) || ' BioProject(s)'
 WHEN st = 'GSE' AND target = 'pubmed' THEN 'Linked PubMed articles' WHEN st = 'SRP' AND target = 'gds' THEN CASE WHEN n > 0 THEN 'Found ' || n || ' GDS record(s)'
 ELSE '' END WHEN st = 'SRP' AND target = 'bioproject' THEN 'SRA Study IS a BioProject' WHEN st = 'SRP' AND target = 'biosample' THEN 'Found ' || coalesce(n, 0) ||
 ' BioSample(s)' WHEN st IN ('SRX', 'SRR') AND target = 'sra' THEN CASE WHEN n > 0 THEN 'Found ' || n || ' parent SRA Study(ies)' ELSE 'No parent SRA Study found' END
 WHEN fam = 'PRJ' AND target = 'sra' THEN 'Found ' || coalesce(n, 0) || ' SRA Study(ies)' ELSE '' END"""
_IDS = ("CASE WHEN st = 'SRP' AND target = 'bioproject' THEN accession WHEN st = 'GSE' AND target = 'gds' THEN CASE WHEN ids IS NULL THEN '' ELSE 'GDS' || "
        "replace(ids, '|', '|GDS') END ELSE coalesce(ids, '') END")


@query("j8_crosswalk", CONVERT + f"SELECT accession, target, CASE WHEN fam = 'PRJ' THEN 'BioProject' ELSE st END AS source_type, {_IDS} AS targets, {_NOTE} AS note FROM z "
       "LEFT JOIN p USING (accession, target)", "accessions crosswalk")
def j8(spark, sf):
    out = j.convert_ids(table(spark, sf, "accessions"), table(spark, sf, "crosswalk"))
    return out.withColumn("targets", F.array_join("targets", "|"))


def part_vocab(spark, sf):
    return v.vocab_terms(part_entries(spark, sf))


@query("j10_resolve_alias", "SELECT q.p_partkey, coalesce(b.name, trim(asked)) AS canonical FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(brand || ' ' "
       "|| name) ELSE 'unknown ' || p_partkey END AS asked FROM parts) q LEFT JOIN parts b ON lower(trim(asked)) = lower(b.brand || ' ' || b.name)", "parts")
def j10(spark, sf):
    asked = table(spark, sf, "parts").select("p_partkey", F.when(c("p_partkey") % 3 == 0, F.concat(
        lit("  "), F.upper(F.concat_ws(" ", "brand", "name")))).otherwise(F.concat(lit("unknown "), c("p_partkey").cast("string"))).alias("asked"))
    synonyms = part_vocab(spark, sf).filter("kind = 'synonym'")
    return resolve_alias(asked, c("asked"), synonyms).select("p_partkey", "canonical")


@query("j11_fill_missing", "SELECT d.gse_id, CASE WHEN d.organism = '' THEN coalesce(s.organism, '') ELSE d.organism END AS organism, CASE WHEN d.sample_count = 0 AND "
       "s.n > 0 THEN s.n ELSE d.sample_count END::BIGINT AS sample_count, CASE WHEN s.gse_id IS NOT NULL THEN 'kw' ELSE d.keyword END AS keywords, CASE WHEN d.sra_id = '' "
       "THEN coalesce(s.srp, '') ELSE d.sra_id END AS sra_ids FROM datasets d LEFT JOIN (SELECT gse_id, max(organism) AS organism, count(*) AS n, max(srp_id) AS srp FROM "
       "sra_packages GROUP BY gse_id) s USING (gse_id)", "datasets sra_packages")
def j11(spark, sf):
    source = table(spark, sf, "sra_packages").groupBy("gse_id").agg(
        F.max("organism").alias("organism"), F.count(lit(1)).alias("sample_count"), F.array(F.max("srp_id")).alias("sra_ids"),
        F.array(lit("kw")).alias("keywords"))
    out = j.fill_missing(records(spark, sf), source, "gse_id", text=["organism"], lists=["sra_ids"], counts=["sample_count"], always=["keywords"])
    return out.select("gse_id", "organism", c("sample_count").cast("long").alias("sample_count"), F.array_join("keywords", "|").alias("keywords"),
                      F.array_join("sra_ids", "|").alias("sra_ids"))


def topic_dimensions(spark, sf):
    """A topic per document: given condition, organ and assay names."""
    df = table(spark, sf, "datasets")
    pick = lambda n, *names: F.element_at(F.array(*[lit(x) for x in names]), (c("doc_id") % n + 1).cast("int"))
    return df.select(
        "gse_id", c("gse_id").alias("topic_id"), F.array(pick(3, "Gout", "uric acid", "my state")).alias("diseases"),
        F.array(pick(2, "my organ", "toe")).alias("organs"), F.array(pick(2, "assay one", "assay two")).alias("omics_types"),
        one_or_none("keyword").alias("extra_keywords"))


_DIM = """, t AS (SELECT gse_id AS topic_id, CASE doc_id % 3 WHEN 0 THEN ['Gout', 'gouty arthritis', 'podagra'] WHEN 1 THEN ['uric acid'] ELSE ['my state'] END AS d,
 CASE doc_id % 2 WHEN 0 THEN 'my organ' ELSE 'toe' END AS o, CASE doc_id % 2 WHEN 0 THEN 'assay one' ELSE 'assay two' END AS a, keyword FROM datasets),
 e AS (SELECT topic_id, unnest(d) AS dn, unnest(range(1, len(d) + 1)) AS di, o, a, keyword FROM t),
 f AS (SELECT *, CASE WHEN lower(dn) IN ('gout', 'gouty arthritis', 'podagra') THEN 1.0 WHEN lower(dn) = 'uric acid' THEN 0.5 ELSE 0.8 END AS tier FROM e),
 k AS (SELECT topic_id, dn || ' ' || a AS keyword, (tier * 1.0)::DOUBLE AS weight, di AS seq FROM f UNION ALL SELECT topic_id, o || ' ' || a, 0.8::DOUBLE, 100 FROM t UNION ALL
 SELECT topic_id, dn || ' ' || o, (tier * 0.6)::DOUBLE, 200 + di FROM f UNION ALL SELECT topic_id, dn, (tier * 0.5)::DOUBLE, 300 + di FROM f UNION ALL SELECT topic_id, a,
 0.3::DOUBLE, 500 FROM t UNION ALL SELECT topic_id, keyword, 0.2::DOUBLE, 600 FROM t WHERE keyword <> ''),
 u AS (SELECT *, row_number() OVER (PARTITION BY topic_id, lower(keyword) ORDER BY seq) AS first FROM k) """


@query("j12_keyword_products", _DIM + "SELECT topic_id, keyword, round(weight, 6) AS weight FROM u WHERE first = 1", "datasets")
def j12(spark, sf):
    out = generate_keywords(topic_dimensions(spark, sf), knowledge(spark), 1000)
    return out.select("topic_id", "keyword", F.round("weight", 6).alias("weight"))


@query("j13_hierarchy", "WITH RECURSIVE parts AS (SELECT concat('part ', CAST(p_partkey AS VARCHAR)) AS name, CASE WHEN p_partkey < 7 THEN '' ELSE concat('part ', "
       "CAST(p_partkey // 7 AS VARCHAR)) END AS parent FROM part), w AS (SELECT name AS node, parent AS relative, 1 AS depth FROM parts WHERE parent <> '' UNION ALL SELECT "
       "node, parent, depth + 1 FROM w JOIN parts ON relative = name WHERE parent <> '') SELECT node, relative, depth, 'up' AS way FROM w UNION ALL SELECT relative, node, depth, "
       "'down' FROM w")
def j13(spark, sf):
    edges = v.vocab_edges(part_entries(spark, sf))
    nodes = table(spark, sf, "parts").select(c("name").alias("node"))
    return j.ancestors(nodes, edges).withColumn("way", lit("up")).unionByName(j.descendants(nodes, edges).withColumn("way", lit("down")))


@query("j13_alias_parents", "WITH RECURSIVE parts AS (SELECT concat('part ', CAST(p_partkey AS VARCHAR)) AS name, CASE WHEN p_partkey < 7 THEN '' ELSE concat('part ', "
       "CAST(p_partkey // 7 AS VARCHAR)) END AS parent FROM part), w AS (SELECT name AS node, parent AS relative, 1 AS depth FROM parts WHERE parent <> '' UNION ALL SELECT "
       "node, parent, depth + 1 FROM w JOIN parts ON relative = name WHERE parent <> '') SELECT node, relative, depth FROM w")
def j13_alias(spark, sf):
    """The same tree with every parent given by its synonym, in capitals."""
    parts, edges = table(spark, sf, "parts"), v.vocab_edges(part_entries(spark, sf))
    spoken = parts.select(c("name").alias("parent"), F.upper(F.concat_ws(" ", "brand", "name")).alias("spoken"))
    edges = edges.join(spoken, "parent").select(c("spoken").alias("parent"), "child")
    names = part_vocab(spark, sf).filter("kind in ('canonical', 'synonym', 'adjective')")
    return j.ancestors(parts.select(c("name").alias("node")), j.resolved_edges(edges, names))


def topics(spark, sf):
    """One topic per user."""
    return table(spark, sf, "topic_datasets").groupBy("topic_id").agg(
        F.max("added_at").alias("last_searched_at")).withColumn("name", F.concat(lit("topic "), c("topic_id")))


@query("j14_topic_by_name", "SELECT accession, topic_id FROM (SELECT DISTINCT accession, 'topic T' || CAST(CAST(right(accession, 2) AS INT) AS VARCHAR) AS name FROM accessions) a JOIN "
       "(SELECT DISTINCT topic_id FROM topic_datasets) t ON a.name = 'topic ' || t.topic_id", "accessions topic_datasets")
def j14(spark, sf):
    names = table(spark, sf, "accessions").distinct().select("accession", F.concat(
        lit("topic T"), F.right("accession", lit(2)).cast("int").cast("string")).alias("name"))
    return j.topic_by_name(topics(spark, sf), names).select("accession", "topic_id")


@query("j15_related", "SELECT name AS canonical, brand AS relative, 'organs' AS way FROM parts UNION ALL SELECT lower(brand), name, 'conditions' FROM parts", "parts")
def j15(spark, sf):
    pairs = j.related(part_entries(spark, sf))
    return pairs.select("canonical", "relative", lit("organs").alias("way")).unionByName(
        pairs.select(c("relative_key").alias("canonical"), c("canonical").alias("relative"), lit("conditions").alias("way")))


@query("j16_report_items", "SELECT topic_id AS report_id, 'topic ' || topic_id AS name, rank, gse_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY match_score DESC, "
       "edge_id) AS rank FROM topic_datasets) WHERE rank <= 30", "topic_datasets")
def j16(spark, sf):
    from lodecat.operators.order import top_per_key
    items = top_per_key(table(spark, sf, "topic_datasets"), ["topic_id"], [c("match_score").desc(), c("edge_id")], 30).select(
        c("topic_id").alias("report_id"), "rank", "gse_id")
    heads = topics(spark, sf).select(c("topic_id").alias("report_id"), "name")
    return j.report_items(heads, items)


@query("j17_lookup", "SELECT p_partkey, name AS canonical, kind, value FROM (SELECT p_partkey, name, 'synonym' AS kind, brand || ' ' || name AS value FROM parts UNION ALL SELECT p_partkey, "
       "name, 'parent', parent FROM parts WHERE parent <> '') UNION ALL SELECT -p_partkey, NULL, NULL, 'no ' || p_partkey FROM parts", "parts")
def j17(spark, sf):
    df = table(spark, sf, "parts")
    asked = df.select("p_partkey", F.upper(F.concat_ws(" ", "brand", "name")).alias("name")).unionByName(df.select(
        (-c("p_partkey")).alias("p_partkey"), F.concat(lit("no "), c("p_partkey").cast("string")).alias("name")))
    vocab = part_vocab(spark, sf)
    names = vocab.filter(c("kind").isin("canonical", "synonym"))
    both = names.unionByName(vocab.filter("kind = 'parent'").withColumn("term", F.concat(lit("\u0001"), "term")))
    return j.lookup(asked, both, ["synonym", "parent"]).select("p_partkey", "canonical", "kind", "value")


@query("j18_abbreviations", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN kind || '|' || brand ELSE 'x' || p_partkey END AS expansion FROM parts", "parts")
def j18(spark, sf):
    asked = table(spark, sf, "parts").select("p_partkey", F.concat(F.when(c("p_partkey") % 2 == 0, " p").otherwise("x"),
                                                                   c("p_partkey").cast("string")).alias("name"))
    out = j.expand_abbreviations(asked, v.parse_abbreviations(abbreviation_documents(spark, sf)))
    return out.select("p_partkey", F.array_join("expansion", "|").alias("expansion"))
