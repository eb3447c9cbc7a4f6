"""Set operations and writes U0-U17, review actions C16."""

from datetime import datetime

from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions.text import distinct_ignoring_case, ordered_union, term_hits
from lodecat.operators import review as r, store as s
from lodecat.operators.joins import without_answers
from workload.derived import records, table
from workload.joins import topics
from workload.registry import query

c, lit = F.col, F.lit


@query("u0_union_sources", "SELECT gse_id AS id, 0 AS source_rank FROM datasets UNION ALL SELECT srx_id, 2 FROM sra_packages", "datasets sra_packages")
def u0(spark, sf):
    return s.union_sources({"geo": table(spark, sf, "datasets").select(c("gse_id").alias("id")), "failed": None,
                            "sra": table(spark, sf, "sra_packages").select(c("srx_id").alias("id"))})


def snapshots(spark, sf):
    """A stored table, and a batch with changed, shorter, longer and new rows, some twice."""
    old = records(spark, sf).select(
        "gse_id", "doc_id", "title", "abstract", "organism", "omics_granularity", "sample_count", "sra_ids", "availability_status")
    new = old.select(
        "gse_id", "doc_id", F.when(c("doc_id") % 7 == 0, "").otherwise(F.concat("title", lit(" v2"))).alias("title"),
        F.when(c("doc_id") % 4 == 0, c("title")).when(c("doc_id") % 4 == 1, F.concat("abstract", lit(" more"))).otherwise(c("abstract")).alias("abstract"),
        lit("").alias("organism"), F.when(c("doc_id") % 5 == 0, "unknown").otherwise("spatial").alias("omics_granularity"),
        F.when(c("doc_id") % 3 == 0, 0).otherwise(c("sample_count") + 1).alias("sample_count"),
        F.when(c("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(lit("SRP1"))).alias("sra_ids"), lit("unverified").alias("availability_status"),
        lit(0).alias("arrival"))
    again = new.filter("doc_id % 6 = 1").withColumns({"title": F.concat("title", lit(" v3")), "organism": lit("Late organism"), "arrival": lit(1)})
    fresh = new.withColumns({"gse_id": F.concat("gse_id", lit("9")), "arrival": lit(2)})
    return old, new.unionByName(again).unionByName(fresh)


_NEW = """, n AS (SELECT gse_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE title || ' v2' END AS t1, CASE WHEN doc_id % 4 = 0 THEN title WHEN doc_id % 4 = 1 THEN abstract || ' more' ELSE abstract END AS a1,
 CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'spatial' END AS g1, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE sample_count + 1 END AS s1, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'SRP1' END AS i1, title, abstract,
 organism, omics_granularity, sample_count, sra_id FROM datasets) """


@query("u1_upsert", _NEW + "SELECT gse_id, CASE WHEN doc_id % 6 = 1 THEN t1 || ' v3' WHEN t1 <> '' THEN t1 ELSE title END AS title, length(CASE WHEN length(a1) > length(abstract) THEN a1 ELSE abstract END) AS "
       "n_abstract, CASE WHEN doc_id % 6 = 1 THEN 'Late organism' ELSE organism END AS organism, CASE WHEN g1 <> 'unknown' THEN g1 ELSE omics_granularity END AS omics_granularity, CASE WHEN s1 > 0 THEN s1 ELSE "
       "sample_count END AS sample_count, CASE WHEN i1 <> '' THEN i1 ELSE sra_id END AS sra_ids, 'unverified' AS availability_status FROM n UNION ALL SELECT gse_id || '9', t1, length(a1), '', g1, s1, i1, "
       "'unverified' FROM n", "datasets")
def u1(spark, sf):
    old, new = snapshots(spark, sf)
    out = s.upsert(old.drop("doc_id"), new.drop("doc_id"))
    return out.select("gse_id", "title", F.length("abstract").alias("n_abstract"), "organism", "omics_granularity", "sample_count",
                      F.array_join("sra_ids", "|").alias("sra_ids"), "availability_status")


@query("u2_ordered_union", "SELECT gse_id, concat_ws('|', nullif(sra_id, ''), 'x', CASE WHEN pubmed_id NOT IN ('', 'x') THEN pubmed_id END) AS ids FROM datasets", "datasets")
def u2(spark, sf):
    return records(spark, sf).select("gse_id", F.array_join(ordered_union(
        c("sra_ids"), F.array(lit("x")), c("sra_ids"), c("pubmed_ids")), "|").alias("ids"))


@query("u3_difference", "SELECT gse_id FROM datasets WHERE gse_id NOT IN (SELECT gse_id FROM topic_datasets WHERE review_status = 'approved')", "datasets topic_datasets")
def u3(spark, sf):
    done = table(spark, sf, "topic_datasets").filter("review_status = 'approved'")
    return without_answers(table(spark, sf, "datasets").select("gse_id"), done, ["gse_id"])


@query("u4_term_hits", "SELECT gse_id, concat_ws('|', " + ", ".join(f"CASE WHEN contains(lower(title), '{w}') THEN '{w}' END" for w in terms.VERDICT_DISEASE_TERMS + terms.VERDICT_SINGLE_CELL_TERMS)
       + ") AS hits FROM datasets", "datasets")
def u4(spark, sf):
    words = terms.VERDICT_DISEASE_TERMS + terms.VERDICT_SINGLE_CELL_TERMS
    return table(spark, sf, "datasets").select("gse_id", F.array_join(term_hits(F.lower("title"), words), "|").alias("hits"))


@query("u5_distinct_ignoring_case", "SELECT gse_id, organism || '|' || source || CASE WHEN keyword <> '' THEN '|' || keyword ELSE '' END AS names FROM datasets", "datasets")
def u5(spark, sf):
    names = F.concat(F.array("organism", F.upper("organism"), "source", F.concat(lit(" "), c("source"), lit("  "))), F.when(
        c("keyword") == "", F.array().cast("array<string>")).otherwise(F.array("keyword")))
    return table(spark, sf, "datasets").select("gse_id", F.array_join(distinct_ignoring_case(names), "|").alias("names"))


@query("u6_insert_new", "SELECT edge_id, topic_id, gse_id FROM topic_datasets WHERE edge_id % 3 <> 0 UNION ALL SELECT edge_id, 'new', gse_id FROM topic_datasets WHERE edge_id % 3 = 0", "topic_datasets")
def u6(spark, sf):
    edges = table(spark, sf, "topic_datasets").select("edge_id", "topic_id", "gse_id")
    stored = edges.filter("edge_id % 3 <> 0")
    return s.insert_new(stored, edges.withColumn("topic_id", lit("new")), "edge_id")


@query("u7_insert_or_replace", "SELECT topic_id, CASE WHEN CAST(substr(topic_id, 2) AS INT) % 2 = 0 THEN 'renamed' ELSE 'topic ' || topic_id END AS name FROM (SELECT DISTINCT topic_id FROM topic_datasets)",
       "topic_datasets")
def u7(spark, sf):
    t = topics(spark, sf).select("topic_id", "name")
    new = t.filter(F.substring("topic_id", 2, 9).cast("int") % 2 == 0).withColumn("name", lit("renamed"))
    return s.insert_or_replace(t, new, "topic_id")


@query("u8_append", "SELECT log_id, action FROM review_log UNION ALL SELECT edge_id, 'search' FROM topic_datasets", "review_log topic_datasets")
def u8(spark, sf):
    log = table(spark, sf, "review_log").select("log_id", "action")
    return s.append(log, table(spark, sf, "topic_datasets").select(c("edge_id").alias("log_id"), lit("search").alias("action")))


@query("u9_update_fields", "SELECT d.gse_id, coalesce(nullif(a.disease, ''), d.disease) AS disease, coalesce(nullif(a.organ, ''), d.organ) AS organ FROM datasets d LEFT JOIN answers a USING (gse_id)",
       "datasets answers")
def u9(spark, sf):
    d = table(spark, sf, "datasets").select("gse_id", "disease", "organ")
    return s.update_fields(d, table(spark, sf, "answers"), "gse_id", ["disease", "organ"])


@query("u10_refresh", "SELECT gse_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN 'fetched ' || source ELSE title END AS title, CASE WHEN doc_id % 2 = 0 AND n_chars % 3 > 0 THEN n_chars % 3 ELSE sample_count END AS "
       "sample_count, CASE WHEN doc_id % 2 = 0 THEN 'unverified' ELSE availability_status END AS availability_status FROM datasets", "datasets")
def u10(spark, sf):
    d = table(spark, sf, "datasets")
    fetched = d.filter("doc_id % 2 = 0").select("gse_id", F.when(c("doc_id") % 4 == 0, F.concat(lit("fetched "), c("source"))).otherwise("").alias("title"),
                                                (c("n_chars") % 3).alias("n_samples"))
    return s.refresh(d, fetched).select("gse_id", "title", "sample_count", "availability_status")


@query("u11_delete_topics", "SELECT topic_id, count(*) AS edges FROM topic_datasets WHERE topic_id NOT IN ('T1', 'T7') GROUP BY 1", "topic_datasets")
def u11(spark, sf):
    gone = topics(spark, sf).filter(c("topic_id").isin("T1", "T7"))
    left, edges = s.delete_topics(topics(spark, sf), table(spark, sf, "topic_datasets"), gone)
    return left.join(edges.groupBy("topic_id").agg(F.count(lit(1)).alias("edges")), "topic_id").select("topic_id", "edges")


def reports(spark, sf):
    """Stored reports of even topics and a new run of every topic."""
    edges = table(spark, sf, "topic_datasets")
    number = F.substring("topic_id", 2, 9).cast("int")
    heads = topics(spark, sf).select(F.concat(lit("old "), c("topic_id")).alias("report_id"), s.query_hash(c("name")).alias("query_hash"), lit("v1").alias("mode"),
                                     lit("[geo]").alias("sources"), "topic_id")
    items = edges.select(F.concat(lit("old "), c("topic_id")).alias("report_id"), "gse_id", lit("old").alias("run"), number.alias("n"))
    new_heads = heads.withColumn("report_id", F.concat(lit("new "), c("topic_id"))).drop("topic_id")
    new_items = edges.filter("edge_id % 2 = 0").select(F.concat(lit("new "), c("topic_id")).alias("report_id"), "gse_id", lit("new").alias("run"))
    return (heads.filter(number % 2 == 0).drop("topic_id"), items.filter("n % 2 = 0").drop("n"), new_heads, new_items)


@query("u12_save_reports", "SELECT CASE WHEN CAST(substr(topic_id, 2) AS INT) % 2 = 0 THEN 'old ' ELSE 'new ' END || topic_id AS report_id, 'new' AS run, count(*) AS items FROM topic_datasets WHERE edge_id % 2 = 0 GROUP BY "
       "topic_id", "topic_datasets")
def u12(spark, sf):
    heads, items = s.save_reports(*reports(spark, sf))
    return heads.select("report_id").join(items, "report_id").groupBy("report_id", "run").agg(F.count(lit(1)).alias("items"))


@query("u13_delete_reports", "SELECT 'old ' || topic_id AS report_id, count(*) AS items FROM topic_datasets WHERE CAST(substr(topic_id, 2) AS INT) % 2 = 0 AND topic_id NOT IN ('T4', 'T6') GROUP BY topic_id", "topic_datasets")
def u13(spark, sf):
    heads, items, _, _ = reports(spark, sf)
    heads, items = s.delete_reports(heads, items, query="topic T4", mode="v1")
    heads, items = s.delete_reports(heads, items, ids=heads.filter("report_id = 'old T6'"))
    return heads.select("report_id").join(items, "report_id").groupBy("report_id").agg(F.count(lit(1)).alias("items"))


@query("u14_apply_checks", "SELECT gse_id, CASE WHEN doc_id % 2 = 0 THEN 'restricted' ELSE availability_status END AS availability_status, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE access_type END AS access_type FROM datasets",
       "datasets")
def u14(spark, sf):
    from lodecat.plans.availability import apply_checks
    d = table(spark, sf, "datasets").select("gse_id", "doc_id", "availability_status", "access_type")
    results = d.filter("doc_id % 2 = 0").select("gse_id", lit("restricted").alias("availability_status"), lit(None).cast("string").alias("access_type"))
    return apply_checks(d, results, datetime(2024, 1, 1)).drop("doc_id")


@query("u15_detect_changes", "SELECT gse_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change, (CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 4 ELSE 3 END)::INT AS version "
       "FROM datasets", "datasets")
def u15(spark, sf):
    d = records(spark, sf)
    hashed = d.select("gse_id", "doc_id", s.metadata_hash(["gse_id", "title"], ["sra_ids"]).alias("metadata_hash"), lit(3).alias("version"))
    incoming = d.withColumn("title", F.when(c("doc_id") % 5 == 0, F.concat("title", lit("!"))).otherwise(c("title"))).select(
        "gse_id", s.metadata_hash(["gse_id", "title"], ["sra_ids"]).alias("metadata_hash"), lit(0).alias("version"))
    return s.detect_changes(hashed.filter("doc_id % 3 <> 0"), incoming).select("gse_id", "change", "version")


_TWICE = """, inc AS (SELECT gse_id, title, MAP {'lang': organism} AS attributes, 0 AS nth FROM datasets WHERE doc_id % 3 = 0 UNION ALL SELECT gse_id, title || '!',
 MAP {'lang': ''}, 1 FROM datasets WHERE doc_id % 6 = 0), last AS (SELECT gse_id, arg_max(title, nth) AS title, arg_max(attributes, nth) AS attributes FROM inc GROUP BY gse_id) """


def _twice(spark, sf):
    """Fetched rows with an attribute map, half of the keys twice; and their order."""
    d = table(spark, sf, "datasets")
    one = d.filter("doc_id % 3 = 0").select("gse_id", "title", F.create_map(lit("lang"), c("organism")).alias("attributes"), lit(0).alias("nth"))
    two = d.filter("doc_id % 6 = 0").select("gse_id", F.concat("title", lit("!")).alias("title"), F.create_map(lit("lang"), lit("")).alias("attributes"), lit(1).alias("nth"))
    return one.union(two)


@query("u7_replace_rows_with_maps", _TWICE + "SELECT d.gse_id, coalesce(l.title, d.title) AS title, coalesce(l.attributes['lang'], d.organism) AS lang FROM datasets d LEFT JOIN last l USING (gse_id)", "datasets")
def u7_maps(spark, sf):
    stored = table(spark, sf, "datasets").select("gse_id", "title", F.create_map(lit("lang"), c("organism")).alias("attributes"), lit(-1).alias("nth"))
    return s.insert_or_replace(stored, _twice(spark, sf), "gse_id", [c("nth")]).select("gse_id", "title", c("attributes")["lang"].alias("lang"))


@query("u9_update_rows_with_maps", _TWICE + "SELECT d.gse_id, coalesce(nullif(l.title, ''), d.title) AS title, coalesce(l.attributes['lang'], d.organism) AS lang FROM datasets d LEFT JOIN last l USING (gse_id)", "datasets")
def u9_maps(spark, sf):
    stored = table(spark, sf, "datasets").select("gse_id", "title", F.create_map(lit("lang"), c("organism")).alias("attributes"))
    out = s.update_fields(stored, _twice(spark, sf), "gse_id", ["title", "attributes"], order=[c("nth")])
    return out.select("gse_id", "title", c("attributes")["lang"].alias("lang"))


@query("u15_detect_changes_repeated", _TWICE + "SELECT gse_id, CASE WHEN d.doc_id % 9 = 0 THEN 'new' WHEN l.title <> d.title THEN 'changed' ELSE 'same' END AS change, "
       "(CASE WHEN d.doc_id % 9 = 0 THEN 1 WHEN l.title <> d.title THEN 6 ELSE 5 END)::INT AS version FROM last l JOIN datasets d USING (gse_id)", "datasets")
def u15_repeated(spark, sf):
    hashed = lambda df: df.withColumns({"metadata_hash": s.metadata_hash(["gse_id", "title"]), "version": lit(5)})
    stored = hashed(table(spark, sf, "datasets").filter("doc_id % 9 <> 0").select("gse_id", "title"))
    return s.detect_changes(stored, hashed(_twice(spark, sf)), order=[c("nth")]).select("gse_id", "change", "version")


def actions(spark, sf):
    """One action per edge of known and unknown pairs, with some impossible states."""
    e = table(spark, sf, "topic_datasets")
    return e.filter("edge_id % 4 = 0").select(
        F.lpad(c("edge_id").cast("string"), 9, "0").alias("action_id"), "topic_id",
        F.when(c("edge_id") % 3 == 0, F.concat("gse_id", lit("x"))).otherwise(c("gse_id")).alias("gse_id"), lit("mark").alias("action"),
        F.when(c("edge_id") % 5 == 1, "wrong").when(c("edge_id") % 5 == 2, "approved").otherwise("irrelevant").alias("new_status"), lit("").alias("note"))


ACTIONS = """, a AS (SELECT lpad(CAST(edge_id AS VARCHAR), 9, '0') AS action_id, topic_id, CASE WHEN edge_id % 3 = 0 THEN gse_id || 'x' ELSE gse_id END AS gse_id, CASE WHEN edge_id % 5 = 1 THEN 'wrong' WHEN edge_id % 5 = 2 THEN
 'approved' ELSE 'irrelevant' END AS new_status FROM topic_datasets WHERE edge_id % 4 = 0), cur AS (SELECT topic_id, gse_id, min(review_status) AS old FROM topic_datasets GROUP BY ALL) """


@query("c16_apply_review", ACTIONS + "SELECT action_id, gse_id, CASE WHEN new_status <> 'wrong' AND old IS NOT NULL THEN old ELSE '' END AS old_status, new_status, new_status <> 'wrong' AND old IS NOT NULL AS success, CASE WHEN "
       "new_status = 'wrong' THEN 'Invalid status: wrong' WHEN old IS NULL THEN 'No topic-dataset relation found' ELSE '' END AS error, new_status <> 'wrong' AND old IS NOT NULL AND (old = new_status OR (old, new_status) IN ("
       + ", ".join(f"('{x}', '{y}')" for x, y in terms.REVIEW_TRANSITIONS) + ")) AS allowed FROM a LEFT JOIN cur USING (topic_id, gse_id)", "topic_datasets")
def c16(spark, sf):
    return r.apply_actions(table(spark, sf, "topic_datasets"), actions(spark, sf)).select(
        "action_id", "gse_id", "old_status", "new_status", "success", "error", "allowed")


@query("u16_update_review", ACTIONS + ", l AS (SELECT topic_id, gse_id, arg_max(new_status, action_id) AS ns FROM a WHERE new_status <> 'wrong' GROUP BY ALL) SELECT edge_id, coalesce(ns, review_status) AS review_status FROM "
       "topic_datasets LEFT JOIN l USING (topic_id, gse_id)", "topic_datasets")
def u16(spark, sf):
    edges = table(spark, sf, "topic_datasets")
    return r.update_status(edges, r.apply_actions(edges, actions(spark, sf))).select("edge_id", "review_status")


@query("u16_review_notes", ACTIONS + ", b AS (SELECT a.*, old, CASE WHEN new_status = 'approved' THEN 'seen ' || action_id ELSE '' END AS note FROM a JOIN cur USING (topic_id, gse_id) WHERE new_status <> 'wrong'), l AS (SELECT topic_id, gse_id, "
       "arg_max(new_status, action_id) AS ns, arg_max(note, action_id) AS nn FROM b GROUP BY ALL) SELECT CAST(edge_id AS VARCHAR) AS id, 'edge' AS kind, topic_id, gse_id, coalesce(ns, review_status) AS status, coalesce(nullif(nn, ''), 'old') AS note, ns IS NOT NULL AS stamped FROM "
       "topic_datasets LEFT JOIN l USING (topic_id, gse_id) UNION ALL SELECT action_id, 'log', topic_id, gse_id, new_status, note, true FROM b", "topic_datasets")
def u16_notes(spark, sf):
    """Status, note and time of every edge, and the log rows the actions leave."""
    as_of = datetime(2025, 6, 30, 12)
    edges = table(spark, sf, "topic_datasets").withColumns({"review_note": lit("old"), "reviewed_at": lit(None).cast("timestamp")})
    asked = actions(spark, sf).withColumn("note", F.when(c("new_status") == "approved", F.concat(lit("seen "), c("action_id"))).otherwise(""))
    done = r.apply_actions(edges, asked)
    stamp = F.coalesce(c("at") == lit(as_of).cast("timestamp"), lit(False)).alias("stamped")
    changed = r.update_status(edges, done, as_of).select(c("edge_id").cast("string").alias("id"), lit("edge").alias("kind"), "topic_id", "gse_id",
                                                         c("review_status").alias("status"), c("review_note").alias("note"), c("reviewed_at").alias("at"))
    logged = r.log_rows(done, as_of).select(c("log_id").alias("id"), lit("log").alias("kind"), "topic_id", "gse_id", c("new_status").alias("status"), "note", c("acted_at").alias("at"))
    return changed.unionByName(logged).select("id", "kind", "topic_id", "gse_id", "status", "note", stamp)


@query("c16_batch_actions", "SELECT DISTINCT topic_id, gse_id FROM topic_datasets WHERE topic_id = 'T2' AND review_status = 'pending'", "topic_datasets")
def c16b(spark, sf):
    return r.batch_actions(table(spark, sf, "topic_datasets"), "T2", "approved", "pending").select("topic_id", "gse_id")


@query("u17_invalidate", "SELECT key FROM cache_index WHERE key NOT IN (SELECT 'k' || right(accession, 2) FROM accessions)", "cache_index accessions")
def u17(spark, sf):
    keys = table(spark, sf, "accessions").select(F.concat(lit("k"), F.right("accession", lit(2))).alias("key"))
    return s.invalidate(table(spark, sf, "cache_index"), keys).select("key")
