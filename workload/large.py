"""Matching against vocabularies that grow with the data."""

from pyspark.sql import functions as F

from lodecat.functions import text as t
from lodecat.operators.anchored import phrase_tokens, with_classes
from lodecat.plans import inference, sample_groups as sg
from lodecat.plans.view import to_view
from lodecat.session import cut_lineage
from workload.derived import AS_OF, QUERY, given, records, table
from workload.composites import GROUPS, SAMPLED
from workload.registry import query
from workload.scalars import D_CTE, GRAIN, INFER_FROM, PLATFORM, SC_HIT
from workload.text import TEXT

c = F.col
WORD, PAIR = "[a-z]{9,}", "[a-z]{6,} [a-z]{6,}"


def _found(spark, sf, *patterns):
    """What the patterns find in all documents, read once."""
    found = [F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)) for p in patterns]
    return given(spark, sf, "documents").select(F.explode(F.concat(*found)).alias("term")).distinct()


def text_vocab(spark, sf):
    """Long words and pairs of words of all documents, dealt to the domains by length."""
    n = F.length("term")
    return cut_lineage(_found(spark, sf, WORD, PAIR)).select(
        F.element_at(F.array(*map(F.lit, ("disease", "organ", "assay"))), n % 3 + 1).alias("domain"), "term", F.upper("term").alias("canonical"),
        F.lit(0.5).alias("weight"), F.when(n % 2 == 0, "bulk").otherwise("unknown").alias("granularity"), c("term").alias("pos"))


_V = (f"v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents UNION "
      f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{PAIR}')) FROM documents), ")
_RUNS = "regexp_extract_all(txt, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+')"


def _best(name, rest):
    return (f"{name} AS (SELECT gse_id, arg_min(upper(term), (-length(term), term)) AS canonical, 0.5::DOUBLE AS weight, arg_min(CASE WHEN length(term) % 2 = 0 "
            f"THEN 'bulk' ELSE 'unknown' END, (-length(term), term)) AS granularity FROM hit WHERE length(term) % 3 = {rest} GROUP BY gse_id)")


LARGE_CTE = (D_CTE + SC_HIT + ", " + _V + f"runs AS (SELECT gse_id, {_RUNS} AS r FROM d), "
             "w AS (SELECT DISTINCT gse_id, unnest(r) AS term FROM runs UNION SELECT DISTINCT gse_id, r[i] || r[i + 1] || r[i + 2] FROM "
             "(SELECT gse_id, r, unnest(range(1, len(r) - 1)) AS i FROM runs)), "
             "hit AS (SELECT gse_id, term FROM w JOIN v USING (term)), " + ", ".join(_best(n, k) for k, n in enumerate(("hd", "ho", "ha"))))


@query("c3_infer_large", LARGE_CTE + ", " + GROUPS.lstrip(", ") + f"SELECT x.gse_id, coalesce(hd.canonical, '') AS disease, coalesce(ho.canonical, '') AS organ, "
       f"coalesce(ha.canonical, '') AS assay, coalesce(hd.weight, 0)::DOUBLE AS disease_weight, CASE WHEN ha.canonical IS NOT NULL AND ha.granularity <> 'unknown' THEN ha.granularity ELSE "
       f"{GRAIN} END AS granularity, {PLATFORM} AS platform, {SAMPLED} FROM datasets x "
       f"JOIN {INFER_FROM} USING (gse_id) LEFT JOIN gsum USING (gse_id)", "datasets samples")
def c3_large(spark, sf):
    summary, groups = sg.infer_groups(table(spark, sf, "samples"))
    vocab = inference.Vocabularies.of(text_vocab(spark, sf))
    out = inference.infer(table(spark, sf, "datasets"), vocab, sg.with_lead_groups(summary, groups))
    return out.select("gse_id", *[F.coalesce(f"i_{x}", F.lit("")).alias(x) for x in ("disease", "organ", "assay")], c("i_disease_weight").alias("disease_weight"),
                      c("i_granularity").alias("granularity"), c("platform_mapped").alias("platform"), c("group_method").alias("method"), "design",
                      "contrast_ready", "n_samples")


@query("p3_view_large", LARGE_CTE + " SELECT gse_id, coalesce(nullif(disease, ''), hd.canonical, '') AS disease, coalesce(nullif(organ, ''), ho.canonical, '') AS organ "
       f"FROM datasets JOIN {INFER_FROM} USING (gse_id)", "datasets")
def p3_large(spark, sf):
    vocab = inference.Vocabularies.of(text_vocab(spark, sf))
    return to_view(records(spark, sf), QUERY, AS_OF, vocab).select("gse_id", "disease", "organ")


@query("p6_merge_large", LARGE_CTE + " SELECT gse_id, CASE WHEN disease IN ('', 'unknown') THEN coalesce(hd.canonical, 'unknown') ELSE disease END AS disease, "
       "CASE WHEN organ IN ('', 'unknown') THEN coalesce(ho.canonical, 'unknown') ELSE organ END AS organ, CASE WHEN omics_type IN ('', 'unknown') THEN "
       f"coalesce(ha.canonical, 'unknown') ELSE omics_type END AS omics_type FROM datasets JOIN {INFER_FROM} USING (gse_id)", "datasets")
def p6_large(spark, sf):
    df = table(spark, sf, "datasets")
    inferred = inference.infer_fields(df.withColumn("_t", t.squash(t.join_text(c("title"), c("abstract"), c("overall_design")))), c("_t"),
                                      inference.Vocabularies.of(text_vocab(spark, sf)))
    return inference.merge_inferred(df, inferred).select("gse_id", "disease", "organ", "omics_type")


def class_vocab(spark, sf):
    """Long words of all documents, in classes by their first three letters, declared by the alphabet."""
    return _found(spark, sf, WORD).select(F.substring("term", 1, 3).alias("name"), "term", c("term").alias("pos"))


_CLASS_HITS = (f", v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents), cl AS (SELECT substr(term, 1, 3) AS name, min(term) AS first "
               f"FROM v GROUP BY 1), txt AS MATERIALIZED (SELECT gse_id, lower({TEXT}) AS txt FROM datasets), g AS (SELECT DISTINCT gse_id, substr(txt, i, 9) AS head, i FROM "
               "(SELECT gse_id, txt, unnest(range(1, length(txt) - 7)) AS i FROM txt)), h AS (SELECT DISTINCT gse_id, term FROM g JOIN v ON head = substr(term, 1, 9) "
               "JOIN txt USING (gse_id) WHERE substr(txt, i, length(term)) = term), hit AS (SELECT gse_id, term, name, first FROM h JOIN cl ON name = substr(term, 1, 3)) ")


def _classes(spark, sf, rule):
    text = F.lower(t.join_text(c("title"), c("abstract"), c("overall_design")))
    return with_classes(table(spark, sf, "datasets").select("gse_id", text.alias("_t")), "gse_id", c("_t"), class_vocab(spark, sf), rule, "found")


@query("m2_first_declared_large", _CLASS_HITS + "SELECT gse_id, coalesce(arg_min(name, first), '') AS found FROM datasets LEFT JOIN hit USING (gse_id) GROUP BY gse_id", "datasets")
def m2_large(spark, sf):
    return _classes(spark, sf, "first").select("gse_id", F.coalesce("found", F.lit("")).alias("found"))


@query("m3_longest_alias_large", _CLASS_HITS + "SELECT gse_id, coalesce(arg_min(name, (-length(term), term)), '') AS found FROM datasets LEFT JOIN hit USING (gse_id) GROUP BY gse_id",
       "datasets")
def m3_large(spark, sf):
    return _classes(spark, sf, "longest").select("gse_id", F.coalesce("found", F.lit("")).alias("found"))


@query("m4_all_classes_large", _CLASS_HITS + "SELECT gse_id, coalesce(string_agg(name, '|' ORDER BY first), '') AS found FROM datasets LEFT JOIN (SELECT DISTINCT gse_id, name, first "
       "FROM hit) USING (gse_id) GROUP BY gse_id", "datasets")
def m4_large(spark, sf):
    return _classes(spark, sf, "all").select("gse_id", F.array_join("found", "|").alias("found"))


@query("m8_greedy_phrases_large", f"WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{PAIR}')) AS term FROM documents), "
       "k AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), ',，', '  '), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents), "
       "tk AS (SELECT doc_id, i, t[i] AS w, t[i + 1] AS nxt FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM k)), "
       "s AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM tk JOIN v ON lower(w || ' ' || nxt) = term), "
       "taken AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, isle ORDER BY i) % 2 = 1) "
       "SELECT doc_id, md5(coalesce(string_agg(CASE WHEN a.i IS NULL THEN w ELSE w || ' ' || nxt END, '|' ORDER BY tk.i) FILTER (b.i IS NULL), '')) AS tokens, "
       "count(a.i) AS n_phrases FROM (SELECT doc_id FROM documents) LEFT JOIN tk USING (doc_id) LEFT JOIN taken a ON a.doc_id = tk.doc_id AND a.i = tk.i "
       "LEFT JOIN taken b ON b.doc_id = tk.doc_id AND b.i = tk.i - 1 GROUP BY doc_id")
def m8_large(spark, sf):
    """Whole texts read as queries, against all pairs of long words."""
    rows = phrase_tokens(given(spark, sf, "documents").select("doc_id", "text"), "doc_id", c("text"), _found(spark, sf, PAIR), "tokens")
    return rows.select("doc_id", F.md5(F.array_join("tokens", "|")).alias("tokens"), F.size(F.filter("tokens", lambda x: F.contains(x, F.lit(" ")))).cast("long").alias("n_phrases"))
