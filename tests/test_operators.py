"""Operators: order, matching, store, review, groups, streams, files, plans and skew."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodecat.operators import joins, order, store
from lodecat.operators.matching import match_all, match_best, resolve_alias
from lodecat.operators.review import log_rows, review_state, update_status
from lodecat.plans import inference, knowledge as kn, sample_groups as sg, search
from lodecat.plans.topics import from_dimensions
from lodecat.session import run_folder
from lodecat.sources import landed, sinks, vocabulary as v
from lodecat.streaming import jobs

c, lit = F.col, F.lit


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def skewed(spark, n=6000):
    """A third of all rows under one key."""
    return spark.range(n).select(
        c("id"), F.when(c("id") % 3 == 0, "hot").otherwise(F.concat(lit("k"), (c("id") % 97).cast("string"))).alias("key"),
        (c("id") * 7919 % 1000).alias("v"))


def test_global_positions_equal_window(spark):
    df = skewed(spark)
    got = order.global_positions(df, [c("v").desc(), c("id")], "r", {"s": c("v")}).select("id", "r", "s")
    w = Window.orderBy(c("v").desc(), c("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.row_number().over(Window.orderBy(c("v").desc(), c("id"))).alias("r"), F.sum("v").over(w).alias("s"))
    assert rows(got) == rows(want)


def test_first_per_key_is_idempotent_and_order_free(spark):
    df = skewed(spark)
    once = order.first_per_key(df, ["key"], [c("v"), c("id")])
    assert rows(order.first_per_key(once, ["key"], [c("v"), c("id")])) == rows(once)
    assert rows(order.first_per_key(df.orderBy(F.rand(3)), ["key"], [c("v"), c("id")])) == rows(once)


def test_top_per_key_cuts_before_the_shuffle(spark):
    df = order.top_per_key(skewed(spark), ["key"], [c("v"), c("id")], 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.groupBy("key").count().agg(F.max("count")).first()[0] == 5


def test_first_per_key_combines_before_the_shuffle(spark):
    plan = order.first_per_key(skewed(spark), ["key"], [c("v")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_eviction_keeps_both_bounds(spark):
    rng = random.Random(2)
    data = [(f"k{i:04}", datetime(2024, 1, 1 + i % 28), rng.randint(1, 100)) for i in range(300)]
    index = spark.createDataFrame(data, "key string, cached_at timestamp, bytes bigint")
    gone = {r[0] for r in order.evict(index, 200, 6000).collect()}
    left = [d for d in data if d[0] not in gone]
    assert len(left) <= 190 and sum(d[2] for d in left) <= 4800
    assert order.evict(index, 1000, 10**6).count() == 0


def vocab(spark, terms):
    data = [(t, t.upper(), 1.0, "", i) for i, t in enumerate(terms)]
    return spark.createDataFrame(data, "term string, canonical string, weight double, granularity string, pos int")


def test_both_matching_forms_agree(spark):
    rng = random.Random(4)
    words = ["gout", "uric acid", "acid", "liver fibrosis", "liver", "b-cell", "cell"]
    texts = [(i, " ".join(rng.choice(["gout", "uric", "acid", "Liver", "fibrosis,", "b-cell", "x", "égout"]) for _ in range(12))) for i in range(200)]
    df = spark.createDataFrame(texts, "id int, t string")
    inline = match_best(df, "id", c("t"), vocab(spark, words), "m").select("id", "m.canonical")
    joined = match_best(df, "id", c("t"), vocab(spark, words), "m", limit=1).select("id", "m.canonical")
    assert rows(inline) == rows(joined)
    assert match_all(df, "id", c("t"), vocab(spark, [])).count() == 0


def test_resolve_alias_takes_first(spark):
    v2 = vocab(spark, ["a", "b"]).unionByName(vocab(spark, ["a"]).withColumns({"canonical": lit("other"), "pos": lit(9)}))
    out = resolve_alias(spark.createDataFrame([(" A ",), ("z",)], "n string"), c("n"), v2)
    assert rows(out) == [(" A ", "A"), ("z", "z")]


def records(spark, data):
    return spark.createDataFrame(data, "gse_id string, title string, abstract string, omics_granularity string, sample_count int, "
                                 "sra_ids array<string>, last_updated string, arrival long")


def test_upsert_rules_and_idempotence(spark):
    old = records(spark, [("G1", "old", "long abstract", "bulk", 5, ["S1"], "t0", 0)]).drop("arrival")
    new = records(spark, [("G1", "", "short", "unknown", 0, [], "t1", 0), ("G1", "newer", "same length!!", "spatial", 7, [], "t2", 1),
                          ("G2", "b", "", "unknown", 0, [], "t1", 2)])
    once = store.upsert(old, new)
    assert rows(once) == [("G1", "newer", "long abstract", "spatial", 7, ["S1"], "t2"), ("G2", "b", "", "unknown", 0, [], "t1")]
    assert rows(store.upsert(once, new)) == rows(once)


def stack(actions):
    s = []
    for action, status in actions:
        if action != "undo":
            s.append(status)
        elif s:
            s.pop()
    return s[-1] if s else "pending"


def review_log(spark, n=3000, seed=7):
    rng = random.Random(seed)
    data = [(i, "T", "hot" if rng.random() < 0.34 else f"g{rng.randrange(40)}", rng.choice(["undo", "undo", "mark", "approve"]),
             rng.choice(["approved", "deleted", "irrelevant"]), datetime.fromtimestamp(1700000000 + rng.randrange(10**6))) for i in range(n)]
    df = spark.createDataFrame(data, "log_id long, topic_id string, gse_id string, action string, new_status string, acted_at timestamp")
    per = {}
    for d in sorted(data, key=lambda d: (d[5], d[0])):
        per.setdefault(d[2], []).append((d[3], d[4]))
    return df, sorted(("T", g, stack(a)) for g, a in per.items())


def test_review_state_equals_stack(spark):
    df, want = review_log(spark)
    assert rows(review_state(df)) == want


def test_review_stream_in_many_batches(spark):
    df, want = review_log(spark, 600)
    folder = run_folder(spark, "t")
    df.repartition(5).write.parquet(folder + "/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    jobs.stream_review(stream, folder + "/out", folder + "/state", every=None).awaitTermination()
    assert rows(jobs.read_status(spark, folder + "/out")) == want


def test_upsert_stream_equals_batch(spark):
    rng = random.Random(9)
    data = [(f"G{rng.randrange(30)}" if i % 20 else "", rng.choice(["", f"t{i}"]), "a" * rng.randrange(9), "bulk", rng.randrange(3), [], f"u{i}", i)
            for i in range(400)]
    df = records(spark, data).coalesce(1).sortWithinPartitions("arrival")
    folder = run_folder(spark, "t")
    for i in range(4):
        df.filter(c("arrival").between(i * 100, i * 100 + 99)).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    jobs.stream_upsert(stream, folder + "/table", folder + "/state", every=None).awaitTermination()
    got = jobs.read_table(spark, folder + "/table")
    fields = ["gse_id", "title", "abstract", "sample_count", "last_updated"]
    assert rows(got.select(*fields)) == rows(store.fold_versions(df.filter("gse_id <> ''"), "gse_id", "arrival").select(*fields))
    assert spark.read.parquet(folder + "/table/rejected").count() == 20
    jobs.compact(spark, folder + "/table", folder + "/compacted")
    assert rows(jobs.read_table(spark, folder + "/compacted").select(*fields)) == rows(got.select(*fields))


def groups_of(spark, sets):
    data = [(k, n, i) for k, names in sets.items() for i, n in enumerate(names)]
    summary, groups = sg.infer_groups(spark.createDataFrame(data, "gse_id string, title string, pos long"))
    out = {r["gse_id"]: r for r in summary.collect()}
    names = {}
    for r in sorted(groups.collect(), key=lambda r: r["pos"]):
        names.setdefault(r["gse_id"], []).append((r["name"], r["n"]))
    return out, names


def test_sample_group_strategies(spark):
    out, names = groups_of(spark, {
        "prefix": ["Con1", "Con2", "Con3", "GR1", "GR2", "GR3", "GS1", "GS2", "GS3"],
        "delim": ["control_1", "control_2", "treated_1", "treated_2"],
        "patient": ["patient1_before", "patient1_after", "patient2_before", "patient2_after"],
        "none": ["sampleA", "sampleB"], "one": ["Con1", "Con2", "Con3"], "digits": ["1", "2", "3", "4"],
        "time": ["before", "after", "24h"], "mixed": ["CON1", "con2", "Con3", "TR1", "tr2", "Tr3"]})
    got = {k: (r["method"], r["design"], r["contrast_ready"]) for k, r in out.items()}
    assert got == {
        "prefix": ("prefix", "multi-group", True), "delim": ("delimiter", "binary", True), "patient": ("delimiter", "binary", True),
        "none": ("fallback", "single-group", False), "one": ("fallback", "single-group", False), "digits": ("fallback", "single-group", False),
        "time": ("timecourse", "multi-group", False), "mixed": ("prefix", "binary", True)}
    assert names["prefix"] == [("con", 3), ("gr", 3), ("gs", 3)] and names["none"] == [("all", 2)]
    assert out["prefix"]["confidence"] == 0.95 and out["one"]["confidence"] == 0.3


def test_hot_dataset_groups(spark):
    """One dataset holds a third of all samples."""
    df = spark.range(9000).select(
        F.when(c("id") % 3 == 0, "hot").otherwise(F.concat(lit("d"), (c("id") % 50).cast("string"))).alias("gse_id"),
        F.concat(F.when(c("id") % 2 == 0, "Con").otherwise("Trt"), c("id").cast("string")).alias("title"), c("id").alias("pos"))
    summary, groups = sg.infer_groups(df)
    assert summary.filter("gse_id = 'hot'").select("method", "n_samples", "n_groups").first()[:] == ("prefix", 3000, 2)
    assert groups.agg(F.sum("n")).first()[0] == 9000


def test_hierarchy_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    nodes = spark.createDataFrame([("c",)], "node string")
    assert rows(joins.ancestors(nodes, edges)) == [("c", "a", 2), ("c", "b", 1)]


def test_seed_vocabulary(spark):
    entries = v.seed_entries(spark)
    up = joins.ancestors(spark.createDataFrame([("Glomerulus",)], "node string"), v.vocab_edges(entries))
    assert rows(up) == [("Glomerulus", "Kidney", 1), ("Glomerulus", "Urinary system", 2)]
    know = kn.Knowledge.of(entries)
    one = spark.createDataFrame([("gout",), ("odd",)], "w string").select(know.expand(c("w"))).collect()
    assert one[0][0][:2] == ["gout", "tophus"] and one[1][0] == ["odd"]
    names = spark.createDataFrame([(1, "GOUT"), (2, "scrna-seq"), (3, "odd")], "term_id int, name string")
    joined = dict((r["term_id"], r["expansion"]) for r in kn.expand_terms_join(names, entries).collect())
    inline = dict((r[0], r[1]) for r in names.select("term_id", know.expand(c("name"))).collect())
    assert joined == inline
    assert len(inference.Vocabularies.of(v.vocab_terms(entries, matching_only=True)).organ) > 20


def test_abbreviations(spark):
    body = json.dumps({"abbreviations": {"ckd": {"full_name": "chronic kidney disease", "search_terms": ["kidney"], "related_diseases": ["Gout"],
                                                 "related_organs": ["Kidney"]}}})
    ab = v.parse_abbreviations(spark.createDataFrame([(body, "x")], "body string, seq string"))
    out = joins.expand_abbreviations(spark.createDataFrame([(" CKD ",), ("no",)], "name string"), ab)
    assert rows(out) == [(" CKD ", ["kidney", "Gout"]), ("no", ["no"])]
    know = kn.Knowledge.of(v.seed_entries(spark), ab)
    out = know.analyze(spark.createDataFrame([("ckd in mice",)], "t string"), "t").first()
    assert "Gout" in out["diseases"] and "Chronic kidney disease" in out["diseases"]


def test_readers_on_files(spark, tmp_path):
    (tmp_path / "geo").mkdir()
    item = {"accession": "GSE12", "title": "T", "n_samples": "7", "pubmedids": ["1"], "suppfile": "TXT"}
    (tmp_path / "geo/a.json").write_text(json.dumps({"result": {"uids": ["1", "2"], "1": item, "2": {"accession": "GPL9"}}}))
    (tmp_path / "geo/b.json").write_text(json.dumps({"result": {"uids": ["3"], "3": {**item, "title": "later"}}}))
    assert landed.read_geo_summaries(spark, str(tmp_path / "geo")).select("gse_id", "title", "sample_count").collect() == [("GSE12", "T", 7)]
    (tmp_path / "p.xml").write_text(
        '<SET><EXPERIMENT_PACKAGE><EXPERIMENT accession="SRX1"><DESIGN><LIBRARY_DESCRIPTOR><LIBRARY_STRATEGY>RNA-Seq</LIBRARY_STRATEGY>'
        '</LIBRARY_DESCRIPTOR></DESIGN><PLATFORM><ILLUMINA><INSTRUMENT_MODEL>HiSeq</INSTRUMENT_MODEL></ILLUMINA></PLATFORM></EXPERIMENT>'
        '<STUDY accession="SRP1" alias="GSE1234 x"><DESCRIPTOR><STUDY_TITLE>S</STUDY_TITLE></DESCRIPTOR></STUDY><RUN_SET><RUN accession="SRR1"/>'
        '<RUN accession="SRR2"/></RUN_SET></EXPERIMENT_PACKAGE><EXPERIMENT_PACKAGE><STUDY alias="no id"/></EXPERIMENT_PACKAGE></SET>')
    got = landed.read_sra_packages(spark, str(tmp_path / "p.xml")).select(
        "srp_id", "gse_ids", "library_strategy", "platform", "srr_ids", "sample_count").collect()
    assert got == [("SRP1", ["GSE1234"], "RNA-Seq", "HiSeq", ["SRR1", "SRR2"], 2)]
    (tmp_path / "pm.json").write_text(json.dumps({"result": {"uids": ["5"], "5": {"title": "On GSE12345", "authors": [{"name": "A"}]}}}))
    assert landed.read_pubmed_summaries(spark, str(tmp_path / "pm.json")).select("pmid", "abstract", "gse_ids").collect() == [
        ("5", "On GSE12345", ["GSE12345"])]


def test_export_kinds(spark, tmp_path):
    df = spark.createDataFrame([("GSE1", "t", ["SRP1", "SRP2"], 5, "public", True, "2024")],
                               "gse_id string, title string, sra_ids array<string>, sample_count int, access_type string, has_gse boolean, last_updated string")
    for kind in ("json", "tsv", "csv", "plain", "script"):
        sinks.export(df, str(tmp_path / kind), kind, ["gse_id", "sra_ids"], min_samples=3)
    assert [r[0] for r in spark.read.text(str(tmp_path / "tsv")).collect()] == ["gse_id\tsra_ids", "GSE1\tSRP1;SRP2"]
    assert len(spark.read.text(str(tmp_path / "script")).collect()) == 3
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "odd")


def test_search_source_order_decides(spark):
    geo = spark.createDataFrame([("GSE1", "gout single cell", "", "", 0)], "gse_id string, title string, abstract string, overall_design string, pos long")
    packages = spark.createDataFrame([("GSE1", "SRP1", "SRX1", "SRR1", "P", 1, 1, 0, "x", "o", "p"), ("GSE9", "SRP9", "SRX2", "SRR2", "P", 1, 1, 1, "gout", "o", "p")],
                                     "gse_id string, srp_id string, srx_id string, srr_id string, bioproject_id string, sample_count int, run_count int, pos long, "
                                     "title string, organism string, platform string")
    out = search.federated_search("gout single cell", geo, packages).select("gse_id", "match_source", "has_gse")
    assert rows(out) == [("GSE1", "geo", True), ("SRP9", "sra", False)]
    alone = search.federated_search("gout single cell", None, packages, authority=geo).select("gse_id", "match_score")
    assert rows(alone) == [("GSE1", 0.6), ("SRP9", 0.4)]


def test_topic_defaults(spark):
    df = spark.createDataFrame([(None, ["x"], None, [])], "diseases array<string>, organs array<string>, omics_types array<string>, species array<string>")
    assert from_dimensions(df).first()[:] == ([], ["x"], [], ["Homo sapiens"])


def test_core_plans(spark):
    import workload
    workload.load_all()
    sf = "/root/testdata/sf0.001"
    for name in ("p3_view_conversion", "c12_rank", "c1_federated_search", "d8_study_rollup", "c4_sample_groups", "u1_upsert", "j1_topic_view", "c13_bio_rank"):
        plan = workload.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in plan, (name, bad)
    view = workload.QUERIES["p3_view_conversion"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in view and "HashJoin" not in view and "MergeJoin" not in view
    plan = workload.QUERIES["d3_availability_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_one_row_per_key_after_changes(spark):
    from lodecat.operators import store
    stored = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    twice = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "3"), ("c", "3")], "k string, v string")
    assert rows(store.insert_or_replace(stored, twice, "k")) == [("a", "2"), ("b", "y"), ("c", "3")]
    assert rows(store.update_fields(stored, twice, "k", ["v"])) == [("a", "2"), ("b", "y")]
    assert rows(joins.override(stored, twice, ["k"], "v")) == [("a", "2"), ("b", "y")]


def test_long_chain_and_two_parents(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(100)] + [("n0", "n2"), ("n100", "n0")]
    edges = spark.createDataFrame(links, "child string, parent string")
    up = joins.ancestors(spark.createDataFrame([("n0",)], "node string"), edges)
    assert up.count() == 100 and up.filter("relative = 'n2'").first()["depth"] == 1


def test_chain_of_a_hundred_levels_takes_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(joins, "cut_lineage", lambda df, own=joins.cut_lineage: cuts.append(1) or own(df))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)] + [(None, "n3"), ("n5", None)], "child string, parent string")
    nodes = spark.createDataFrame([("n0",), ("n90",), ("n90",), (None,), ("unknown",)], "node string")
    got = {(r["node"], r["relative"]): r["depth"] for r in joins.ancestors(nodes, edges).collect()}
    assert got == {(f"n{a}", f"n{i}"): i - a for a in (0, 90) for i in range(a + 1, 101)} and len(cuts) <= 8
    assert rows(joins.ancestors(nodes.filter("node = 'n0'"), edges, 3)) == [("n0", f"n{i}", i) for i in (1, 2, 3)]
    assert joins.descendants(nodes, edges).count() == 90
    assert joins.ancestors(nodes, edges.limit(0)).count() == 0


def test_relatives_equal_plain_search(spark):
    r = random.Random(13)
    links = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(55)}
    plain = {}
    for start in {a for a, _ in links}:
        front, depth, seen = {start}, 0, {start: 0}
        while front:
            depth += 1
            front = {b for a, b in links if a in front} - set(seen)
            seen |= dict.fromkeys(front, depth)
        plain |= {(start, n): d for n, d in seen.items() if d}
    edges = spark.createDataFrame(sorted(links), "child string, parent string")
    nodes = edges.select(F.col("child").alias("node"))
    for deepest in (None, 1, 3):
        got = {(x["node"], x["relative"]): x["depth"] for x in joins.ancestors(nodes, edges, deepest).collect()}
        assert got == {k: d for k, d in plain.items() if deepest is None or d <= deepest}


def test_alias_parents_go_on(spark):
    names = spark.createDataFrame([("renal", "Kidney", 1), ("kidney", "Kidney", 2), ("renal", "Other", 3)], "term string, canonical string, pos int")
    edges = spark.createDataFrame([(" RENAL", "Nephron"), ("Body", "kidney"), ("Nephron", "Tubule")], "parent string, child string")
    up = joins.ancestors(spark.createDataFrame([("Tubule",)], "node string"), joins.resolved_edges(edges, names))
    assert rows(up) == [("Tubule", "Body", 3), ("Tubule", "Kidney", 2), ("Tubule", "Nephron", 1)]


def test_review_write_sets_note_time_and_log(spark):
    edges = spark.createDataFrame(
        [(1, "T1", "g1", "pending", "old", None), (2, "T1", "g2", "pending", "old", None)],
        "edge_id long, topic_id string, gse_id string, review_status string, review_note string, reviewed_at timestamp")
    done = spark.createDataFrame(
        [("9", "T1", "g1", "mark", "pending", "approved", "first", True),
         ("10", "T1", "g1", "mark", "pending", "deleted", "", True),
         ("11", "T1", "g2", "mark", "", "wrong", "x", False)],
        "action_id string, topic_id string, gse_id string, action string, old_status string, new_status string, note string, success boolean")
    now = datetime(2025, 1, 2)
    out = {r.edge_id: r for r in update_status(edges, done, now).collect()}
    assert (out[1].review_status, out[1].review_note, out[1].reviewed_at) == ("deleted", "old", now)
    assert (out[2].review_status, out[2].review_note, out[2].reviewed_at) == ("pending", "old", None)
    assert sorted((r.log_id, r.new_status) for r in log_rows(done, now).collect()) == [("10", "deleted"), ("9", "approved")]


def test_one_head_per_report_key(spark):
    kind = "report_id string, query_hash string, mode string, sources string"
    stored = spark.createDataFrame([("r0", "q", "m", "s")], kind)
    new = spark.createDataFrame([("r1", "q", "m", "s"), ("r2", "q", "m", "s"), ("r3", "p", "m", "s"), ("r4", "p", "m", "s")], kind)
    items = lambda *ids: spark.createDataFrame([(i, "of " + i) for i in ids], "report_id string, item string")
    heads, kept = store.save_reports(stored, items("r0"), new, items("r1", "r2", "r3", "r4"))
    assert sorted(r.report_id for r in heads.collect()) == ["r0", "r4"]
    assert sorted(tuple(r) for r in kept.collect()) == [("r0", "of r2"), ("r4", "of r4")]


def test_fill_missing_keeps_one_row_per_key(spark):
    have = spark.createDataFrame([("a", ""), ("b", "x")], "gse_id string, organism string")
    source = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "w")], "gse_id string, organism string")
    assert sorted(tuple(r) for r in joins.fill_missing(have, source, "gse_id", text=["organism"]).collect()) == [("a", "v"), ("b", "x")]


def test_expiry_by_time(spark):
    at = spark.sql("SELECT 1 AS k, current_timestamp() AS t UNION ALL SELECT 2, current_timestamp() - INTERVAL 3 HOURS UNION ALL SELECT 3, NULL")
    assert sorted(r.k for r in jobs.expire_stream(at, "t", 1.5).collect()) == [1, 3]
    fixed = spark.sql("SELECT 1 AS k, timestamp'2025-01-01 00:00:00' AS t UNION ALL SELECT 2, timestamp'2024-12-31 21:00:00'")
    assert [r.k for r in jobs.expire_stream(fixed, "t", 2.0, datetime(2025, 1, 1, 1)).collect()] == [1]
