"""Landed files by path, lookups by any id, scorers, and reports of any length."""

import json

from pyspark.sql import functions as F

from lodecat.operators.joins import get_dataset, get_datasets
from lodecat.plans import reports
from lodecat.plans.ranking import no_scores, score_with
from lodecat.session import run_folder
from lodecat.sources import landed, vocabulary as v

c = F.col


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def land(spark, docs, lines):
    """The documents as files: one each, or all as lines of one file."""
    folder = run_folder(spark, "t")
    frame = spark.createDataFrame([(d, i) for i, d in enumerate(docs)], "d string, i int")
    n = 1 if lines else len(docs)
    frame.repartitionByRange(n, "i").sortWithinPartitions("i").select("d").write.text(folder)
    return folder


def test_samples_by_path(spark):
    docs = [json.dumps({"gse_id": f"GSE{i}", "samples": [
        {"accession": f"GSM{i}{k}", "title": "t", "sample_type": ["RNA"], "attributes": "tissue: lung"} for k in (1, 2)]}) for i in range(3)]
    whole = landed.read_samples(spark, land(spark, docs, False)).select("gse_id", "gsm_id", "place")
    lines = landed.read_samples(spark, land(spark, docs, True), lines=True).select("gse_id", "gsm_id", "place")
    assert rows(whole) == rows(lines) and len(rows(lines)) == 6


def test_first_series_of_a_file_stays(spark):
    item = lambda n, title: json.dumps({"result": {"uids": [n], n: {"accession": "GSE7", "title": title}}})
    folder = land(spark, [item("1", "first"), "", item("2", "second")] + [item("3", f"x{i}") for i in range(40)], True)
    assert [r.title for r in landed.read_geo_summaries(spark, folder, lines=True).collect()] == ["first"]


def test_views_and_lists_by_path(spark):
    got = landed.read_views(spark, land(spark, ['{"gse_id": "GSE1"}', "no json"], True), "gse_id string, sample_count int")
    assert rows(got) == [("", 0), ("GSE1", 0)]
    words = v.read_keyword_lists(spark, land(spark, ['{"d": ["a", "b"]}', '{"d": {"terms": ["c"]}}'], False), "d")
    assert sorted(r.word for r in words.collect()) == ["a", "b", "c"]
    short = v.read_abbreviations(spark, land(spark, ['{"abbreviations": {"ra": {"full_name": "R A", "search_terms": ["r"]}}}'], False))
    assert [(r.key, r.full_name, r.search_terms) for r in short.collect()] == [("RA", "R A", ["r"])]


def test_one_dataset_by_any_id(spark):
    stored = spark.createDataFrame([("GSE2", "b", ["SRP1", "GSE1"]), ("GSE1", "a", ["SRP1"]), ("GSE3", "c", None)],
                                   "gse_id string, title string, sra_ids array<string>")
    asked = spark.createDataFrame([("SRP1",), ("GSE1",), ("GSE3",), ("SRP9",), (None,), ("SRP1",)], "accession string")
    got = {r.accession: r.title for r in get_datasets(asked, stored).collect()}
    assert got == {"SRP1": "a", "GSE1": "a", "GSE3": "c"}
    for a in ("SRP1", "GSE1", "GSE3", "SRP9"):
        assert [r.title for r in get_dataset(stored, a).collect()] == [got[k] for k in [a] if k in got]


def test_scorer_answers_row_by_row_when_a_batch_fails(spark):
    def score(prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p + "!" for p in prompts]

    df = spark.createDataFrame([(str(i), "bad" if i == 5 else f"p{i}") for i in range(20)], "gse_id string, p string").coalesce(1)
    got = {r.gse_id: (r.text, r.error) for r in score_with(df, score, c("p"), 8).collect()}
    assert got.pop("5") == (None, "RuntimeError: no")
    assert got == {str(i): (f"p{i}!", None) for i in range(20) if i != 5}
    short = score_with(df, lambda prompts: prompts[:1], c("p"), 8).collect()
    assert [r.text for r in short] == [r.p for r in df.collect()]  # too few answers: asked one by one
    assert {(r.text, r.error) for r in score_with(df, no_scores, c("p")).collect()} == {(None, None)}
    assert score_with(df.limit(0), score, c("p")).count() == 0


def test_report_text_is_whole_and_in_order(spark):
    n = 3000
    table = spark.range(n).select(c("id").alias("k"), F.when(c("id") == 7, "a|b\nc").when(c("id") != 8, "x").alias("v"))
    lines = reports.report_lines(table.repartition(7), "All", ["k"])
    folder = run_folder(spark, "t")
    reports.write_report(lines, folder)
    parts = sorted(r[0] for r in spark.read.text(folder).select(F.input_file_name()).distinct().collect())
    text = [r.value for p in parts for r in spark.read.text(p).collect()]
    assert text[:4] == ["# All", "", "| k | v |", "|---|---|"] and len(text) == n + 4
    assert text[4:] == [f"| {i} | {'a\\|b c' if i == 7 else '' if i == 8 else 'x'} |" for i in range(n)]
    assert [r.line for r in reports.report_lines(table.limit(0), "None", ["k"]).orderBy("line_no").collect()][:1] == ["# None"]
