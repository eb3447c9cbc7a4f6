"""Text, score, parse and group functions on small cases and against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions import classify, groups, parse, score, text as t
from lodecat.functions.normalize import (
    dataset_key, display_key, normalize_condition, normalize_organ, normalize_platform, normalize_species,
)


def values(spark, rows, fn, schema="a string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(fn(F.col("a"))).collect()]


def relevance(spark, title, summary, single, query="gout single cell"):
    df = spark.createDataFrame([(title, summary, single)], "title string, summary string, single boolean")
    none = F.array().cast("array<string>")
    df = df.withColumns(score.text_keys(F.col("title"), F.col("summary"), none, F.lit(""), F.lit("")))
    return df.select(score.relevance(score.Query.of(query), F.col("single"))).first()[0]


def test_relevance_order(spark):
    both = relevance(spark, "Single-cell RNA-seq of gout patients", "PBMC of gout", True)
    bulk = relevance(spark, "Bulk RNA of gout patients", "gout flares", False)
    cells = relevance(spark, "scRNA-seq atlas of kidney", "", True)
    none = relevance(spark, "Leaf growth of maize", "", False)
    assert both >= 0.6 and both > bulk
    assert bulk < 0.20 and cells < 0.10 and none < 0.05


def test_relevance_of_word_that_strips_to_nothing(spark):
    assert score.Query.of("10x and OR gout").terms == ("x", "gout")
    assert score.Query.of("and or 123").terms == ()
    assert values(spark, ["abc"], lambda c: t.alnum_hit(c, ["--"])) == [True]


def test_contains_empty(spark):
    assert values(spark, ["abc", ""], lambda c: F.contains(c, F.lit(""))) == [True, True]


@pytest.mark.parametrize("text,want", [
    ("0.850", 0.85), ("0.750 (high)", 0.75), ("85", 0.85), ("0", 0.0), ("1.0", 1.0), (None, None),
    ("", None), ("no score here", None), ("1.5", 0.015), ("250", 1.0)])
def test_parse_score(spark, text, want):
    got = values(spark, [text], parse.parse_score)[0]
    assert got == want or got == pytest.approx(want)


def test_parse_answer_shapes(spark):
    got = values(spark, ['{"cell_count": "5K"}', '```json\n{"cell_count": "5K"}\n```', "no json", "", "[1, 2]",
                         'x {"cell_count": "5K", "sample_grouping": ""} y', '{"sample_grouping": "a\nb"}'],
                 parse.parse_answer)
    assert [r["cell_count"] for r in got] == ["5K", "5K", "NA", "NA", "NA", "5K", "NA"]
    assert got[2]["relevance_reason"] == "unreadable answer" and got[0]["relevance_reason"] == "-"
    assert got[6]["sample_grouping"] == "a b"


def test_cell_count(spark):
    texts = ["15,230 cells", "15230 cells", "850 cells", "2 million nuclei", "1.5 Million cells", "none", None]
    assert values(spark, texts, parse.cell_count) == ["15K", "15K", "850", "2M", "1M", None, None]


def test_accession_types(spark):
    ids = ["GSE1", "gsm22", "ERP5", "SRX1", "SRR2", "PRJNA3", "PRJEB4", "PRJDB5", "SAMN6", "ABC", ""]
    want = ["GSE", "GSM", "SRP", "SRX", "SRR", "PRJNA", "PRJEB", "PRJ", "BioSample", None, None]
    assert values(spark, ids, parse.accession_type) == want


def test_names(spark):
    assert values(spark, ["Human", "M.musculus", "Bos taurus", "Homo sapiens (human)", " odd ", None], normalize_species) == [
        "Homo sapiens", "Mus musculus", "Bos taurus", "Homo sapiens", "odd", ""]
    assert values(spark, ["HCC", "type 2 diabetes in mice", "rare"], normalize_condition) == [
        "hepatocellular carcinoma", "type 2 diabetes mellitus", "rare"]
    assert values(spark, ["Renal", "Toe"], normalize_organ) == ["kidney", "Toe"]
    assert values(spark, ["Illumina HiSeq 2500", "mine"], normalize_platform) == ["Illumina HiSeq", "mine"]
    df = spark.createDataFrame([("", "SRP1"), ("GSE1", "SRP2")], "g string, s string")
    key = dataset_key(F.col("g"), F.col("s"))
    assert [tuple(r) for r in df.select(key, display_key(key)).collect()] == [("SRP:SRP1", "SRP1"), ("GSE1", "GSE1")]


def test_single_cell_atac_is_reachable(spark):
    fn = lambda compat: lambda c: classify.data_type(c, F.lit(""), F.lit(""), compat)
    assert values(spark, ["scATAC-seq"], fn(False)) == ["scATAC-seq"]
    assert values(spark, ["scATAC-seq"], fn(True)) == ["ATAC-seq"]


def test_word_boundary_is_unicode(spark):
    hit = lambda c: F.size(t.phrases_at_boundaries(c, ["gout"]))
    assert values(spark, ["égout", "a gout b", "gouty", "(gout)"], hit) == [0, 1, 0, 1]


def test_phrase_hits_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "a b", "a b c", "b-c", "c", "b c", "d.e", "long word", "(x", "x)"]
    texts = ["".join(rng.choice("abcdx ( ) . - e") for _ in range(40)) for _ in range(200)]
    texts = [re.sub(r"\s+", " ", s).strip() for s in texts]
    got = values(spark, texts, lambda c: F.array_sort(t.phrase_hits(c, vocab)))
    for s, found in zip(texts, got):
        assert found == sorted(v for v in vocab if re.search(r"\b" + re.escape(v) + r"\b", s)), s


def test_distinct_ignoring_case(spark):
    df = spark.createDataFrame([(["A b", "a  B", "c", "C ", "d"],)], "a array<string>")
    assert df.select(t.distinct_ignoring_case(F.col("a"))).first()[0] == ["A b", "c", "d"]


def test_clean_query(spark):
    assert values(spark, ["“a” –\tb\x07c"], parse.clean_query) == ['"a" -bc']
    assert values(spark, ["", " ", "x" * 1001, "ok"], parse.query_error) == ["empty", "empty", "too long", None]


def test_attribute_lines_last_wins(spark):
    got = values(spark, ["Source Name: a\nno pair\nsource name: b: c"], parse.attribute_lines)
    assert got == [{"source_name": "b: c"}]


def test_group_names(spark):
    assert values(spark, ["GSM12_Con1", "treated_rep2", "A_b3"], groups.group_token) == ["con", "treated_rep", "a_b"]
    assert values(spark, ["con", "controlx", "a_b", ""], lambda c: groups.group_name(c)) == ["control", "control", "A_B", ""]


def test_scores_stay_in_range(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["gout", "single", "cell", "uric", "kidney", "10x"]) for _ in range(8)),) for _ in range(50)]
    for title, in rows[:10]:
        assert 0 <= relevance(spark, title, title, rng.random() > 0.5) <= 1


def test_bulk_patterns_in_upper_case_never_hit(spark):
    assert "RMA" in terms.BULK_FILES
    df = spark.createDataFrame([("RMA.txt",)], "n string")
    files = F.array(F.struct(F.col("n").alias("name"), F.lit("TXT").alias("type"), F.lit(1).cast("long").alias("size")))
    names = classify.file_names(files, "name", "type")
    assert df.select(classify.file_format(files, names, F.lit(""), F.lit(""))["is_bulk_by_files"]).first()[0] is False


def test_groups_come_from_the_first_match_that_names_one(spark):
    def found(design, samples=10):
        df = spark.createDataFrame([(design, samples)], "d string, n int")
        return [(g["name"], g["n"]) for g in df.select(groups.groups_from_text(F.lit(""), F.col("d"), F.col("n"))).first()[0]]
    assert found("of vs the; case vs control") == found("case vs control") and all(n == 0 for _, n in found("case vs control"))
    assert found("treated vs untreated; case vs control") == found("treated vs untreated")
    assert found("3 replicates of control, case and treated") == found("3 replicates of control") + found("case and treated")
    assert found("of vs the") == [("case", 5), ("control", 5)]
    assert found("") == [("case", 5), ("control", 5)]
