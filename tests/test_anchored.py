"""Matching by rarest units against plain versions and the forms inside the row."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecat.functions import text as t
from lodecat.operators import anchored, store
from lodecat.operators.matching import match_all
from lodecat.operators.order import one_per_key
from lodecat.plans import inference
from lodecat.plans.queries import query_tokens
from lodecat.sources.vocabulary import seed_entries, vocab_terms
from workload.derived import table

SF = "/root/testdata/sf0.001"
WORDS = ["ab", "cd", "abc", "x", "gout", "rna", "seq", "é", "cell", "\U0001f600"]
LONG = "ab cd-" * 40_000


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    own = [(i, " ".join(r.choice(WORDS) + r.choice(["", "-", "-seq", ".", ", "]) for _ in range(r.randint(0, 40)))) for i in range(150)]
    return [*own, (900, None), (901, ""), (902, LONG), (903, "Gout  RNA,seq")]


@pytest.fixture(scope="module")
def terms():
    r = random.Random(2)
    made = {r.choice(WORDS) + r.choice(["", " ", "-"]) + r.choice(WORDS) for _ in range(40)}
    return sorted(made | {"a", "é", "gout", "ab " * 60 + "ab", "nowhere", "cd-ab cd"})


def one(spark, terms):
    return spark.createDataFrame([(x,) for x in terms], "term string")


def runs(x):
    return [y for y in re.split(r"(?<=\w)(?=\W)|(?<=\W)(?=\w)", x) if y]


def test_substrings_equal_contains(spark, texts, terms):
    df = spark.createDataFrame(texts, "id long, t string")
    got = {tuple(x) for x in anchored.substring_hits(df, "id", F.col("t"), one(spark, [*terms, ""])).collect()}
    assert got == {(i, x) for i, s in texts for x in [*terms, ""] if x in (s or "")}
    assert anchored.substring_hits(df, "id", F.col("t"), one(spark, [])).count() == 0
    assert anchored.substring_hits(df, "id", F.col("t"), one(spark, [""])).count() == len(texts)


def test_words_equal_runs(spark, texts, terms):
    df = spark.createDataFrame(texts, "id long, t string")
    want = set()
    for i, s in texts:
        own = runs(re.sub(r"\s+", " ", (s or "").lower()).strip())
        for x in terms:
            sought = runs(x)
            want |= {(i, x, p, len(sought)) for p in range(len(own) - len(sought) + 1) if own[p:p + len(sought)] == sought}
    assert {tuple(x) for x in anchored.word_hits(df, "id", F.col("t"), one(spark, terms)).collect()} == want
    assert anchored.word_hits(df.limit(0), "id", F.col("t"), one(spark, terms)).count() == 0


def test_phrase_tokens_equal_pattern(spark, texts, terms):
    phrases = [x for x in terms if x == x.strip()] + ["ab cd gout", "cell ab", "gout rna", "rna seq ab cd x"]
    df = spark.createDataFrame(texts, "id long, t string").filter("id <> 902")
    want = {x[0]: x[1] for x in df.select("id", query_tokens(F.col("t"), phrases)).collect()}
    assert {x["id"]: x["o"] for x in anchored.phrase_tokens(df, "id", F.col("t"), one(spark, phrases), "o").collect()} == want
    assert anchored.phrase_tokens(df, "id", F.col("t"), one(spark, []), "o").count() == len(texts) - 1


def test_classes_equal_forms_inside_the_row(spark, texts, terms):
    r = random.Random(3)
    listed = [(r.choice("ABCDE"), x, k) for k, x in enumerate(r.sample(terms, len(terms)))]
    df = spark.createDataFrame(texts, "id long, t string")
    vocab = spark.createDataFrame(listed, "name string, term string, pos int")
    classes = {}
    for name, x, _ in listed:
        classes.setdefault(name, []).append(x)
    low = t.blank(F.col("t"))
    inline = {"first": t.first_class(low, list(classes.items())), "longest": t.longest_alias(low, {x: n for n, x, _ in listed}),
              "all": t.all_classes(low, list(classes.items()))}
    for rule, column in inline.items():
        got = {x["id"]: x["c"] for x in anchored.with_classes(df, "id", F.col("t"), vocab, rule, "c").collect()}
        assert got == {x[0]: x[1] for x in df.select("id", column).collect()}, rule


def test_inference_from_a_table_equals_lists(spark):
    vocab = vocab_terms(seed_entries(spark), matching_only=True)
    rows = table(spark, SF, "datasets").withColumn("_t", t.squash(t.join_text(F.col("title"), F.col("abstract"), F.col("overall_design"))))
    lists, held = inference.Vocabularies.of(vocab), inference.Vocabularies.of(vocab, limit=1)
    assert isinstance(held, inference.VocabularyTable) and not isinstance(lists, inference.VocabularyTable)
    fields = ["gse_id", *[f"i_{x}" for x in ("disease", "disease_weight", "organ", "organ_weight", "assay", "assay_weight", "granularity", "granularity_weight")]]
    both = [sorted(map(tuple, inference.infer_fields(rows, F.col("_t"), v).select(fields).collect())) for v in (lists, held)]
    assert both[0] == both[1] and any(r[1] for r in both[0])


def test_few_places_reach_a_shuffle(spark):
    """The places that leave the row fall at least tenfold against all word sequences."""
    r = random.Random(4)
    common = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(common) for _ in range(300)) + (f" rare{i} word1" if i % 4 == 0 else "")) for i in range(80)]
    df = spark.createDataFrame(docs, "id long, t string")
    found = [f"rare{i} word1" for i in range(0, 80, 4)]
    vocab = one(spark, found).select("term", F.col("term").alias("canonical"), F.lit(1.0).alias("weight"), F.lit("").alias("granularity"), F.lit(1).alias("pos"))
    hits = match_all(df, "id", F.col("t"), vocab)
    assert sorted((x["id"], x["term"]) for x in hits.collect()) == [(i, f"rare{i} word1") for i in range(0, 80, 4)]
    units = df.select("id", F.explode(F.split("t", anchored.RUNS)).alias("u"))
    filed = spark.createDataFrame([(f"rare{i}",) for i in range(0, 80, 4)], "unit string")
    kept = units.filter(anchored.may_hold(filed, "unit")(F.col("u"))).count()
    assert 20 <= kept < units.count() / 100
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# store changes on rows with maps --------------------------------------------------------------
def test_rows_with_maps_and_repeats(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("m", T.MapType(T.StringType(), T.StringType()))])
    rows = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 1, {"x": "2"}), ("b", None, None)], schema)
    assert {r["k"]: r["m"] for r in one_per_key(rows, ["k"]).collect()} == {"a": {"x": "2"}, "b": None}
    stored = spark.createDataFrame([("a", 0, {"x": "0"}), ("c", 5, {})], schema)
    assert sorted((r["k"], r["n"]) for r in store.insert_or_replace(stored, rows, "k").collect()) == [("a", 1), ("b", None), ("c", 5)]
    assert sorted((r["k"], r["n"]) for r in store.insert_new(stored, rows, "k").collect()) == [("a", 0), ("b", None), ("c", 5)]
    assert {r["k"]: r["m"] for r in store.update_fields(stored, rows, "k", ["m"]).collect()} == {"a": {"x": "2"}, "c": {}}


def test_changes_of_a_repeated_key_count_once(spark):
    old = spark.createDataFrame([("a", "h1", 3)], "gse_id string, metadata_hash string, version int")
    new = spark.createDataFrame([("a", "h1", 0, 1), ("a", "h2", 0, 2), ("b", "h", 0, 1), ("b", "h", 0, 1)], "gse_id string, metadata_hash string, version int, nth int")
    got = store.detect_changes(old, new, order=[F.col("nth")]).select("gse_id", "change", "version").collect()
    assert sorted(map(tuple, got)) == [("a", "changed", 4), ("b", "new", 1)]
