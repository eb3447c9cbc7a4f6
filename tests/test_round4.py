"""Findings of the fourth review, on tables that show them."""

import pytest
from pyspark.sql import functions as F

from tests.test_round3 import SF, tables, verdict


@pytest.mark.parametrize("name", ["s3_pubmed_files", "s3_pubmed_summaries"])
def test_landed_abstracts_stay_as_they_are(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = F.when(F.col("doc_id") % 10 == 1, "").when(F.col("doc_id") % 10 == 3, F.lit(None)).when(F.col("doc_id") == 5, F.repeat(F.lit("ab "), 7_000_000)).otherwise(F.col("text"))
    odd = docs.withColumn("text", text).withColumn("doc_id", F.when(F.col("doc_id") == 7, F.lit(-7)).otherwise(F.col("doc_id")))
    assert verdict(spark, tables(spark, tmp_path, documents=odd), name).startswith(f"ok {docs.count()} ")


@pytest.mark.parametrize("name", ["j13_alias_parents", "j13_hierarchy"])
def test_names_are_broadcast_by_measured_size(spark, monkeypatch, name):
    import workload
    from lodecat.operators import joins
    plans = []

    def run(df):
        got = df.select("*")
        got.collect()
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(joins, "cut_lineage", lambda df, own=joins.cut_lineage: own(run(df)))
    monkeypatch.setattr(joins, "FEW_NAMES", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "150KB")  # the files are estimated smaller, the names take more
    try:
        run(workload.QUERIES[name](spark, "/root/testdata/sf0.1"))
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "150KB"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 4 and not any("BroadcastExchange" in p for p in plans)


def generated(df):
    """Rows that a query's generators put out, most of one of them."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], [0]
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            plan.append(p.plan())
        if name == "GenerateExec":
            found.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        plan += [kids.apply(k) for k in range(kids.size())]
    return max(found)


@pytest.mark.parametrize("rule", ["all", "longest", "first"])
@pytest.mark.parametrize("odd", ["", "é", "-", "\U0001f600"])
def test_places_are_runs_with_room_for_a_term(spark, rule, odd):
    import random
    from lodecat.operators import anchored
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    terms = [word(r.choice((9, 11))) + odd for _ in range(300)]
    vocab = [(x[:1], x, k) for k, x in enumerate(terms)]
    own = lambda: r.choice((word(1), "")) + r.choice(terms) + r.choice((word(2), "", "."))
    texts = [" ".join(own() if r.random() < 0.1 else word(r.randint(1, 5)) for _ in range(300)) for _ in range(40)]
    texts += ["", "\x00".join(terms[:3]), ("a" + (odd or "b")) * 50_000 + terms[5], f"{terms[7]} x " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = anchored.with_classes(df, "id", F.col("t"), spark.createDataFrame(vocab, "name string, term string, pos int"), rule, "c")
    first = {}
    for name, _, k in vocab:
        first.setdefault(name, k)

    def want(text):
        hits = [v for v in vocab if v[1] in text]
        if rule == "all":
            return sorted({v[0] for v in hits}, key=first.get)
        return min(hits, key=lambda v: (first[v[0]], v[2]) if rule == "first" else (-len(v[1]), v[2]))[0] if hits else None

    assert {x["id"]: x["c"] for x in found.collect()} == {i: want(x) for i, x in enumerate(texts)}
    few = found.filter("id < 40")  # before, each letter was a place
    assert generated(few) < sum(map(len, texts[:40])) / 2
