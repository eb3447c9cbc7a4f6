"""The pipeline's near-copy stage against plain sets of five-word shingles."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lodecat.llm import likeness  # noqa: E402


def roots(texts):
    sets = [brute.shingles(t) for t in texts]
    return brute.groups(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if brute.alike(sets[a], sets[b])])


def test_stage_links_all_pairs_of_likeness(spark):
    r = random.Random(11)
    line = " one line that very many of the documents here hold in them "
    texts = []
    for _ in range(60):
        own = [f"w{r.randrange(5000)}" for _ in range(r.choice([3, 5, 6, 9, 40, 150]))]
        for _ in range(r.randint(1, 6)):
            copy = list(own)
            for _ in range(r.randint(0, max(1, len(own) // 30))):
                copy[r.randrange(len(copy))] = f"w{r.randrange(5000)}"
            texts.append(" ".join(copy) + (line if len(own) > 20 and r.random() < 0.5 else ""))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = roots(texts)
    got = {x["doc_id"] for x in corpus_pipeline.keep_one_of_near_copies(spark, rows, "").collect()}
    assert got == set(want.values()) and len(got) < len(texts)


def test_stage_keeps_unlike_rows_without_or_with_one_id(spark):
    texts = [" ".join(f"{p}{i}" for i in range(60)) for p in "abcdefg"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4] + " tail"), (6, texts[0] + " tail"),
            (7, texts[5]), (8, None), (9, ""), (10, texts[6])]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    held = sorted(((x["doc_id"] or 0), (x["text"] or "")[:2]) for x in got)
    assert held == [(0, "a0"), (0, "b0"), (0, "c0"), (5, "d0"), (5, "e0"), (7, "f0"), (8, ""), (10, "g0")]


def test_pipeline_keeps_one_of_each_group_of_its_own_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x["doc_id"], x["text"] or "") for x in docs.collect()]
    want = roots([t for _, t in rows])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[want[k]] = min(i, least.get(want[k], i))
    assert {x["doc_id"] for x in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()} == set(least.values())


def test_stage_takes_hard_cases(spark):
    long = " ".join(f"v{i % 977}" for i in range(120_000))
    rows = [(1, long, "own"), (2, long + " tail", "own"), (3, None, None), (4, "", "own"), (4, "", "other"), (5, "a b", "own"), (6, "A  b", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("mark", F.lit("own")).withColumn("cells", F.lit(1))
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5]
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs.limit(0), "").count() == 0
    again = corpus_pipeline.keep_one_of_near_copies(spark, docs.filter("doc_id = 4").union(docs.filter("doc_id = 4")), "").collect()
    assert len(again) == 1


def test_large_cells_are_dealt_and_filters_can_be_off(spark, monkeypatch):
    monkeypatch.setattr(likeness, "BLOCK_ROWS", 5)
    monkeypatch.setattr(likeness, "CHUNK", 3)
    r = random.Random(5)
    lines = [" ".join(f"l{k}w{i}" for i in range(7)) for k in range(9)]
    texts = [" ".join(r.sample(lines, r.randint(2, 5))) for _ in range(120)]  # every shingle is common
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = roots(texts)
    for bits in (None, likeness.BITS):
        got = {}
        for x in likeness.near_copies(rows, bits=bits).collect():
            got.setdefault(x["component"], []).append(x["doc_id"])
        assert {i: min(g) for g in got.values() for i in g} == want


def test_groups_of_copies_cost_no_square(spark, monkeypatch):
    r = random.Random(9)
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(300):  # many pairs are alike, many more are nearly so
        copy = list(base)
        for _ in range(r.randint(1, 4)):
            copy[r.randrange(150)] = f"w{r.randrange(10_000)}"
        texts.append(" ".join(copy))
    rows, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    alike = likeness._alike

    def counted(pairs, *more):
        asked.append(pairs.count())
        return alike(pairs, *more)
    monkeypatch.setattr(likeness, "_alike", counted)
    got = {}
    for x in likeness.near_copies(rows).collect():
        got.setdefault(x["component"], []).append(x["doc_id"])
    assert {i: min(g) for g in got.values() for i in g} == roots(texts)
    assert sum(asked) < 25 * len(texts), asked


def test_stage_asks_the_grid_of_fingerprints_first(spark, monkeypatch):
    base = [f"g{i}" for i in range(400)]
    texts = [" ".join([*base[:k], "other", *base[k:]]) for k in range(0, 400, 40)]
    rows, found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    grid = likeness.grid_links

    def held(*given):
        found.append(grid(*given).count())
        return grid(*given)
    monkeypatch.setattr(likeness, "grid_links", held)
    assert len({x["component"] for x in likeness.near_copies(rows).collect()}) == 1
    assert found[0] >= len(texts) - 1


def test_candidates_that_are_unlike_make_no_rows_of_pairs(spark, monkeypatch):
    r = random.Random(3)
    base, texts = [f"b{i}" for i in range(150)], []
    for k in range(240):  # some are alike; most share their rare shingles and are not quite alike
        copy = list(base)
        for _ in range(r.randint(5, 7) if k % 4 else 2):
            copy[r.randrange(150)] = f"w{r.randrange(10_000)}"
        texts.append(" ".join(copy))
    rows, made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    frame, given = type(rows), type(rows).mapInArrow

    def counted(df, run, schema, *more):
        out = given(df, run, schema, *more)
        if {"left", "right"} <= set(df.columns):
            made.append(out.count())
        return out
    want = roots(texts)
    for rows_of, shingles in ((likeness.BLOCK_ROWS, 1 << 17), (50, 3000)):
        monkeypatch.setattr(likeness, "BLOCK_ROWS", rows_of)
        monkeypatch.setattr(likeness, "BLOCK_SHINGLES", shingles, raising=False)
        with monkeypatch.context() as m:
            if rows_of > 50:
                m.setattr(frame, "mapInArrow", counted)
            got = {}
            for x in likeness.near_copies(rows).collect():
                got.setdefault(x["component"], []).append(x["doc_id"])
        assert {i: min(g) for g in got.values() for i in g} == want
    assert len(texts) < sum(made) < 25 * len(texts), made
