"""The rows of the mix (6) against a plain version, rows without ids, and the plan."""

import hashlib
import math
from collections import Counter

import pytest

pytest.importorskip("lodecat.llm")

from pyspark.sql import functions as F  # noqa: E402

from lodecat.llm import mixing  # noqa: E402


def plain(named, mix, sources, block_tokens, whole, seed=42):
    """(doc_id, source, tokens, pass, block, slot) of every row of the mix; ``named``: doc_id, source, tokens, two hashes."""
    def hash60(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    out, nth = [], Counter()
    rows = []
    for doc, source, tokens, m, k in named:
        rows.append((doc, source, tokens, m, k, nth[m, k]))
        nth[m, k] += 1
    for s, held in sources.items():
        if not held and not whole:
            continue
        w = (held / mix.tokens) ** mix.exponent / mix.total if held else 0.0
        budget = max(1, round(w * mix.budget))
        for p in range((budget - 1) // held + 1 if held else 1):
            at = p * held
            for h, (doc, _, tokens, m, k, n) in sorted(((hash60(seed, p, *r[3:]), r) for r in rows if r[1] == s), key=lambda x: (x[0], x[1][3:])):
                if at < budget or (whole and p == 0):
                    block = math.floor(min(at, budget - 1) / (w * block_tokens)) if w else 0
                    out.append((doc, s, tokens, p, block, hash60(seed, "slot", p, m, k, n)))
                at += tokens
    return out


@pytest.mark.parametrize("budget", [None, 1500, 7])
def test_mix_rows_equal_plain_rows(spark, budget):
    rows = [(None if i % 3 == 0 else i % 50, " ".join("w" for _ in range(i * 7 % 13)), ("a", "b", None, "a", "a", "wordless")[i % 6] if i % 11 else "a") for i in range(400)]
    rows = [(d, "" if s == "wordless" else t, s) for d, t, s in rows] + [(7, "same text here", "b")] * 40 + [(None, None, "a")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    named = mixing._marked(docs).select("row.*", "_m", "_k").collect()
    named = [(r["doc_id"], r["source"], len((r["text"] or "").split()), r["_m"], r["_k"]) for r in named]
    sources = Counter()
    for r in named:
        sources[r[1]] += r[2]
    got, mix = mixing.mix_sources(docs, budget=budget, block_tokens=100)
    got = Counter(tuple(r) for r in got.select("row.doc_id", "source", "tokens", "pass", "block", "slot").collect())
    assert got == Counter(plain(named, mix, sources, 100, budget is None))


def test_mix_of_rows_without_ids_spreads(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("a b "), "id").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix_sources(docs)[0].filter("row.doc_id is null").select("slot").distinct().count()
    assert got == docs.filter("doc_id is null").count()


def test_mix_takes_maps_and_clashing_names(spark):
    docs = spark.sql("""SELECT id AS doc_id, 'a b' AS text, 's' AS source, map('k', id) AS tags, 'own' AS slot, 'own' AS _m, 'own' AS row, 1 AS n, 2 AS nth
        FROM range(5) UNION ALL SELECT 3L, 'a b', 's', map('k', 3L), 'own', 'own', 'own', 1, 2""")
    got = mixing.mix_sources(docs)[0].select("row.*").collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3, 3, 4] and all(r["_m"] == r["slot"] == "own" and r["tags"] == {"k": r["doc_id"]} for r in got)
    assert mixing.mix_sources(docs.limit(0))[0].count() == 0


def test_mix_places_documents_without_their_texts(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a", "t")], "doc_id long, text string, source string")
    rows = mixing.entries(docs, F.col("source"), mixing.words(F.col("text")))
    assert set(rows.columns) == {"_m", "_k", "source", "tokens", "n", "nth"}
