"""Sketches (7) against plain sets at all lengths; site strengths and posteriors (9) against plain sums."""

import random

import numpy as np
import pytest

pytest.importorskip("lodecat.llm")

from pyspark.sql import functions as F  # noqa: E402

from lodecat.llm import quality, sketch  # noqa: E402

LIMIT = -(1 << 63) + (1 << 62)


def test_sketches_merge_and_contain_at_all_lengths(spark):
    r = random.Random(7)
    rows = []
    for i in range(120):
        long = [f"w{r.randint(0, 10 ** 6)}" for _ in range(r.choice([5, 6, 8, 20, 200]))]
        at = r.randint(0, len(long) - 5)
        rows.append((i, " ".join(long), " ".join(long[at:at + r.choice([5, 8])])))
    rows += [(200, "", ""), (201, "one two", "one two"), (202, "a b c d e", " "), (203, " ", "a b c d e f")]
    docs = spark.createDataFrame(rows, "id long, a string, b string")
    # every hash is below a fraction of one: the plain sets of shingle hashes
    full = {x["id"]: (set(x["a"]), set(x["b"])) for x in docs.select(
        "id", sketch.sketch(F.col("a"), fraction=1.0).getField("kept").alias("a"), sketch.sketch(F.col("b"), fraction=1.0).getField("kept").alias("b")).collect()}
    made = docs.select("id", sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    got = made.select("*", sketch.likeness(F.col("a"), F.col("b")).alias("like"), sketch.containment(F.col("b"), F.col("a")).alias("inside"),
                      sketch.fingerprint_likeness(F.col("a"), F.col("b")).alias("near"), sketch.printed(F.col("b")).alias("print")).collect()
    without = 0
    for x in got:
        a, b = full[x["id"]]
        low_a, low_b = ({h for h in s if h < LIMIT} for s in (a, b))
        assert x["a"]["kept"] == sorted(low_a) and x["b"]["kept"] == sorted(low_b) and x["a"]["least"] == min(a, default=None)
        like = 1.0 if not a and not b else len(low_a & low_b) / len(low_a | low_b) if low_a | low_b else None
        inside = 1.0 if not b else len(low_b & low_a) / len(low_b) if low_b else None
        without += inside is None
        assert x["like"] == like and x["inside"] == inside and (inside in (1.0, None) or x["id"] == 203)
        assert x["near"] == (like if like is not None else float(min(a, default=None) == min(b, default=None)))
        shown = sorted(low_b) or sorted(b)[:1]
        assert x["print"] == "".join(f"{h % (1 << 64):016x}" for h in shown)
    assert without > 5
    parts = made.select((F.col("id") % 7).alias("g"), F.explode(F.array("a", "b")).alias("s")).groupBy("g").agg(sketch.merged(F.col("s")).alias("m")).collect()
    for p in parts:
        union = set().union(*[full[i][k] for i in full if i % 7 == p["g"] for k in (0, 1)])
        assert p["m"]["kept"] == sorted(h for h in union if h < LIMIT) and p["m"]["least"] == min(union)


def plain_strength(groups):
    """Noise inside groups over the spread of groups inside their parents; a list of parents, each a list of groups."""
    every = [g for p in groups for g in p]
    n = sum(map(len, every))
    noise = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in every) / (n - len(every))
    q = share = rows = 0.0
    for p in groups:
        whole = np.concatenate(p)
        for g in p:
            q += len(g) * (np.mean(g) - whole.mean()) ** 2
            share += 1 - len(g) / len(whole)
            rows += len(g) * (1 - len(g) / len(whole))
    between = (q - noise * share) / rows
    return min(1e6, max(1.0, noise / between)) if between > 1e-12 else 1e6


@pytest.mark.parametrize("apart", [0.0, 0.1])
def test_path_strength_is_measured_inside_hosts(spark, apart):
    r = np.random.default_rng(9)
    rows = [(f"h{h}", f"h{h}/{p}", float(np.clip((0.2 if h % 2 else 0.8) + apart * (p - 1.5) + r.normal(0, 0.05), 0, 1)))
            for h in range(20) for p in range(4) for _ in range(int(r.integers(2, 40)))] + [("", "", 0.5)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = sites.collect()
    tree = {}
    for h, p, e in rows:
        tree.setdefault(h, {}).setdefault(p, []).append(e)
    by_path = plain_strength([list(ps.values()) for ps in tree.values()])
    by_host = plain_strength([[sum(ps.values(), []) for ps in tree.values()]])
    assert np.isclose(mean, np.mean([e for *_, e in rows])) and len(got) == 81
    for x in got:
        own, host = tree[x["host"]][x["path"]], sum(tree[x["host"]].values(), [])
        assert np.isclose(x["by_path"], by_path, rtol=1e-6) and np.isclose(x["by_host"], by_host, rtol=1e-6)
        host_mean = (sum(host) + by_host * mean) / (len(host) + by_host)
        assert np.isclose(x["host_mean"], host_mean) and np.isclose(x["path_mean"], (sum(own) + by_path * host_mean) / (len(own) + by_path))
    assert by_host < 2 and (by_path > 50 if not apart else by_path < 5)


def test_judged_rows_equal_plain_posteriors(spark):
    texts = ["The plan of the town was drawn in spring.", "BUY NOW $$$ %%% !!!", "", None, "a"] * 12
    rows = [(i if i % 5 else None, t, (None, "x", "y")[i % 3], ("p", None)[i % 2], "own") for i, t in enumerate(texts)] + [(999, "alone here", "z", "q", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, s string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0 or i % 5 > 3), int(i % 5 == 1)) for i in range(60)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.judge(docs, model, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows) and model
    site = {}
    for x in got:
        site.setdefault(x["host"], {}).setdefault(x["path"], []).append(x["evidence"])
    everything = [e for ps in site.values() for es in ps.values() for e in es]
    by_path, by_host = plain_strength([list(ps.values()) for ps in site.values()]), plain_strength([[sum(ps.values(), []) for ps in site.values()]])

    def odds(p):
        p = min(max(p, 1e-9), 1 - 1e-9)
        return np.log(p / (1 - p))
    for x in got:
        own, host, e = site[x["host"]][x["path"]], sum(site[x["host"]].values(), []), x["evidence"]
        assert np.isclose(e, model.evidence([x["row"]["text"] or ""])[0])
        parent = (sum(host) - e + by_host * np.mean(everything)) / (len(host) - 1 + by_host)
        others = (sum(own) - e + by_path * parent) / (len(own) - 1 + by_path)
        want = 1 / (1 + np.exp(-(odds(e) + odds(others) - odds(model.rate))))
        assert np.isclose(x["posterior"], want, atol=1e-6) and x["keep"] == (x["posterior"] >= 0.5) and x["row"]["s"] == "own"
    assert quality.judge(docs.limit(0), model, F.col("source"), F.col("lang")).count() == 0
