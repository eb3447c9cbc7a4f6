"""Components against plain groups, and what their rounds and checkpoints leave on disk."""

import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lodecat.llm import common  # noqa: E402
from lodecat.session import CLEANUP, cut_lineage  # noqa: E402


@pytest.fixture
def dealt(spark):
    """Rows in many partitions, however few they are: else one task joins all."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def graphs():
    r = random.Random(5)
    path = list(range(300))
    r.shuffle(path)
    return {"empty": [], "loops": [(3, 3), (4, 4)], "path": list(zip(path, path[1:])), "least hub": [(5, i) for i in range(6, 300)],
            "largest hub": [(i, 10**6) for i in range(300)], "random": [(r.randrange(400), r.randrange(400)) for _ in range(300)],
            "cycles": [(i, i // 20 * 20 + (i + 1) % 20) for i in range(200)] * 2,
            "far ids": [(r.randrange(-2**63, 2**63), -2**63) for _ in range(20)] + [(-5, 7), (7, 9), (2**63 - 1, 9)]}


@pytest.mark.parametrize("kind", graphs())
@pytest.mark.parametrize("rows", [common.LOOKUP_ROWS, -1])
def test_components_equal_plain_groups(dealt, monkeypatch, kind, rows):
    monkeypatch.setattr(common, "LOOKUP_ROWS", rows)
    links = graphs()[kind]
    random.Random(1).shuffle(links)
    found = common.components(dealt.createDataFrame(links, "a long, b long").repartition(5)).collect()
    want = brute.groups(sorted({x for p in links for x in p}), links)
    got = {x["node"]: x["root"] for x in found}
    assert len(got) == len(found) and got == {x: root for x, root in want.items() if x != root}


def test_a_round_of_components_shuffles_twice(dealt, monkeypatch):
    plans = []
    monkeypatch.setattr(common, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    common.components(dealt.createDataFrame(graphs()["path"], "a long, b long").repartition(5))
    assert len(plans) > 2 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans[1:])


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (held.apply(k).getName() for k in range(held.size())) if n.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    done = cut_lineage(spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    assert sorted(map(tuple, done.collect())) == [(k, len(range(k, 1000, 7))) for k in range(7)]
