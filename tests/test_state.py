"""Streams with keyed state: late actions, undo, one busy pair, moving clocks."""

import random
from datetime import datetime, timedelta

from lodecat.operators.review import review_state
from lodecat.session import run_folder
from lodecat.streaming import state

LOG = "log_id long, topic_id string, gse_id string, action string, new_status string, acted_at timestamp"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one_by_one(spark, parts, schema):
    """A stream that brings one part per batch, in the given order."""
    folder = run_folder(spark, "t")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/n={i}")
    return folder, (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                    .parquet(f"{folder}/in/n=*"))


def plain(actions):
    stack = []
    for kind, status in actions:
        if kind != "undo":
            stack.append(status)
        elif stack:
            stack.pop()
    return stack[-1] if stack else "pending"


def test_runs_join_like_one():
    rng = random.Random(1)
    for _ in range(300):
        log = [(rng.random() < 0.5, str(i)) for i in range(rng.randrange(12))]
        at = rng.randrange(len(log) + 1)
        (p, s), (q, t) = state.reduce_actions(log[:at]), state.reduce_actions(log[at:])
        left = s[:max(0, len(s) - q)]
        assert state.reduce_actions(log) == (p + max(0, q - len(s)), left + t)


def test_review_in_any_order(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    data = [(i, "T", "hot" if rng.random() < 0.4 else f"G{rng.randrange(25)}", rng.choice(["mark", "undo", "mark", "undo", "approve"]),
             rng.choice(["approved", "deleted", "irrelevant"]), start + timedelta(minutes=rng.randrange(20000))) for i in range(700)]
    rng.shuffle(data)  # most actions come late
    folder, stream = one_by_one(spark, [data[i::4] for i in range(4)], LOG)
    state.keep_review(stream, folder + "/out", folder + "/state", "6 hours", None).awaitTermination()
    per = {}
    for d in sorted(data, key=lambda d: (d[5], d[0])):
        per.setdefault((d[1], d[2]), []).append((d[3], d[4]))
    got = rows(state.read_review(spark, folder + "/out"))
    assert got == sorted((*k, plain(a)) for k, a in per.items())
    assert got == rows(review_state(spark.createDataFrame(data, LOG)))


def test_review_writes_touched_spans_alone(spark):
    start = datetime(2024, 1, 1)
    first = [(i, "T", f"G{i % 50}", "mark", "approved", start + timedelta(hours=i)) for i in range(400)]
    late = [(900, "T", "G3", "undo", "", start + timedelta(hours=3, minutes=1)), (901, None, None, "mark", "deleted", None), (None, None, None, "mark", "approved", None)]
    folder, stream = one_by_one(spark, [first, late], LOG)
    state.keep_review(stream, folder + "/out", folder + "/state", "1 hour", None).awaitTermination()
    assert spark.read.parquet(folder + "/out").groupBy("batch").count().orderBy("batch").collect()[1]["count"] == 2
    got = dict(((r[0], r[1]), r[2]) for r in state.read_review(spark, folder + "/out").collect())
    assert got[("T", "G3")] == "approved" and got[(None, None)] == "deleted" and len(got) == 51


def test_expired_keys_leave_as_deletions(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    parts = [[("a", day(0)), ("b", day(1)), ("n", None)],
             [("a", day(5)), ("c", day(6)), ("n", day(0))],
             [("d", day(9)), ("late", day(0))],
             [("e", day(12)), ("e", day(11))]]
    folder, stream = one_by_one(spark, parts, "k string, t timestamp")
    state.keep_unexpired(stream, "k", "t", 96, folder + "/out", folder + "/state", None).awaitTermination()
    seen = rows(spark.read.parquet(folder + "/out").select("key", "expired").distinct())
    assert [k for k, gone in seen if gone] == ["a", "b", "c"]  # "late" was dead on arrival
    got = {r.key: r.expired for r in state.read_keys(spark, folder + "/out").collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": False, "n": False}
    again = rows(spark.read.parquet(folder + "/out").filter("key = 'a'").select("expired"))
    assert again == [(False,), (False,), (True,)]  # kept alive by its second row, deleted once
