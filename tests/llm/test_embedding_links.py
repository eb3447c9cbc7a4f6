"""Operator 4 on planted links, with shared and missing ids, against every pair and against SQL."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import types as T

from lodecat.llm import itq
from lodecat.llm.queries import ORACLES

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       *[T.StructField(c, T.StringType()) for c in ("rep", "low", "cell", "links", "v", "group")]])


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], *["own"] * 6) for i, v in rows], SCHEMA)


def every_pair(rows):
    """(id, links, component) of each row: rows are vectors of their own."""
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    out, ids = [], [i for i, _ in rows]
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if int(j) not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        low = min((ids[j] for j in seen), key=lambda i: (i is not None, i))
        out.append((ids[k], int(near[k].sum()) - 1, low))
    return sorted(out, key=repr)


def planted(r, n=120):
    rows = []
    for k in range(n):
        base = r.normal(size=64)
        rows += [(1000 * k + c, base + r.normal(size=64) * 0.03) for c in range(r.integers(1, 5))]
    return rows


def test_links_of_shared_and_missing_ids(spark):
    r = np.random.default_rng(6)
    a, b, c = r.normal(size=(3, 64))
    rows = [(None, a), (None, b), (1, a + 0.001), (2, a - 0.001), (3, b + 0.001),
            (7, c), (7, -c), (8, c * 1.001), (9, -c * 1.002), (9, -c * 1.002)]
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in itq.near_duplicates(table(spark, rows)).collect()), key=repr)
    assert got == every_pair(rows)


def test_planted_links_equal_every_pair_and_sql(spark):
    rows = planted(np.random.default_rng(7))
    got = itq.near_duplicates(table(spark, rows)).collect()
    mine = sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in got), key=repr)
    assert mine == every_pair(rows) and sum(n for _, n, _ in mine) > 200
    embeddings = pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [np.asarray(v, np.float32) for _, v in rows]})  # noqa: F841
    sql = duckdb.sql(ORACLES["op4_itq_near_duplicates"]).fetchall()
    assert sorted(map(tuple, sql)) == sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got)
