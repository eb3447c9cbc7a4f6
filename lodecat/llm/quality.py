"""Quality classifier with hierarchical empirical Bayes over hosts and paths (9).

A small classifier gives each document the odds that it is fit for training (well formed, not
abusive), from style measures of the whole text and from words that labelled abusive texts share.
Means per path shrink toward their host, hosts toward the whole; how strongly is estimated from
the spread between groups.  A document's posterior odds are its evidence times its path's.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.llm.common import longs, lookup, map_rows

_UPPER, _DIGIT, _MARK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!%$&#*|@^~=+<>{}[]\\_"
_TRIM = ".,;:!?\"'()[]{}%$&#*|"
_WORD = re.compile(r"[^\W\d_]{3,}")
STYLE = ("words", "unique", "repeated", "upper_words", "upper", "digits", "marks", "marked_words", "word_length", "repeated_lines", "short")


def style(text: str) -> list[float]:
    """Measures of form; each is a share or a logarithm, so length matters little."""
    words = text.split()
    n, k = max(len(text), 1), max(len(words), 1)
    raw = text.encode()

    def share(letters: bytes) -> float:
        return (len(raw) - len(raw.translate(None, letters))) / n
    lines = text.split("\n")
    return [float(np.log1p(len(words))), len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:])) / k,
            sum(map(str.isupper, words)) / k, share(_UPPER), share(_DIGIT), share(_MARK),
            sum(w[-1] in "!%$&#*|" for w in words) / k, len(text) / k / 10, 1 - len(set(lines)) / len(lines), float(len(words) < 5)]


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    """Weights of two logistic models over standardised measures; ``words`` mark abuse."""
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    fit: tuple[float, ...]
    abusive: tuple[float, ...]
    words: frozenset[str]
    rate: float

    def evidence(self, held: Sequence[str]) -> np.ndarray:
        """Probability that each text is fit."""
        return self.of_rows(np.array([measures(t, self.words) for t in held], float).reshape(len(held), -1))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = (x - np.array(self.mean)) / np.array(self.scale)
        x = np.c_[np.ones(len(x)), x]
        return _logistic(x @ np.array(self.fit)) * (1 - _logistic(x @ np.array(self.abusive)))


def measures(text: str, words: frozenset[str]) -> list[float]:
    hits = len(words & distinct_words(text)) if words else 0
    return [*style(text), float(hits > 0), float(np.log1p(hits))]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, word_count: int = 500, least_docs: int = 5,
          least_ratio: float = 20.0, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> Model | None:
    """Fits the classifier on at most ``sample_rows`` labelled documents, taken by a hash of the id.

    That bound is what lets the label rows be broadcast and the measures, ``sample_rows`` times a
    dozen numbers, come to the driver.  Words that mark abuse are counted in Spark; at most
    ``word_count`` stay.  Labels without a value, and ids with labels that disagree, are left out.
    None if no labelled document is left or all are alike.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic").dropna()
    if held_out is not None:
        known = known.filter(~held_out)
    known = (known.groupBy("_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q"), F.min("toxic").alias("toxic"), F.max("toxic").alias("_t"))
             .filter("quality = _q and toxic = _t").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id", "quality", "toxic"))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = own.join(F.broadcast(known), "_id")  # at most sample_rows rows of 16 bytes

    def words_of(batch: pa.RecordBatch) -> dict:
        ws, ts = [], []
        for t, toxic in zip(batch.column("text").to_pylist(), longs(batch, "toxic").tolist()):
            found = distinct_words(t)
            ws += found
            ts += [toxic] * len(found)
        return {"word": pa.array(ws, pa.string()), "toxic": pa.array(ts, pa.int64())}
    sums = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, toxic = sums[0] or 0, sums[1] or 0
    if not n:
        return None
    counted = map_rows(sample.select("text", F.col("toxic").cast("long")), words_of, "word string, toxic long").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    ratio = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("n") - F.col("t") + 0.5) / (n - toxic + 1))
    marked = counted.filter(F.col("t") >= least_docs).withColumn("r", ratio).filter(F.col("r") >= least_ratio)
    words = frozenset(r["word"] for r in marked.orderBy(F.desc("t"), "word").limit(word_count).collect())

    def measured(batch: pa.RecordBatch) -> dict:
        return {"x": pa.array([measures(t, words) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())),
                "quality": longs(batch, "quality"), "toxic": longs(batch, "toxic")}
    rows = map_rows(sample.select("_id", "text", F.col("quality").cast("long"), F.col("toxic").cast("long")), measured,
                    "x array<double>, quality long, toxic long").collect()
    x = np.array([r["x"] for r in rows])
    fine, bad = (np.array([r[k] for r in rows], float) for k in ("quality", "toxic"))
    good = fine * (1 - bad)
    if good.min() == good.max():
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    return Model(tuple(mean), tuple(scale), tuple(_fit(z, fine)), tuple(_fit(z, bad)), words, float(good.mean()))


def with_evidence(df: DataFrame, model: Model | None, text: Column, name: str = "evidence") -> DataFrame:
    """Adds the probability of each text; one half without a model."""
    if model is None:
        return df.withColumn(name, F.lit(0.5))

    @F.pandas_udf("double")
    def told(held):  # noqa: ANN001, ANN202
        import pandas as pd
        return pd.Series(model.evidence(held.tolist()))
    return df.withColumn(name, told(F.coalesce(text, F.lit(""))))


def _strength(groups: DataFrame) -> float:
    """Pseudo-count toward the parent, by moments: the spread of rows inside groups over the spread
    of groups inside their parent.

    ``groups`` has n, s, ss (rows, sum and sum of squares) and pn, ps of its parent.  The squared
    distances of groups from their own parent's mean are what chance gives, the pooled variance of
    rows, and what groups differ by.  Many rows and a wide spread give a small count; groups that
    differ no more than chance, and parents of one group each, a large one.
    """
    m, part = F.col("s") / F.col("n"), 1 - F.col("n") / F.col("pn")
    got = groups.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.greatest(F.col("ss") - F.col("s") * m, F.lit(0.0))),
                     F.sum(F.col("n") * (m - F.col("ps") / F.col("pn")) ** 2), F.sum(part), F.sum(F.col("n") * part)).first()
    if not got[0] or got[5] <= 1e-9 or got[1] <= got[0]:
        return 1e6
    noise = got[2] / (got[1] - got[0])
    between = (got[3] - noise * got[4]) / got[5]
    return float(min(1e6, max(1.0, noise / between))) if between > 1e-12 else 1e6


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Per path ``host``, ``path``, ``host_mean``, ``path_mean``, the rows and sums behind them (``n``, ``s``,
    ``host_n``, ``host_s``) and the counts toward the parents (``by_path``, ``by_host``); the mean of all.

    ``scored`` has host, path, evidence.  Rows are added up per path before anything moves, hosts
    are sums of paths, so one host with a third of all rows costs no more than another.
    """
    from lodecat.session import cut_lineage
    paths = cut_lineage(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("ss")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = total[0] / total[1] if total[1] else 0.5
    inside = paths.join(hosts.select("host", F.col("n").alias("pn"), F.col("s").alias("ps")), "host")
    by_host = _strength(hosts.select("*", F.lit(float(total[1] or 1)).alias("pn"), F.lit(float(total[0] or 0)).alias("ps")))
    by_path = _strength(inside)
    known = inside.select("host", "path", "n", "s", F.col("pn").alias("host_n"), F.col("ps").alias("host_s"),
                          F.lit(by_path).alias("by_path"), F.lit(by_host).alias("by_host"))
    return cut_lineage(known.withColumn("host_mean", _shrunk("host_s", "host_n", "by_host", F.lit(mean)))
                       .withColumn("path_mean", _shrunk("s", "n", "by_path", F.col("host_mean")))), mean


def _shrunk(total: str, rows: str, count: str, parent: Column, own: Column | None = None) -> Column:
    """The mean of a site drawn toward its parent's, without the row's ``own`` evidence if given."""
    s, n = (F.col(total), F.col(rows)) if own is None else (F.col(total) - own, F.col(rows) - 1)
    return (s + F.col(count) * parent) / (n + F.col(count))


def _odds(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(safe / (1 - safe))


def judge(docs: DataFrame, model: Model | None, host: Column, path: Column, text_col: str = "text", threshold: float = 0.5,
          carry: Sequence[str] = ("*",)) -> DataFrame:
    """Every row of ``docs`` (its columns in ``carry``) as the struct ``row`` with ``host``, ``path``, ``evidence``,
    ``host_mean``, ``path_mean``, ``posterior`` and ``keep``.

    Null hosts and paths are sites of their own, named by the empty string; null and empty texts
    are judged by their form; rows that repeat are judged each; a table without rows gives none.
    ``host_mean`` and ``path_mean`` are of all rows of a site; a row's posterior takes them without its own
    evidence, which it adds itself.
    Without a model (no usable label) the evidence is one half and everything is kept.
    """
    base = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("_text"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    scored = with_evidence(base, model, F.col("_text")).drop("_text")
    sites, mean = site_posteriors(scored.select("host", "path", "evidence"))
    prior = model.rate if model else 0.5
    others = _shrunk("s", "n", "by_path", _shrunk("host_s", "host_n", "by_host", F.lit(mean), F.col("evidence")), F.col("evidence"))
    odds = _odds(F.col("evidence")) + _odds(others) - _odds(F.lit(prior))
    return (scored.join(lookup(sites, sites.count()), ["host", "path"]).withColumn("posterior", 1 / (1 + F.exp(-odds)))
            .withColumn("keep", F.col("posterior") >= threshold if model else F.lit(True))
            .drop("n", "s", "host_n", "host_s", "by_path", "by_host"))
