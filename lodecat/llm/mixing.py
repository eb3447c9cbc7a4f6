"""Mixing sources to target weights by temperature (6).

A source's weight is its share of all tokens to the power of an exponent between 0 (all alike) and
1 (as they are), normalised.  The exponent is found by bisection: the largest that reaches a
target entropy, raised if small sources would repeat more often than allowed.  The weights become
rows: every source gets its budget of tokens, in passes over its documents, each pass a
permutation cut where the budget ends; documents fall into training blocks that each hold every
source at its weight.  Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecat.llm.common import lookup
from lodecat.session import cut_lineage


def words(text: Column) -> Column:
    """Tokens of a text: runs without ASCII white space; a null text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")


@dataclass(frozen=True)
class Mix:
    """The exponent, the sum of powered shares, all tokens, and the budget in tokens."""
    exponent: float
    total: float
    tokens: int
    budget: int


def shares(docs: DataFrame, source: Column, tokens: Column, rows: Column | None = None) -> DataFrame:
    """``source``, ``tokens``, ``documents``; added up before the shuffle.  ``rows``: how many documents a row stands for."""
    rows = F.lit(1).cast("long") if rows is None else rows
    return docs.groupBy(source.alias("source")).agg(F.sum(tokens * rows).alias("tokens"), F.sum(rows).alias("documents"))


def find_mix(sources: DataFrame, entropy_share: float = 0.95, repetition: float = 4.0, budget: int | None = None, rounds: int = 6) -> Mix | None:
    """Bisects the exponent; four halvings a job, from one row of sums each.

    ``entropy_share`` times the logarithm of the number of sources is the target.  Without a budget
    the mix is as small as it can be with every document in it once.  If no exponent keeps the
    repetition limit, sources stay as they are (exponent 1).  Sources without tokens take no part.
    None if there is no token at all.
    """
    live = sources.filter("tokens > 0")
    got = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not got[3]:
        return None
    total, low, high, n = got
    share, target = F.col("tokens") / F.lit(float(total)), entropy_share * math.log(n)

    def sums(at: list[float]) -> list[tuple[float, float]]:
        row = live.agg(*[c for k, a in enumerate(at) for c in (F.sum(F.pow(share, F.lit(a))).alias(f"z{k}"),
                                                               F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{k}"))]).first()
        return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(at))]

    def entropy(a: float, z: float, powered: float) -> float:
        return math.log(z) - a * powered / z

    def repeats(a: float, z: float) -> float:
        if budget is None:
            return (high / low) ** (1 - a)
        return budget / total * (low / total) ** (a - 1) / z

    def bisect(holds_below) -> float:
        """The border between exponents where the test holds (below) and where it doesn't."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            step = (hi - lo) / 16
            at = [lo + step * k for k in range(1, 16)]
            held = [holds_below(a, z, p) for a, (z, p) in zip(at, sums(at))]
            k = held.index(False) if False in held else 15
            lo, hi = lo + step * k, lo + step * (k + 1)
        return lo
    (z0, l0), (z1, l1) = sums([0.0, 1.0])
    exponent = 1.0 if entropy(1.0, z1, l1) >= target else bisect(lambda a, z, p: entropy(a, z, p) >= target)
    ((z, _),) = sums([exponent])
    if repeats(exponent, z) > repetition:
        exponent = max(exponent, min(1.0, bisect(lambda a, z, p: repeats(a, z) > repetition) + 16.0 ** -rounds))
    exponent = round(exponent, 6)
    ((z, _),) = sums([exponent])
    needed = budget if budget is not None else math.ceil(total * z * (high / total) ** (1 - exponent))
    return Mix(exponent, z, int(total), int(needed))


def weight(tokens: Column, mix: Mix) -> Column:
    return F.pow(tokens / F.lit(float(mix.tokens)), F.lit(mix.exponent)) / F.lit(mix.total)


def _hash60(*parts: Column) -> Column:
    """60 bits, from a digest that other engines also have."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _marked(docs: DataFrame, *more: Column) -> DataFrame:
    """``row`` (the columns as a struct) and its name: two hashes, 128 bits, of the row as JSON."""
    row = F.struct("*")
    told = F.to_json(row)
    return docs.select(row.alias("row"), F.xxhash64(told).alias("_m"), F.xxhash64(F.lit(1), told).alias("_k"), *more)


def entries(docs: DataFrame, source: Column, tokens: Column) -> DataFrame:
    """What the mix needs to know of ``docs``, without their texts: one narrow row for each row that differs
    from all others, and for rows that are equal throughout one per input partition that holds some.

    ``n`` rows of the name ``_m``, ``_k`` are meant, numbered from ``nth``.  Texts are read once for this.
    """
    narrow = _marked(docs, source.alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")).drop("row")
    counted = narrow.withColumn("_part", F.spark_partition_id()).groupBy("_m", "_k", "source", "tokens", "_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_m", "_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(counted.withColumn("nth", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("_part"))


def places(rows: DataFrame, sources: DataFrame, mix: Mix, seed: int = 42, block_tokens: int = 1_000_000, whole: bool = False) -> DataFrame:
    """``_m``, ``_k``, ``source``, ``tokens``, ``pass`` from 0, ``block`` and ``slot`` (the place in the
    block's permutation) of every row of the mix; ``rows`` as ``entries`` gives them.

    A row's place follows from its name and its number among its equals, so neither null ids nor
    shared ones meet in one place.  The tokens before a document in its pass are added up in three
    steps, over the upper ten bits of its hash, the next ten, and the rest, so no window holds a
    whole source.  A pass ends at the document that reaches the source's budget; a source ends above
    its budget by less than one document.  ``whole``: the first pass holds every document, those
    without tokens too, and sources without tokens have one pass, in block 0.
    """
    count = F.coalesce("tokens", F.lit(0))
    own = F.when(count > 0, weight(count, mix)).otherwise(F.lit(0.0))
    plan = (sources if whole else sources.filter("tokens > 0")).select(
        F.col("source").alias("_s"), count.alias("_t"), own.alias("_w"),
        F.greatest(F.lit(1), F.round(own * F.lit(float(mix.budget)))).cast("long").alias("_b"))
    rows = (rows.join(lookup(plan, sources.count()), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("nth", F.expr("nth + _c"))
            .withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("if(_t > 0, cast((_b - 1) div _t as int), 0)"))))
            .withColumn("_h", _hash60(F.lit(seed), "pass", "_m", "_k", "nth"))
            .withColumn("_hi", F.shiftright("_h", 50)).withColumn("_mid", F.shiftright("_h", 40).bitwiseAND(F.lit(1023))))
    cells = rows.groupBy("source", "pass", "_hi", "_mid").agg(F.sum("tokens").alias("_n"))
    upper = cells.groupBy("source", "pass", "_hi").agg(F.sum("_n").alias("_u"))
    over = lambda *by: Window.partitionBy("source", "pass", *by)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.withColumn("_b1", F.coalesce(F.sum("_u").over(before(over().orderBy("_hi"))), F.lit(0))).drop("_u")
    cells = cells.withColumn("_b2", F.coalesce(F.sum("_n").over(before(over("_hi").orderBy("_mid"))), F.lit(0))).drop("_n")
    same = lambda a, b, keys: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]]
    cells = cells.alias("c").join(upper.alias("u"), same("c", "u", ["pass", "_hi"])).select("c.*", "u._b1")
    placed = rows.alias("r").join(cells.alias("c"), same("r", "c", ["pass", "_hi", "_mid"])).select("r.*", "c._b1", "c._b2")
    inside = F.sum("tokens").over(before(over("_hi", "_mid").orderBy("_h", "_m", "_k", "nth")))
    placed = placed.withColumn("_at", F.expr("pass * _t") + F.col("_b1") + F.col("_b2") + F.coalesce(inside, F.lit(0)))
    kept = placed.filter("_at < _b or pass = 0" if whole else "_at < _b")
    block = F.when(F.col("_w") > 0, F.floor(F.least("_at", F.col("_b") - 1) / (F.col("_w") * F.lit(float(block_tokens))))).otherwise(F.lit(0))
    return kept.select("_m", "_k", "source", "tokens", "pass", block.cast("long").alias("block"),
                       _hash60(F.lit(seed), F.lit("slot"), "pass", "_m", "_k", "nth").alias("slot"))


def realise(docs: DataFrame, rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The placed rows with their documents: ``row`` (its columns as a struct) before the rest.

    Documents move once, to their places by name.  Of rows that are equal throughout one is taken
    and stands at the places of all.
    """
    key = ["_m", "_k"]
    again = cut_lineage(rows.filter("n > 1 or nth > 0").select(*key).distinct())
    again = lookup(again, again.count())
    named = _marked(docs)
    one = named.join(again, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row", *key)
    return named.join(again, key, "left_anti").select("row", *key).union(one).join(placed, key).select(
        "row", "source", "tokens", "pass", "block", "slot")


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", entropy_share: float = 0.95,
                repetition: float = 4.0, budget: int | None = None, seed: int = 42, block_tokens: int = 1_000_000,
                tokens: Column | None = None) -> tuple[DataFrame, Mix | None]:
    """The mix of ``docs`` and its figures: ``row`` (the document's columns as a struct), ``source``,
    ``tokens``, ``pass``, ``block`` and ``slot``.  Tokens are words, or what ``tokens`` says.

    A null source is a source of its own.  Ids play no part: rows are told apart by all their
    columns, and rows that are equal throughout are documents each, at places of their own.  Without
    a budget every document comes at least once, those without words too, at no cost.  With one,
    documents without words stay where the permutation puts them, and a source of only such
    documents is left out.  An empty table gives no rows, and no figures.
    """
    rows = entries(docs, F.col(source_col), words(F.col(text_col)) if tokens is None else tokens)
    sources = cut_lineage(shares(rows, F.col("source"), F.col("tokens"), F.col("n")))
    mix = find_mix(sources, entropy_share, repetition, budget)
    if mix is None and budget is not None:
        rows = rows.limit(0)
    placed = places(rows, sources, mix or Mix(1.0, 1.0, 1, 1), seed, block_tokens, budget is None)
    return realise(docs, rows, placed), mix
