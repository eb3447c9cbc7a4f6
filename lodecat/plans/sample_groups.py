"""Sample groups of every dataset from sample titles or attributes.

Groups come as rows, one per dataset and group, beside one summary row per dataset: a dataset
with very many samples or groups never becomes one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import table, terms
from lodecat.functions import groups as g
from lodecat.operators.order import top_per_key

# Strategies in their order of trial with their confidence.
STRATEGIES = [("prefix", 0.95), ("delimiter", 0.85), ("timecourse", 0.7)]
FALLBACK = ("fallback", 0.3)


def token_counts(samples: DataFrame) -> DataFrame:
    """(gse_id, strategy, token, n, n_split, pos) of all three strategies."""
    name = samples.select("gse_id", "pos", F.lower(F.trim("title")).alias("_s"))
    s = F.col("_s")
    tokens = [g.prefix_token(s), g.delimiter_token(s), g.time_token(s)]
    rows = name.select("gse_id", "pos", F.inline(F.array(*[
        F.struct(F.lit(i).alias("strategy"), t.alias("token"),
                 g.is_split(s).cast("long").alias("split")) for i, t in enumerate(tokens)])))
    return rows.groupBy("gse_id", "strategy", "token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("split").alias("n_split"), F.min("pos").alias("pos"))


def infer_groups(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, groups).  The first strategy whose tokens make sense is taken (C4).

    prefix: two groups or more, not one per sample.  delimiter: half of the titles split.
    timecourse: every title names a time.  Otherwise all samples are one group.
    """
    counts = token_counts(samples)
    c = F.col
    named = c("token") != ""
    per = counts.groupBy("gse_id", "strategy").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_samples"),
        F.count_if(named).alias("named"), F.sum("n_split").alias("splits"),
        F.count_if(c("token") == "unknown").alias("unknown"),
        F.min(F.when(named, c("n"))).alias("smallest"))
    several = (c("k") >= 2) & (c("named") >= 2)
    valid = (F.when(c("strategy") == 0, several & (c("k") != c("n_samples")))
             .when(c("strategy") == 1, several & (c("splits") / c("n_samples") >= 0.5))
             .otherwise((c("k") >= 2) & (c("unknown") == 0)))
    chosen = per.groupBy("gse_id").agg(
        F.max("n_samples").alias("n_samples"),
        F.min(F.when(valid, F.struct("strategy", "named", "k", "smallest"))).alias("_p"))
    method = F.coalesce(*[F.when(c("_p.strategy") == i, m) for i, (m, _) in enumerate(STRATEGIES)],
                        F.lit(FALLBACK[0]))
    confidence = F.coalesce(*[F.when(c("_p.strategy") == i, x)
                              for i, (_, x) in enumerate(STRATEGIES)], F.lit(FALLBACK[1]))
    n_groups = F.coalesce(F.when(c("_p.strategy") == 2, c("_p.k")), c("_p.named"), F.lit(1))
    summary = chosen.select(
        "gse_id", method.alias("method"), confidence.alias("confidence"),
        n_groups.alias("n_groups"), g.design_label(n_groups).alias("design"),
        F.coalesce((n_groups >= 2) & (c("_p.smallest") >= 2), F.lit(False))
        .alias("contrast_ready"),
        "n_samples", F.coalesce("_p.strategy", F.lit(-1)).alias("strategy"))
    picked = (counts.join(summary.select("gse_id", "strategy"), ["gse_id", "strategy"])
              .filter((c("token") != "") | (c("strategy") == 2))
              .select("gse_id", c("token").alias("name"), "n", "pos"))
    whole = summary.filter("strategy = -1").select(
        "gse_id", F.lit("all").alias("name"), c("n_samples").alias("n"),
        F.lit(0).cast(counts.schema["pos"].dataType).alias("pos"))
    groups = picked.unionByName(whole)
    return summary.drop("strategy"), groups


def with_lead_groups(summary: DataFrame, groups: DataFrame, most: int = 3) -> DataFrame:
    """Summary rows with their first few groups, for display."""
    lead = top_per_key(groups, ["gse_id"], [F.col("pos"), F.col("name")], most, rank="_r")
    packed = lead.groupBy("gse_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "name", "n"))),
        lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("lead_groups"))
    return summary.join(packed, "gse_id", "left")


def named_groups(groups: DataFrame) -> DataFrame:
    """Groups under cleaned, known names; of equal names the first stays."""
    token = g.group_token(F.col("name"))
    rows = groups.withColumn("token", token).filter("token <> ''").withColumn(
        "group_name", g.group_name(F.col("token")))
    return rows.filter("group_name <> ''").groupBy("gse_id", "group_name").agg(
        F.min_by(F.struct("n", "token"), F.struct("pos", "name")).alias("_r"),
        F.min("pos").alias("pos")).select(
            "gse_id", F.col("group_name").alias("name"), "_r.n", "_r.token", "pos")


def groups_simple(samples: DataFrame) -> DataFrame:
    """Token counts under known names; of equal names the most frequent token stays."""
    names = table("group_names_simple")
    rows = samples.select("gse_id", "pos", g.group_token(F.col("title")).alias("token")).filter(
        "token <> ''")
    counts = rows.groupBy("gse_id", "token").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    named = counts.withColumn("name", g.group_name(F.col("token"), names)).filter("name <> ''")
    return named.groupBy("gse_id", "name").agg(
        F.min_by(F.struct("n", "token"), F.struct((-F.col("n")).alias("m"), "pos")).alias("_r")
    ).select("gse_id", "name", "_r.n", "_r.token")


def attribute_values(samples: DataFrame) -> DataFrame:
    """(gse_id, value, n) of sample types and group-like attributes."""
    low = F.transform("sample_type", F.lower)
    fields = F.array(*[F.element_at("attributes", F.lit(f)) for f in terms.GROUP_FIELDS])
    useful = F.filter(
        F.transform(F.array_compact(fields), F.lower),
        lambda v: (F.length(v) > 2) & ~v.isin("na", "none", "unknown"))
    values = F.concat(F.filter(low, lambda v: F.length(v) > 2), useful)
    return samples.select("gse_id", F.explode(values).alias("value")).groupBy(
        "gse_id", "value").agg(F.count(F.lit(1)).alias("n"))


def groups_from_attributes(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, groups) from attributes: similar names merged, a lone tissue name is no
    grouping (C5, D10)."""
    c = F.col
    counts = attribute_values(samples)
    totals = samples.groupBy("gse_id").agg(F.count(F.lit(1)).alias("n_samples"))
    spread = counts.groupBy("gse_id").agg(
        F.count(F.lit(1)).alias("k"), F.min("value").alias("only"))
    usable = spread.filter((c("k") > 1) | ~c("only").isin(*terms.COMMON_TISSUE_GROUPS))
    merged = (counts.join(usable, "gse_id")
              .withColumn("name", F.when(c("k") > 1, g.merged_root(c("value")))
                          .otherwise(c("value")))
              .groupBy("gse_id", "name").agg(F.sum("n").alias("n")))
    shape = merged.groupBy("gse_id").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("_least"), F.sum("n").alias("_sum"))
    found = totals.join(shape, "gse_id", "left")
    has = c("n_groups").isNotNull()
    summary = found.select(
        "gse_id", F.when(has, "gsm_attributes").otherwise("fallback").alias("method"),
        F.when(has, F.least(F.lit(0.95), 0.6 + 0.1 * F.least(
            c("n_samples") / c("n_groups"), F.lit(4.0)))).otherwise(0.3).alias("confidence"),
        F.when(~has, "single-group").when(c("n_groups") == 2, "binary")
        .otherwise("multi-group").alias("design"),
        F.coalesce((c("n_groups") >= 2) & (c("_least") >= 2) & (c("_sum") >= 4), F.lit(False))
        .alias("contrast_ready"),
        F.coalesce("n_groups", F.lit(1)).alias("n_groups"), "n_samples")
    whole = summary.filter("method = 'fallback'").select(
        "gse_id", F.lit("all").alias("name"), c("n_samples").alias("n"))
    return summary, merged.unionByName(whole)


def merge_groups(groups: DataFrame, root: Column | None = None) -> DataFrame:
    """Counts of similar names added up per dataset."""
    name = g.merged_root(F.col("name")) if root is None else root
    return groups.groupBy("gse_id", name.alias("root")).agg(F.sum("n").alias("n"))
