"""Sample group tokens, names and design labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodecat.fixed import table, terms
from lodecat.functions.text import blank, let, lit_array, lit_map

STOP_PARTS = ["and", "vs", "of", "or", "the", "with", "replicate", "replicates"]
# How group names are announced in design texts, with their capture groups.
GROUP_TEXT_PATTERNS = [
    (r"(?U)(\w+)\s*[=:]\s*(\d+)\s*(biological|technical)?\s*replicate", 3),
    (r"(?U)(\d+)\s*(replicates?|biological|technical)\s+(?:of\s+)?(\w+)", 3),
    (r"(?U)(\w+)\s+vs\s+(\w+)", 2),
    (r"(?U)(control|ctrl|case|patient|treatment|stimulated)\s+and\s+(\w+)", 2),
]


def title_case(col: Column) -> Column:
    """Every run of letters starts upper-case and goes on lower-case."""
    pieces = F.split(col, r"(?<=\P{L})|(?=\P{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def group_token(name: Column) -> Column:
    """Sample name without accession prefixes, replicate marks and numbers."""
    steps = [
        (r"(?i)^(GSE|GSM|SRP|SRR|SRX|ERR)[0-9]*_?", ""), (r"(?i)^(GSM|SRX|ERR)[0-9]+", ""),
        (r"^[_\-]?[0-9]+", ""), (r"(_[0-9]+)+$", ""), (r"_[0-9]+$", ""), (r"[0-9]+$", ""),
        (r"(?i)_rep[0-9]+$", ""), (r"(?i)_r[0-9]+$", ""), (r"^_", ""),
    ]
    out = blank(name)
    for pattern, into in steps:
        out = F.regexp_replace(out, pattern, into)
    return F.trim(F.lower(out))


def group_name(token: Column, names: Mapping[str, str] | None = None) -> Column:
    """Known token, else the first known prefix, else the token in title case."""
    names = table("group_names") if names is None else names
    known = lambda k: F.element_at(lit_map(names), k)
    prefix = lambda t: F.get(F.filter(
        lit_array(names), lambda k: F.startswith(t, k)), F.lit(0))
    return let(token, lambda t: F.coalesce(known(t), known(prefix(t)), title_case(t)))


def groups_from_text(title: Column, design: Column, samples: Column) -> Column:
    """Groups named in a text with size 0, else a split of the sample count.

    Of each pattern's matches the first that names a group counts.
    """
    text = F.lower(F.concat_ws(" ", blank(title), blank(design)))
    names = []
    for pattern, groups in GROUP_TEXT_PATTERNS:
        matches = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)) for g in range(groups)])
        parts = F.transform(matches, lambda m: F.filter(
            F.array(*[m[str(g)] for g in range(groups)]),  # noqa: B023
            lambda p: (p != "") & ~p.rlike("^[0-9]+$") & ~p.isin(*STOP_PARTS)))
        names.append(F.get(F.filter(parts, lambda p: F.size(p) > 0), F.lit(0)))
    names = F.flatten(F.filter(F.array(*names), lambda p: p.isNotNull()))
    names = F.array_distinct(F.filter(F.transform(names, lambda n: group_name(n)), lambda n: n != ""))
    group = lambda n, k: F.struct(n.alias("name"), k.cast("long").alias("n"))
    half = F.floor(samples / 2)
    split = (F.when(samples >= 4, F.array(group(F.lit("case"), half),
                                          group(F.lit("control"), samples - half)))
             .when(samples >= 2, F.array(group(F.lit("unknown"), samples)))
             .otherwise(F.array().cast("array<struct<name:string,n:bigint>>")))
    found = lambda ns: F.transform(ns, lambda n: group(n, F.lit(0)))
    return let(names, lambda ns: F.when(F.size(ns) > 0, found(ns)).otherwise(split))


def contrast_ready(groups: Column) -> Column:
    """Two groups or more, two samples or more in each, four or more in all."""
    total = F.aggregate(groups, F.lit(0).cast("long"), lambda a, g: a + g["n"])
    return (F.size(groups) >= 2) & F.forall(groups, lambda g: g["n"] >= 2) & (total >= 4)


def design_label(n_groups: Column) -> Column:
    return (F.when(n_groups == 1, "single-group").when(n_groups == 2, "binary")
            .otherwise("multi-group"))


def prefix_token(sample: Column) -> Column:
    """Letters in front of a number, else the whole name."""
    found = F.nullif(F.regexp_extract(sample, "^([a-z]+)([0-9]+)$", 1), F.lit(""))
    return F.coalesce(found, sample)


def delimiter_token(sample: Column) -> Column:
    """Text in front of the first delimiter, else the whole name."""
    head = F.regexp_extract(sample, r"^([^_\-. ]+)[_\-. ]", 1)
    return F.when(head != "", head).otherwise(sample)


def is_split(sample: Column) -> Column:
    return sample.rlike(r"^[^_\-. ]+[_\-. ]")


def time_token(sample: Column) -> Column:
    """First declared time word that stands free, else ``t`` and digits, else unknown.

    All time words of a title are found in one pass.
    """
    order = {w: i for i, w in enumerate(terms.TIME_WORDS)}
    hits = F.regexp_extract_all(sample, F.lit(
        rf"(?<![^_\-.\s])(?=({'|'.join(order)})(?:$|[_\-.\s0-9]))"), F.lit(1))
    first = F.array_min(F.transform(hits, lambda h: F.element_at(lit_map(order), h)))
    word = F.element_at(lit_array(order), first + 1)
    short = F.regexp_extract(sample, "t([0-9]+)", 1)
    return (F.when(first.isNotNull(), word)
            .when(short != "", F.concat(F.lit("t"), short)).otherwise("unknown"))


def merged_root(name: Column) -> Column:
    """Group name without a closing role word and closing digits."""
    suffix = "|".join(s.replace("(", r"\(").replace(")", r"\)") for s in terms.GROUP_SUFFIXES)
    return F.trim(F.regexp_replace(
        F.trim(F.regexp_replace(name, f"(?:{suffix})$", "")), "[0-9]+$", ""))
