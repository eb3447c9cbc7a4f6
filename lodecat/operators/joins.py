"""Joins between catalogue, topic, source and vocabulary tables.

No join carries a broadcast hint: measured sizes and AQE choose, and AQE splits skewed
shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions.parse import accession_type
from lodecat.functions.text import distinct_ignoring_case
from lodecat.operators.matching import resolve_alias
from lodecat.operators.order import one_per_key, top_per_key
from lodecat.session import cut_lineage, measured_joins

VIEW_FIELDS = ["title", "organism", "sample_count", "omics_type", "omics_granularity",
               "platform", "availability_status", "access_type"]


def topic_view(edges: DataFrame, datasets: DataFrame, topic_id: str | None = None,
               review_status: str | None = None) -> DataFrame:
    """Topic edges with their dataset columns."""
    if topic_id:
        edges = edges.filter(F.col("topic_id") == topic_id)
    if review_status:
        edges = edges.filter(F.col("review_status") == review_status)
    return edges.join(datasets.select("gse_id", *VIEW_FIELDS), "gse_id")


def in_topics(datasets: DataFrame, edges: DataFrame) -> DataFrame:
    """Datasets that any given edge names; a semi join needs no distinct."""
    return datasets.join(edges.select("gse_id"), "gse_id", "left_semi")


def with_answers(rows: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored answers attached; rows without one keep nulls."""
    return rows.join(answers, list(keys), "left")


def without_answers(rows: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The work list: rows no stored answer covers."""
    return rows.join(answers.select(*keys), list(keys), "left_anti")


def override(rows: DataFrame, other: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """``field`` from ``other`` where present, else its own value (J4); of several the greatest."""
    theirs = one_per_key(other.select(*keys, field).filter(F.col(field).isNotNull()), keys).select(*keys, F.col(field).alias("_theirs"))
    return (rows.join(theirs, list(keys), "left")
            .withColumn(field, F.coalesce("_theirs", field)).drop("_theirs"))


def attach_samples(datasets: DataFrame, samples: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` samples of each dataset as an ordered array.

    The cut is part of the operator and comes before the list is built, so no list is
    longer than ``most``.
    """
    lead = top_per_key(samples, ["gse_id"], [F.col("pos"), F.col("gsm_id")], most, rank="_rn")
    packed = lead.groupBy("gse_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", "gsm_id", "title"))),
        lambda s: F.struct(s["gsm_id"].alias("gsm_id"), s["title"].alias("title")))
        .alias("samples"))
    return datasets.join(packed, "gse_id", "left").withColumn("samples", F.coalesce(
        "samples", F.array().cast("array<struct<gsm_id:string,title:string>>")))


def known_only(rows: DataFrame, authority: DataFrame, key: str = "gse_id") -> DataFrame:
    return rows.join(authority.select(key), key, "left_semi")


def unknown_only(rows: DataFrame, authority: DataFrame, key: str = "gse_id") -> DataFrame:
    return rows.join(authority.select(key), key, "left_anti")


def paper_links(papers: DataFrame, links: DataFrame) -> DataFrame:
    """(pmid, gse_id, place): ids in the paper's own text first, then linked ones, each once
    (J7).  One row per link, so a paper with very many links is never one list."""
    own = papers.select("pmid", F.posexplode("gse_ids").alias("place", "gse_id")).withColumn(
        "origin", F.lit(0))
    linked = links.select("pmid", F.lit(0).alias("place"), "gse_id").withColumn(
        "origin", F.lit(1))
    return (own.unionByName(linked.join(papers.select("pmid"), "pmid", "left_semi"))
            .groupBy("pmid", "gse_id")
            .agg(F.min(F.struct("origin", "place")).alias("place")))


def fill_missing(rows: DataFrame, source: DataFrame, key: str, text: Sequence[str] = (),
                 lists: Sequence[str] = (), counts: Sequence[str] = (),
                 always: Sequence[str] = (), larger: Sequence[str] = ()) -> DataFrame:
    """Empty fields from a second source.

    ``counts`` fill when 0, ``always`` replace when the source has any, ``larger`` take the
    greater number.  Of several source rows of a key the greatest, by the used columns, counts.
    """
    used = [*text, *lists, *counts, *always, *larger]
    side = one_per_key(source.select(key, *used), [key]).select(key, *[F.col(c).alias(f"_s_{c}") for c in used])
    out = rows.join(side, key, "left")
    s = lambda c: F.col(f"_s_{c}")
    new = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), s(c), F.lit("")) for c in text}
    new |= {c: F.when((F.size(c) == 0) & s(c).isNotNull(), s(c)).otherwise(F.col(c))
            for c in lists}
    new |= {c: F.when((F.col(c) == 0) & (s(c) > 0), s(c)).otherwise(F.col(c)) for c in counts}
    new |= {c: F.when(F.size(s(c)) > 0, s(c)).otherwise(F.col(c)) for c in always}
    new |= {c: F.greatest(F.col(c), s(c)) for c in larger}
    return out.withColumns(new).drop(*[f"_s_{c}" for c in used])


def resolved_edges(edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(parent, child) edges with both names canonical, so that a parent given by an alias goes on.

    ``vocab`` holds the terms that count as names; unknown names stay as they are.
    """
    both = resolve_alias(edges.select("parent", "child"), F.col("parent"), vocab, "parent")
    return resolve_alias(both, F.col("child"), vocab, "child").distinct()


def ancestors(nodes: DataFrame, edges: DataFrame, deepest: int | None = None) -> DataFrame:
    """(node, relative, depth) up the parent chain, each relative once, at its least depth.

    The chain is followed by path doubling: a chain of depth d takes log2(d) joins, and cycles end.
    ``deepest`` stops earlier on request.
    """
    return _walk(nodes, edges.select(F.col("child").alias("at"), F.col("parent").alias("next")), deepest)


def descendants(nodes: DataFrame, edges: DataFrame, deepest: int | None = None) -> DataFrame:
    """(node, relative, depth) down the child links, as ``ancestors``."""
    return _walk(nodes, edges.select(F.col("parent").alias("at"), F.col("child").alias("next")), deepest)


#: Asked names up to this number are sent to every task.
FEW_NAMES = 50_000


def _walk(nodes: DataFrame, step: DataFrame, deepest: int | None) -> DataFrame:
    """All relatives up to depth n are known exactly, then up to 2n: whoever is farther than n passes
    through a relative at n, so only those at n are joined on.  One job and one checkpoint a doubling;
    rows grow to the relatives of all names, not of ``nodes`` alone.  Tables of names are broadcast by their
    measured size, so the driver holds no more of a large vocabulary than of a small one."""
    with measured_joins(step.sparkSession):
        reach = cut_lineage(step.filter("at <> next").distinct().withColumn("depth", F.lit(1)))
        reached = 1
        while deepest is None or reached < deepest:
            far = reach.filter(F.col("depth") == reached)
            if far.isEmpty():
                break
            further = (far.select("at", F.col("next").alias("via")).join(reach.select(F.col("at").alias("via"), "next", "depth"), "via")
                       .select("at", "next", (F.col("depth") + reached).alias("depth")).filter("at <> next"))
            reach = cut_lineage(reach.unionByName(further).groupBy("at", "next").agg(F.min("depth").alias("depth")))
            reached *= 2
        asked = nodes.select(F.col("node").alias("at")).distinct()
        few = asked.limit(FEW_NAMES + 1).count() <= FEW_NAMES
    found = reach if deepest is None else reach.filter(F.col("depth") <= deepest)
    return (F.broadcast(asked) if few else asked.hint("merge")).join(found, "at").select(
        F.col("at").alias("node"), F.col("next").alias("relative"), "depth")


def topic_by_name(topics: DataFrame, names: DataFrame) -> DataFrame:
    return topics.join(names, "name")


def related(entries: DataFrame, field: str = "related_organs") -> DataFrame:
    """(canonical, relative) pairs of a list field, for both directions."""
    return entries.select("canonical", F.posexplode(field).alias("pos", "relative")).withColumn(
        "relative_key", F.lower("relative"))


def get_datasets(asked: DataFrame, stored: DataFrame, key: str = "accession") -> DataFrame:
    """Stored rows by any id: the exact series id first, else the series of a study id.

    Each asked id gives one row at most, with the id in ``key``; of several series of one study
    the smallest series id counts.  Ids that nothing is stored under give no row.  Two
    equi-joins; the study ids are exploded narrow, and whole rows are fetched for winners.
    """
    ids = asked.select(key).filter(F.col(key).isNotNull()).distinct()
    exact = ids.join(stored.select("gse_id").distinct(), F.col(key) == F.col("gse_id"), "left")
    rest = exact.filter(F.col("gse_id").isNull()).select(key)
    by_study = stored.select("gse_id", F.explode("sra_ids").alias(key))
    found = exact.filter(F.col("gse_id").isNotNull()).unionByName(
        rest.join(by_study, key).groupBy(key).agg(F.min("gse_id").alias("gse_id")))
    return found.join(stored.drop(key), "gse_id")


def get_dataset(stored: DataFrame, accession: str) -> DataFrame:
    """The one stored row of an id, or none: the form of :func:`get_datasets` for one id."""
    by_id = stored.filter(F.col("gse_id") == accession).withColumn("_near", F.lit(0))
    by_study = stored.filter(F.array_contains("sra_ids", accession)).withColumn("_near", F.lit(1))
    return by_id.unionByName(by_study).orderBy("_near", "gse_id").limit(1).drop("_near")


def report_items(reports: DataFrame, items: DataFrame) -> DataFrame:
    """Reports with their ranked items."""
    return reports.join(items, "report_id")


def lookup(names: DataFrame, vocab: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Terms of the chosen kinds for every name; an unknown name gives itself."""
    keys = vocab.groupBy(F.col("term").alias("_key"), "domain").agg(
        F.min_by("canonical", "pos").alias("canonical"))
    known = names.join(keys, F.lower(F.trim("name")) == F.col("_key"), "left").drop("_key")
    wanted = vocab.filter(F.col("kind").isin(*kinds)).select(
        "domain", "canonical", "kind", F.col("label").alias("value"), "pos")
    return (known.join(wanted, ["domain", "canonical"], "left")
            .withColumn("value", F.coalesce(
                "value", F.when(F.col("canonical").isNull(), F.col("name")))))


def expand_abbreviations(names: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Search terms, related conditions and organs of an abbreviation, each spelling once;
    anything else stays as it is (J18).

    ``abbreviations`` has key (upper case), search_terms, related_diseases, related_organs.
    """
    joined = names.join(abbreviations, F.upper(F.trim("name")) == F.col("key"), "left")
    terms_ = distinct_ignoring_case(F.concat(
        "search_terms", "related_diseases", "related_organs"))
    return joined.select(*names.columns, F.when(F.col("key").isNull(), F.array("name"))
                         .otherwise(terms_).alias("expansion"))


_FAMILY = {"PRJNA": "PRJ", "PRJEB": "PRJ"}


def convert_ids(accessions: DataFrame, crosswalk: DataFrame,
                targets: Sequence[str] = terms.CONVERSION_TARGETS) -> DataFrame:
    """Every accession in every target database, capped per rule, with a note.

    ``crosswalk`` has src_id, dst_type, dst_id, pos.  Lists are cut to the published caps of
    at most 20 before they are built.
    """
    kind = accession_type(F.col("accession"))
    asked = (accessions.select("accession").distinct()
             .withColumn("source_type", F.coalesce(kind, F.lit("unknown")))
             .withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets]))))
    family = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in _FAMILY.items()],
                        F.col("source_type"))
    cap = F.coalesce(*[F.when((family == s) & (F.col("target") == t), c)
                       for s, t, c in terms.CONVERSION_CAPS])
    asked = asked.withColumn("cap", cap)
    links = crosswalk.select(F.upper("src_id").alias("_key"), F.col("dst_type").alias("target"),
                             "dst_id", "pos")
    found = (asked.filter("cap is not null").withColumn("_key", F.upper(F.trim("accession")))
             .join(links, ["_key", "target"]))
    most = max(c for _, _, c in terms.CONVERSION_CAPS)
    kept = top_per_key(found, ["accession", "target"], [F.col("pos"), F.col("dst_id")],
                       F.col("cap"), at_most=most, rank="_rn")
    lists = kept.groupBy("accession", "target").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", "dst_id"))),
        lambda s: s["dst_id"]).alias("found"))
    out = asked.join(lists, ["accession", "target"], "left")
    n = F.size(F.coalesce("found", F.array().cast("array<string>")))
    say = lambda what: F.concat(F.lit("Found "), n.cast("string"), F.lit(f" {what}"))
    t, s = F.col("target"), F.col("source_type")
    values = (F.when((s == "SRP") & (t == "bioproject"), F.array("accession"))
              .when((s == "GSE") & (t == "gds"),
                    F.transform("found", lambda x: F.concat(F.lit("GDS"), x)))
              .otherwise(F.col("found")))
    note = (
        F.when(s == "unknown", F.concat(F.lit("Unknown accession format: "), "accession"))
        .when(s.isin("GSM", "BioSample"),
              F.concat(F.lit("Conversion from "), s, F.lit(" not implemented")))
        .when((s == "GSE") & (t == "sra"), F.when(n > 0, say("SRA study(ies)"))
              .otherwise("No SRA studies linked to this GSE"))
        .when((s == "GSE") & (t == "gds"), "GEO Datasets IDs")
        .when((s == "GSE") & (t == "bioproject"), say("BioProject(s)"))
        .when((s == "GSE") & (t == "pubmed"), "Linked PubMed articles")
        .when((s == "SRP") & (t == "gds"), F.when(n > 0, say("GDS record(s)")).otherwise(""))
        .when((s == "SRP") & (t == "bioproject"), "SRA Study IS a BioProject")
        .when((s == "SRP") & (t == "biosample"), say("BioSample(s)"))
        .when(s.isin("SRX", "SRR") & (t == "sra"), F.when(n > 0, say("parent SRA Study(ies)"))
              .otherwise("No parent SRA Study found"))
        .when((family == "PRJ") & (t == "sra"), say("SRA Study(ies)")).otherwise(""))
    return out.select(
        "accession", F.when(family == "PRJ", "BioProject").otherwise(s).alias("source_type"),
        "target", F.coalesce(values, F.array().cast("array<string>")).alias("targets"),
        note.alias("note"))
