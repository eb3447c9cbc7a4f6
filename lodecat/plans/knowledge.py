"""What a vocabulary says about a word, as Column expressions.

Query and topic texts come as tables of many rows, vocabularies are small: the entries are
read once, up to a checked number, and become literal maps, so that every row is worked on
where it is.  :func:`expand_terms_join` is the form for vocabularies beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.functions.text import (
    all_classes, blank, constant, distinct_ignoring_case, lit_array, lit_map, ordered_union,
    phrase_hits, remove_phrases,
)

MOST_ENTRIES = 5000
NONE = "array<string>"


def _lookup(pairs: dict, key: Column) -> Column:
    """Value of a text or list valued map, null for other keys."""
    if not pairs:
        some = F.lit(None)
        return some.cast("string")
    if isinstance(next(iter(pairs.values())), list):
        inner = ", ".join(f"{constant(k)}, {constant(v) if v else 'cast(array() as array<string>)'}"
                          for k, v in pairs.items())
        return F.element_at(F.expr(f"map({inner})"), key)
    return F.element_at(lit_map(pairs), key)


def _lists(pairs: dict, key: Column) -> Column:
    return F.coalesce(_lookup(pairs, key).cast(NONE), F.array().cast(NONE)) if pairs \
        else F.array().cast(NONE)


@dataclass
class Domain:
    """One vocabulary: known names and the lists of every entry."""
    names: dict[str, str] = field(default_factory=dict)
    entries: dict[str, dict] = field(default_factory=dict)

    def canonical(self, word: Column) -> Column:
        return _lookup(self.names, F.lower(F.trim(word)))

    def of(self, canonical: Column, *kinds: str) -> Column:
        """The chosen lists of an entry one after the other; empty for none."""
        return _lists({k: [x for kind in kinds for x in _items(e, kind)]
                       for k, e in self.entries.items()}, canonical)

    def search_terms(self, name: Column) -> Column:
        """Search terms of a name; an unknown name gives itself."""
        known = self.canonical(name)
        return F.when(known.isNull(), F.array(name)).otherwise(self.of(known, "search_terms"))

    def names_of(self, name: Column, kind: str) -> Column:
        """Canonical name and its other names; an unknown name gives itself."""
        known = self.canonical(name)
        return F.array_distinct(F.when(known.isNull(), F.array(name)).otherwise(
            F.concat(F.array(known), self.of(known, kind))))

    def phrases(self) -> list[str]:
        return [x for k, e in self.entries.items() for x in (k, *e["synonyms"])]


def _items(entry: dict, kind: str) -> list[str]:
    value = entry.get(kind) or []
    return [value] if isinstance(value, str) else list(value)


@dataclass
class Knowledge:
    disease: Domain
    organ: Domain
    assay: Domain
    mesh: Domain
    abbreviations: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def of(cls, entries: DataFrame, abbreviations: DataFrame | None = None,
           most: int = MOST_ENTRIES) -> Knowledge:
        rows = entries.orderBy("domain", "seq", "place").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("too many entries for the in-row form; use expand_terms_join")
        domains = {d: Domain() for d in ("disease", "organ", "assay", "mesh")}
        for row in rows:
            if row["domain"] in domains:
                d, e = domains[row["domain"]], row.asDict()
                d.entries[row["canonical"]] = e
                other = e["aliases"] if row["domain"] == "assay" else e["synonyms"]
                for name in (row["key"], row["canonical"], *other):
                    d.names.setdefault(name.lower(), row["canonical"])
        short = {} if abbreviations is None else {
            r["key"]: r.asDict() for r in abbreviations.orderBy("key").limit(most + 1).collect()}
        if len(short) > most:
            raise ValueError("too many abbreviations for the in-row form; use expand_terms_join")
        return cls(abbreviations=short, **domains)

    # --- words --------------------------------------------------------------------------

    def expand(self, word: Column) -> Column:
        """Abbreviation, condition, organ, assay, MeSH lists in that order, each spelling
        once; a word nobody knows gives itself (C8)."""
        key = F.upper(F.trim(word))
        short = _lists({k: [*e["search_terms"], *e["related_diseases"], *e["related_organs"],
                            *([e["full_name"]] if e["full_name"] else [])]
                        for k, e in self.abbreviations.items()}, key)
        parts = [
            short,
            self.disease.of(self.disease.canonical(word), "search_terms", "synonyms",
                            "related_organs"),
            self.organ.of(self.organ.canonical(word), "search_terms", "synonyms", "adjective"),
            self.assay.of(self.assay.canonical(word), "aliases", "search_boost_terms"),
            self.mesh.of(self.mesh.canonical(word), "synonyms"),
        ]
        found = distinct_ignoring_case(F.concat(*parts))
        return F.when(F.size(found) > 0, found).otherwise(F.array(word))

    def short_forms(self, text: Column) -> Column:
        """Abbreviations that stand free in a text, in declared order."""
        if not self.abbreviations:
            return F.array().cast(NONE)
        return F.array_compact(F.array(*[
            F.when(text.rlike(rf"(?i)(?U)\b{k}\b"), k) for k in self.abbreviations]))

    def assays(self, text: Column) -> Column:
        """Assays with a keyword inside the text."""
        return all_classes(F.lower(blank(text)), [
            (k, [w.lower() for w in e["keywords"]]) for k, e in self.assay.entries.items()
            if e["keywords"]])

    def phrases(self, text: Column) -> Column:
        """Known condition and organ names in a text, longest first, then the words outside
        them; each spelling once (M9)."""
        known: dict[str, str] = {}
        for phrase in [*self.disease.phrases(), *self.organ.phrases()]:
            known.setdefault(phrase.lower(), phrase)
        low = F.lower(blank(text))
        hits = phrase_hits(low, known)
        ordered = F.array_sort(F.transform(hits, lambda h: F.struct(
            (-F.length(h)).alias("n"), F.array_position(lit_array(known), h).alias("p"),
            h.alias("h"))))
        names = F.transform(ordered, lambda s: _lookup(known, s["h"]))
        words = F.regexp_extract_all(remove_phrases(low, known), F.lit(r"(?U)(\w+)"), F.lit(1))
        return distinct_ignoring_case(F.concat(names, words))

    # --- texts --------------------------------------------------------------------------

    def analyze(self, df: DataFrame, text: str, prefix: str = "") -> DataFrame:
        """Adds diseases, organs, omics_types, species, expanded_terms and confidence."""
        p = prefix
        c = lambda n: F.col(p + n)
        compact = lambda a: F.array_distinct(F.array_compact(a))
        t = F.col(text)
        rows = df.withColumn("_terms", F.concat(self.short_forms(t), self.phrases(t))).withColumn(
            p + "omics_types", self.assays(t))
        own = compact(F.transform("_terms", self.disease.canonical))
        via_short = F.flatten(F.transform("_terms", lambda w: _lists(
            {k: e["related_diseases"] for k, e in self.abbreviations.items()}, F.upper(w))))
        rows = rows.withColumn("_own", own).withColumn(
            p + "diseases", ordered_union(F.col("_own"), via_short))
        linked = lambda kind: F.flatten(F.transform(
            "_own", lambda d: self.disease.of(d, kind)))
        rows = rows.withColumns({
            p + "organs": ordered_union(
                linked("related_organs"),
                F.array_compact(F.transform("_terms", self.organ.canonical))),
            p + "species": ordered_union(linked("related_species"))})
        search = F.concat(
            F.flatten(F.transform(c("diseases"), self.disease.search_terms)),
            F.flatten(F.transform(c("organs"), self.organ.search_terms)),
            F.flatten(F.transform(c("omics_types"), self.assay.search_terms)))
        return rows.withColumns({
            p + "expanded_terms": F.array_sort(F.array_distinct(search)),
            p + "confidence": F.least(F.lit(1.0), 0.25 * (
                F.size(c("diseases")) + F.size(c("organs")) + F.size(c("omics_types")))),
        }).drop("_terms", "_own")


def expansion_table(entries: DataFrame) -> DataFrame:
    """(term, place, expansion): every known name with its domain's lists."""
    c = F.col
    place = F.create_map(*[F.lit(x) for kv in zip(
        ("disease", "organ", "assay", "mesh"), range(4)) for x in kv])
    adjective = F.when(c("adjective") != "", F.array("adjective")).otherwise(
        F.array().cast(NONE))
    lists = (F.when(c("domain") == "disease",
                    F.concat("search_terms", "synonyms", "related_organs"))
             .when(c("domain") == "organ", F.concat("search_terms", "synonyms", adjective))
             .when(c("domain") == "assay", F.concat("aliases", "search_boost_terms"))
             .otherwise(c("synonyms")))
    names = F.concat(F.array("key", "canonical"), F.when(
        c("domain") == "assay", c("aliases")).otherwise(c("synonyms")))
    return entries.select(
        F.explode(F.array_distinct(F.transform(names, F.lower))).alias("term"),
        F.element_at(place, c("domain")).alias("place"), lists.alias("expansion"),
        F.struct("seq", F.col("place").alias("p")).alias("o")).groupBy("term", "place").agg(
            F.min_by("expansion", "o").alias("expansion"))


def expand_terms_join(names: DataFrame, entries: DataFrame, key: str = "term_id") -> DataFrame:
    """C8 for any vocabulary size: one equi-join, at most four lists per name."""
    side = expansion_table(entries)
    hits = names.join(side, F.lower(F.trim("name")) == F.col("term")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", "expansion"))).alias("_l"))
    out = names.join(hits, key, "left")
    found = distinct_ignoring_case(F.flatten(F.transform("_l", lambda s: s["expansion"])))
    return out.withColumn("expansion", F.when(F.size(found) > 0, found)
                          .otherwise(F.array("name"))).drop("_l")
