"""Text matching as Column expressions: which terms does a text hold, and which one wins.

Three match rules (whole word, substring, letters-and-digits only) meet three pick rules
(first declared, longest, all).  Each is one pass over the row: no join, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Classes = Sequence[tuple[str, Sequence[str]]]


def constant(value) -> str:
    """SQL text of a constant.  Large constants are built as one expression: a call per
    literal would cost more than planning the query."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, dict):
        fields = ", ".join(f"'{k}', {constant(v)}" for k, v in value.items())
        return f"named_struct({fields})"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(constant, value))})"
    return str(value)


def lit_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.expr(constant(values)) if values else F.array().cast("array<string>")


def lit_map(pairs: Mapping[str, object]) -> Column:
    flat = [x for kv in pairs.items() for x in kv]
    return F.expr(f"map({', '.join(map(constant, flat))})")


def blank(col: Column) -> Column:
    """The missing-value convention: null reads as the empty string."""
    return F.coalesce(col, F.lit(""))


def join_text(*cols: Column) -> Column:
    return F.concat_ws(" ", *[blank(c) for c in cols])


def squash(col: Column) -> Column:
    """Lower case, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(blank(col)), r"(?U)\s+", " "))


def alnum_key(col: Column) -> Column:
    """Lower case with everything but a-z and 0-9 removed."""
    return F.regexp_replace(F.lower(blank(col)), "[^a-z0-9]", "")


def alnum_term(term: str) -> str:
    return re.sub("[^a-z0-9]", "", term.lower())


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """True when any term is a substring.  Short-circuits and stays in generated code.

    A term that holds an earlier one can never decide the result, so it is left out.
    """
    kept: list[str] = []
    for term in sorted(dict.fromkeys(terms), key=len):
        if not any(k in term for k in kept):
            kept.append(term)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in kept], F.lit(False))


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms are substrings."""
    hits = [F.contains(text, F.lit(t)).cast("int") for t in terms]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that are substrings, in their declared order (U4)."""
    return let(text, lambda x: F.filter(lit_array(terms), lambda w: F.contains(x, w)))


def first_class(text: Column, classes: Classes, default: Column | str | None = None) -> Column:
    """Substring rule, first declared class wins (M2)."""
    out = None
    for name, terms in classes:
        hit = has_any(text, terms)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if out is None else out.otherwise(fallback)


def longest_alias(text: Column, aliases: Mapping[str, str],
                  default: Column | None = None) -> Column:
    """Substring rule, longest alias wins, declared order on equal length (M3)."""
    ordered = sorted(aliases.items(), key=lambda kv: -len(kv[0]))
    return first_class(text, [(name, [alias]) for alias, name in ordered], default)


def all_classes(text: Column, classes: Classes) -> Column:
    """Substring rule, every class with a hit, in declared order (M4)."""
    return F.array_compact(
        F.array(*[F.when(has_any(text, terms), F.lit(name)) for name, terms in classes]))


def alnum_hit(text_key: Column, terms: Sequence[str]) -> Column:
    """Letters-and-digits rule over a text already reduced by :func:`alnum_key` (M5).

    A term that reduces to nothing is found everywhere, as the empty string is.
    """
    keys = [alnum_term(t) for t in terms]
    return F.lit(True) if "" in keys else has_any(text_key, keys)


def _quote(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def alternation(terms: Iterable[str]) -> str:
    """One alternation, longest term first, branched on the first character.

    At one position all candidates that match are prefixes of each other, so branching on
    the first character keeps the longest-first pick while skipping most alternatives.
    """
    heads: dict[str, list[str]] = {}
    for term in sorted(dict.fromkeys(t for t in terms if t), key=lambda t: -len(t)):
        heads.setdefault(term[0], []).append(term[1:])
    return "|".join(
        f"{_quote(head)}(?:{'|'.join(_quote(t) for t in tails)})"
        for head, tails in sorted(heads.items()))


def phrases_at_boundaries(text: Column, terms: Iterable[str]) -> Column:
    """Whole-word rule: for every word boundary the longest term that starts there.

    The look-ahead consumes nothing, so terms that overlap are all seen in one pass; the set
    of first characters in front skips most places cheaply.
    """
    terms = [t for t in terms if t]
    first = "".join(_quote(c) for c in sorted({t[0] for t in terms}))
    return F.array_distinct(F.regexp_extract_all(
        text, F.lit(rf"(?U)(?=[{first}])\b(?=({alternation(terms)})\b)"), F.lit(1)))


def phrase_hits(text: Column, terms: Iterable[str]) -> Column:
    """All terms that stand in the text as whole words, each once.

    Where several start at one place the longest stands for those it begins with.
    """
    known = list(dict.fromkeys(t for t in terms if t))
    heads = {t: [h for h in known if h == t or (
        t.startswith(h) and not (t[len(h)].isalnum() or t[len(h)] == "_"))] for t in known}
    heads = {t: h for t, h in heads.items() if len(h) > 1}
    found = phrases_at_boundaries(text, known)
    if not heads:
        return found
    return F.array_distinct(F.flatten(F.transform(
        found, lambda h: F.coalesce(F.element_at(lit_map(heads), h), F.array(h)))))


def consume_phrases(text: Column, terms: Iterable[str], max_words: int = 4) -> Column:
    """Greedy scan over blank-separated tokens: longest phrase at each place, then go on
    behind it (M8)."""
    kept = [t for t in terms if len(t.split()) <= max_words]
    return F.regexp_extract_all(
        text, F.lit(rf"(?<![^ ])({alternation(kept)})(?![^ ])"), F.lit(1))


def remove_phrases(text: Column, terms: Iterable[str]) -> Column:
    return F.regexp_replace(text, rf"(?U)\b(?:{alternation(terms)})\b", " ")


def leading_phrase(text: Column, terms: Iterable[str]) -> Column:
    """Longest phrase of whole tokens at the start of the text, else the empty string."""
    return F.regexp_extract(text, rf"^({alternation(terms)})(?![^ ])", 1)


def best_of(hits: Column, ranked: Sequence[tuple], fields: Sequence[str]) -> Column:
    """Of the terms found, the first in rank order, as a struct; null when none is ranked.

    ``ranked`` holds (term, *values) best first; terms of other vocabularies do not count.
    """
    ranks: dict[str, tuple] = {}
    for rank, (term, *values) in enumerate(ranked):
        ranks.setdefault(term, (rank, values))
    known = lit_map({t: {"rank": rank, **dict(zip(fields, values))}
                     for t, (rank, values) in ranks.items()})
    return F.array_min(F.transform(hits, lambda h: F.element_at(known, h)))


def best_phrase(text: Column, ranked: Sequence[tuple], fields: Sequence[str]) -> Column:
    """Whole-word rule, first in rank order wins (M1)."""
    return best_of(phrases_at_boundaries(text, [r[0] for r in ranked]), ranked, fields)


def let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once per row.

    A lambda evaluates all it holds for every element, so what does not depend on the
    element is bound outside first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_ignoring_case(terms: Column) -> Column:
    """Distinct by lower-cased, blank-collapsed form; the first spelling stays."""
    norm = lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))
    return let(terms, lambda ts: let(F.transform(ts, norm), lambda ks: F.filter(
        ts, lambda t, i: F.array_position(ks, F.element_at(ks, i + 1)) == i + 1)))


def last_wins(pairs: Column) -> Column:
    """(key, value) structs to a map; of equal keys the last one counts."""
    return let(pairs, lambda ps: let(F.transform(ps, lambda p: p["key"]), lambda ks:
        F.map_from_entries(F.filter(ps, lambda p, i: ~F.array_contains(
            F.slice(ks, i + 2, F.size(ks)), p["key"])))))


def ordered_union(*arrays: Column) -> Column:
    """Union of lists that keeps first-seen order."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>"))
                                       for a in arrays]))
