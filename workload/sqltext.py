"""Pieces of checking SQL."""

from __future__ import annotations

import json
import re

from lodecat.sources.vocabulary import ROOTS, SEED, WEIGHTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def count_(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(w)}) AS INT)" for w in words) + ")"


def case_(col: str, classes, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_(col, ws)} THEN {q(n)}" for n, ws in classes) \
        + f" ELSE {default} END"


def all_(col: str, classes, joint: str = "|") -> str:
    return "concat_ws('" + joint + "', " + ", ".join(
        f"CASE WHEN {any_(col, ws)} THEN {q(n)} END" for n, ws in classes) + ")"


def longest_(col: str, aliases: dict, default: str = "NULL") -> str:
    ordered = sorted(aliases.items(), key=lambda kv: -len(kv[0]))
    return case_(col, [(n, [a]) for a, n in ordered], default)


def map_(col: str, pairs: dict, default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(
        f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in pairs.items()) \
        + f" ELSE {default} END"


def key_(col: str) -> str:
    return f"regexp_replace(lower({col}), '[^a-z0-9]', '', 'g')"


def squash_(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '\\s+', ' ', 'g'))"


def values_(rows, columns: str) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) \
        + f") v({columns})"


def seed(domain: str) -> dict:
    return json.loads((SEED / f"{domain}.json").read_text("utf-8"))[ROOTS[domain]]


_LISTS = {"canonical": None, "synonym": "synonyms", "alias": "aliases", "keyword": "keywords",
          "search_term": "search_terms", "adjective": "adjective"}


def seed_terms(domain: str) -> list[tuple]:
    """(term, canonical, weight, granularity, rank), best first."""
    weights = dict(WEIGHTS[domain])
    rows = []
    for name, e in seed(domain).items():
        grain = ""
        if domain == "assay":
            cat = e.get("category", "").lower()
            grain = ("single_cell" if "single" in cat or "single-cell" in name.lower()
                     else "spatial" if "spatial" in cat else "bulk")
        for kind, field in _LISTS.items():
            if kind not in weights:
                continue
            words = [name] if field is None else e.get(field) or []
            for w in [words] if isinstance(words, str) else words:
                rows.append((w.lower(), e["canonical"], weights[kind], grain))
    rows.sort(key=lambda r: -len(r[0]))
    return [(*r, i) for i, r in enumerate(rows)]


def bounded_(text: str, term: str) -> str:
    """Whole-word hit of a fixed term, with letters of any language as word signs."""
    plain = re.sub("([^a-z0-9 ])", r"\\\1", term)
    word = "\\p{L}\\p{N}_"
    return f"regexp_matches({text}, {q(f'(^|[^{word}]){plain}($|[^{word}])')})"


def hits_(source: str, key: str, text: str, rows, columns: str) -> str:
    """One row per whole-word hit: fixed patterns, one per term."""
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    names = [c.strip() for c in columns.split(",")]
    return " UNION ALL ".join(
        f"SELECT {key}, " + ", ".join(f"{lit(v)} AS {c}" for v, c in zip(r, names))
        + f" FROM {source} WHERE {bounded_(text, r[0])}" for r in rows)


def best_(name: str, source: str, key: str, text: str, rows) -> str:
    """CTE body: best whole-word term per row of ``source``."""
    return (f"{name} AS (SELECT {key}, arg_min(canonical, rnk) AS canonical, "
            f"arg_min(weight, rnk) AS weight, arg_min(granularity, rnk) AS granularity "
            f"FROM ({hits_(source, key, text, rows, 'term, canonical, weight, granularity, rnk')}) "
            f"GROUP BY {key})")
