"""Ids, numbers, dates and answers out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecat.fixed import terms
from lodecat.functions.text import blank, has_any, last_wins


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(group)))


def study_ids(text: Column) -> Column:
    return _all(text, r"(?i)(?U)\b(?:SRP|ERP|DRP|SRPX)[0-9]{4,}\b")


def run_ids(text: Column) -> Column:
    return _all(text, r"(?i)(?U)\bSRR[0-9]{4,}\b")


def series_ids(text: Column, longest: int | None = 7) -> Column:
    """Series accessions in text, first-seen order; ``longest`` bounds the digits."""
    return _all(text, r"(?U)\bGSE[0-9]{4,%s}\b" % (longest or ""))


def is_series_id(col: Column) -> Column:
    return col.rlike("^GSE[0-9]+$")


def accession_type(col: Column) -> Column:
    """First of nine patterns that the trimmed, upper-cased id fits; null if none."""
    key = F.upper(F.trim(blank(col)))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in terms.ACCESSION_TYPES:
        out = out.when(key.rlike(pattern), name)
    return out


def clean_query(col: Column) -> Column:
    """Control characters out, typographic signs to plain ones, blanks collapsed."""
    plain = F.regexp_replace(blank(col), "[\\x00-\\x1f\\x7f-\\x9f]", "")
    plain = F.translate(plain, "\u2018\u2019\u201c\u201d\u2014\u2013\u00a0", "''\"\"-- ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def query_error(col: Column) -> Column:
    """Why a query is refused: empty or too long; null when it is fine."""
    return (F.when(F.trim(F.regexp_replace(blank(col), r"\s+", " ")) == "", "empty")
            .when(F.length(col) > terms.MAX_QUERY_LENGTH, "too long"))


def loose_date(col: Column) -> Column:
    """``YYYY``, ``YYYY/MM/DD`` or ``YYYY-MM-DD`` to a date, null when unreadable."""
    text = F.replace(blank(col), F.lit("/"), F.lit("-"))
    whole = F.when(text.rlike("^[0-9]{4}$"), F.concat(text, F.lit("-01-01"))).otherwise(text)
    return F.when(whole.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
                  F.try_to_date(F.left(whole, F.lit(10)), "yyyy-MM-dd"))


def parse_score(text: Column) -> Column:
    """First number; above 1 it is a percentage; clamped to 0..1; null without one."""
    number = F.nullif(F.regexp_extract(blank(text), r"([0-9]+\.?[0-9]*)", 1), F.lit(""))
    value = number.cast("double")
    scaled = F.when(value > 1, value / 100).otherwise(value)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), scaled))


def cell_count(text: Column) -> Column:
    """``15,230 cells`` to ``15K``, ``2 million`` to ``2M``, null without a count.

    Ungrouped digits are read whole.
    """
    raw = F.regexp_extract(
        blank(text),
        r"(?i)(?<![0-9,.])([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*cell", 1)
    number = F.nullif(F.replace(raw, F.lit(","), F.lit("")), F.lit("")).cast("double")
    million = F.nullif(F.regexp_extract(
        blank(text), r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:million|m\b)", 1), F.lit("")).cast("double")
    return F.coalesce(
        F.when(number >= 1000, F.concat(F.floor(number / 1000).cast("string"), F.lit("K")))
        .when(number.isNotNull(), F.floor(number).cast("string")),
        F.when(million.isNotNull(), F.concat(F.floor(million).cast("string"), F.lit("M"))))


# Two-sided and one-sided sample count patterns with their labels, in order.
GROUPING_PATTERNS = [
    (r"([0-9]+)\s*(?:patient|subject|donor|participant|case)s?\s*(?:vs|versus|vs\.?)\s*([0-9]+)"
     r"\s*(?:healthy|control|normal)s?", "cases vs controls"),
    (r"([0-9]+)\s*(?:healthy|control|normal)\s*(?:patient|subject|donor|participant|case)s?"
     r"\s*(?:vs|versus)\s*([0-9]+)", "controls vs cases"),
    (r"([0-9]+)\s*(?:treatment|treated|intervention|stimulated)\s*(?:vs|vs\.?|versus)\s*([0-9]+)"
     r"\s*(?:control|baseline|untreated|vehicle)", "treated vs control"),
    (r"([0-9]+)\s*(?:time point|visit|sample)s?", ""),
    (r"([0-9]+)\s*(?:sample)s?", ""),
]


def sample_grouping(text: Column) -> Column:
    """``6 vs 6 (label)`` or ``12 samples`` from the first pattern that fits."""
    low = F.lower(blank(text))
    parts = []
    for pattern, label in GROUPING_PATTERNS:
        first = F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
        parts.append(
            F.concat(first, F.lit(" vs "), F.regexp_extract(low, pattern, 2),
                     F.lit(f" ({label})")) if label else F.concat(first, F.lit(" samples")))
    return F.coalesce(*parts)


def attribute_lines(text: Column) -> Column:
    """``key: value`` lines to a map; keys lower-cased with underscores, last one wins."""
    lines = F.filter(F.split(blank(text), "\n"), lambda x: F.contains(x, F.lit(":")))
    key = lambda x: F.replace(
        F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_"))
    value = lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    return last_wins(F.transform(
        lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))))


ANSWER = T.StructType([
    T.StructField("one_sentence_summary", T.StringType()),
    T.StructField("sample_grouping", T.StringType()),
    T.StructField("cell_count", T.StringType()),
    T.StructField("relevance_reason", T.StringType()),
])
_STRING = r'"(?:[^"\\]|\\.)*"'


def parse_answer(text: Column) -> Column:
    """A model answer to its four fields, however broken the JSON is.

    Tried in turn: the text without fences; its outermost braces; the text cut behind its
    last complete pair; the complete pairs by pattern.  Line breaks inside strings are
    read as blanks.  Missing fields read NA, a missing reason ``-``.
    """
    bare = F.trim(F.regexp_replace(F.trim(blank(text)), r"^```(?:json)?|```$", ""))
    flat = F.regexp_replace(bare, r"[\r\n]", " ")
    braces = F.regexp_extract(flat, r"(?s)(\{.*\})", 1)
    pairs = rf'{_STRING}\s*:\s*(?:{_STRING}|[-0-9.eE]+|true|false|null)'
    cut = F.concat(F.regexp_extract(flat, rf"(\{{\s*{pairs}(?:\s*,\s*{pairs})*)\s*,", 1),
                   F.lit("}"))
    read = lambda c: F.from_json(c, ANSWER, {"mode": "PERMISSIVE"})
    whole = lambda c: c.rlike(r"^\s*\{") & c.rlike(r"\}\s*$")
    any_field = lambda s: F.coalesce(*[s[f.name] for f in ANSWER]).isNotNull()
    tries = [read(flat), read(braces), read(cut)]
    fits = [whole(flat), whole(braces), whole(cut)]
    data = F.coalesce(*[F.when(ok & any_field(t), t) for ok, t in zip(fits, tries)])
    by_pattern = lambda f: F.nullif(F.regexp_extract(
        flat, rf'"{f}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    broken = F.coalesce(data["one_sentence_summary"], data["sample_grouping"],
                        data["cell_count"], data["relevance_reason"],
                        *[by_pattern(f.name) for f in ANSWER]).isNull()
    field = lambda f, default: F.coalesce(
        F.nullif(F.coalesce(data[f], by_pattern(f)), F.lit("")), F.lit(default))
    return F.struct(
        field("one_sentence_summary", "NA").alias("one_sentence_summary"),
        field("sample_grouping", "NA").alias("sample_grouping"),
        field("cell_count", "NA").alias("cell_count"),
        F.when(broken, "unreadable answer").otherwise(field("relevance_reason", "-"))
        .alias("relevance_reason"))


def prefer_answer(answer: Column, fact: Column) -> Column:
    """The answer unless it is NA or missing, then the fact from text, then NA."""
    known = F.when(~answer.isin("NA", "unreadable answer", ""), answer)
    return F.coalesce(known, fact, F.lit("NA"))


def availability(status: Column, access_text: Column, consent: Column, runs: Column,
                 min_samples: int = 1) -> dict[str, Column]:
    """Availability, access type and note of a landed study status."""
    state = F.lower(blank(status))
    gone = state.isin(*terms.WITHDRAWN)
    text = F.lower(blank(access_text))
    agreed = has_any(F.lower(blank(consent)), ["controlled", "dbgap"])
    closed = has_any(text, terms.CONTROLLED_WORDS)
    low = runs < min_samples
    return {
        "availability_status": F.when(gone, "unavailable").when(closed | agreed, "restricted")
                                .when(runs == 0, "unavailable").otherwise("available"),
        "access_type": F.when(gone, "unknown").when(closed | agreed, "controlled")
                        .otherwise("public"),
        "availability_note": F.when(gone, F.concat(F.lit("Study status: "), state))
        .when(closed, "dbGaP controlled access detected")
        .when(agreed, "Controlled access per consent")
        .when(runs == 0, "No RUN data found")
        .when(low, F.concat(F.lit("Low sample count ("), runs.cast("string"),
                            F.lit(f" < {min_samples})"))).otherwise(""),
    }
