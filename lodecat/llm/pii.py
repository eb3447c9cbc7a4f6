"""Personal data by anchor expansion (2).

An Aho-Corasick automaton passes over each whole text once and finds anchors: at-signs, plus
signs, digits, schemes and identifier cues.  A small deterministic parser for the anchor's kind
grows each hit to its boundaries and validates it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.llm.common import longs, map_rows, public_id, texts

#: Base kinds first, in the order spans are listed; then what the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "url")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport", "user id", "userid", "customer id")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "secret")

_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9@](?:[^\s<>\"'`{}|\\^\[\]]*[A-Za-z0-9/_=-])?")
_GLUE = re.compile(r"(?:[ _-]?(?:id|no|number|nr))?[ \t]*(?:[:=#]|\bis\b)?[ \t]*[\"']?", re.I)
_SECRET_GLUE = re.compile(r"[ \t]*[:=][ \t]*[\"']?")
_ACCOUNT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9]|[ -](?=[0-9])){3,}")
_SECRET = re.compile(r"[A-Za-z0-9_./+-]{8,}")
_DIGITS = "0123456789"
_UPPER = re.compile("[A-Z]+")
#: Characters of an IBAN by country.
IBAN_SIZES = {k: int(n) for n, ks in {
    "15": "NO", "16": "BE", "18": "DK FI FO GL NL SD FK", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST",
    "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HN HU LB NI PL SV", "29": "BR EG PS QA UA",
    "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU"}.items() for k in ks.split()}
_IBAN = {n: re.compile(rf"[A-Za-z]{{2}}[ -]?[0-9][ -]?[0-9](?:[ -]?[A-Za-z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_SIZES.values())}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.replace(" ", "").replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_at(text: str, at: int) -> re.Match | None:
    """The IBAN that begins here, plain or in groups, as long as its country has it."""
    size = IBAN_SIZES.get(text[at:at + 2].upper())
    m = size and _IBAN[size].match(text, at)
    return m if m and iban(m.group()) else None


def lowered(text: str) -> str:
    """A-Z lowered, nothing else, so that offsets stay."""
    return text.lower() if text.isascii() else _UPPER.sub(lambda m: m.group().lower(), text)


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def _word_start(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one whole text, by kind as listed, then start; ends are exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = quad_end = card_end = 0
    for last, (kind, size) in anchors().iter(lowered(text)):
        start = last + 1 - size
        if kind == "digit":
            # A digit is the anchor of a run only where the run begins.
            if start >= quad_end and (start == quad_end or text[start - 1] not in _DIGITS):
                m = _QUADS.match(text, start)
                if m:
                    quad_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        out["ip"].append(m.span())
            if start >= card_end:
                m = _CARD.match(text, start)
                card_end = m.end() if m else start + 1
                if m and m.end() - start >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
        elif kind == "at":
            m = _DOMAIN.match(text, start + 1)
            if m:
                left = start
                while left > email_end and text[left - 1] in _LOCAL:
                    left -= 1
                if left < start:
                    out["email"].append((left, m.end()))
                    email_end = m.end()
        elif kind == "plus":
            m = _PHONE.match(text, start)
            if m and 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                out["phone"].append(m.span())
        elif kind == "scheme":
            m = _URL.match(text, last + 1) if _word_start(text, start) else None
            if m:
                out["url"].append((start, m.end()))
        elif _word_start(text, start):
            glue = (_GLUE if kind == "account" else _SECRET_GLUE).match(text, last + 1)
            m = glue and (kind == "account" and iban_at(text, glue.end()) or (_ACCOUNT if kind == "account" else _SECRET).match(text, glue.end()))
            if m and (glue.end() > last + 1):
                value = m.group()
                n = sum(c in _DIGITS for c in value)
                if kind == "secret" and n or kind == "account" and (n >= 6 or iban(value)):
                    out[kind].append(m.span())
    listed = []
    for kind in KINDS:
        end = -1
        for a, b in sorted(out[kind]):
            if a >= end:
                listed.append((kind, a, b))
                end = b
    return listed


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping ones, one mark."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       redacted: bool = False) -> DataFrame:
    """``doc_id``, a count per base kind, ``base_sha256``, ``spans`` and, if asked, ``redacted``.

    Spans are code points, ends exclusive.  Null texts are empty and hold nothing; every row gives
    a row, repeated ones too; a null id stays null; other columns are not looked at.
    """
    def rows(batch: pa.RecordBatch) -> dict:
        held = batch.column("text").to_pylist()
        found = [spans_of(t) for t in held]
        out = {"doc_id": longs(batch, "doc_id")}
        for k in BASE:
            out[f"n_{k}"] = pa.array([sum(s[0] == k for s in f) for f in found], pa.int64())
        lines = [[f"{k}:{a}:{b}" for k, a, b in f] for f in found]
        out["base_sha256"] = pa.array([hashlib.sha256(",".join(
            [x for x, s in zip(line, f) if s[0] in BASE]).encode()).hexdigest() for line, f in zip(lines, found)], pa.string())
        out["spans"] = pa.array([",".join(line) for line in lines], pa.string())
        if redacted:
            out["redacted"] = pa.array([redact(t, f) for t, f in zip(held, found)], pa.string())
        return out
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    out = map_rows(texts(docs, id_col, text_col), rows, schema + (", redacted string" if redacted else ""))
    return out.select(public_id(), *out.columns[1:])


def redacted_text(text: Column) -> Column:
    """The text with all personal data replaced; null stays null."""
    @F.pandas_udf("string")
    def replaced(held):  # noqa: ANN001, ANN202
        return held.map(lambda t: None if t is None else redact(t, spans_of(t)))
    return replaced(text)
