"""Exact token counts at every prefix of a text (5).

A text falls into units: a run of white space with the run of other characters after it.  No
piece of the pre-tokeniser crosses a unit's end, so counts add up over units.  Inside a piece
dynamic programming runs over its bytes: the encoding of each prefix ends in exactly one token
that is compatible with the last token of the prefix before it, so
``count[i] = count[i - len(last)] + 1``.  A unit's counts are kept and reused; a text's counts are
the sums.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodecat.llm.common import longs, map_rows, public_id, texts
from lodecat.llm.vocabulary import PLAIN, WHITE, Recent, bytes_of, file_of

UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
LEAD = re.compile(f"[{WHITE}]*")
CONTRACTIONS = {"'re", "'ve", "'ll"}
_KEPT = 200_000


class PrefixCounter:
    """Token counts of prefixes under one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.token = {bytes_of(t): i for t, i in vocab.items()}
        self.rank, self.formed, self.halves = {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes_of(a), bytes_of(b)
            self.rank[(a, b)] = r
            if a + b not in self.formed:
                self.formed[a + b], self.halves[a + b] = r, (a, b)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = Tokenizer.from_file(path).pre_tokenizer
        self.ends = ahocorasick.Automaton()
        for b in self.token:
            self.ends.add_word(b.decode("latin-1"), (b, len(b)))
        self.ends.make_automaton()
        self.fits = lru_cache(1 << 18)(self._fits)
        self.alive: dict[bytes, bool] = {}
        self.marks, self.units, self.totals = Recent(_KEPT // 16), Recent(_KEPT // 64), Recent(_KEPT)

    def _fits(self, a: bytes, b: bytes) -> bool:
        """Whether token b stands alone and stays apart from the token a before it, if there is one,
        when their bytes are encoded together.

        Their merges are undone, the latest first.  At each step the two pieces at the border
        must have no merge that comes before the one just undone; of equal merges the left one
        comes first.
        """
        rank, formed, halves = self.rank, self.formed, self.halves
        if not self.own(b):
            return False
        if not a:
            return True
        if (a, b) in rank:
            return False
        while True:
            x, y = formed.get(a, -1), formed.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                a, limit = halves[a][1], x
            else:
                b, limit = halves[b][0], y + 1
            r = rank.get((a, b))
            if r is not None and r < limit:
                return False

    def own(self, token: bytes) -> bool:
        """Whether a token's bytes alone are encoded as that token."""
        found = self.alive.get(token)
        if found is None:
            parts = [bytes([x]) for x in token]
            while len(parts) > 1:
                best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
                if best == 1 << 60:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            found = self.alive[token] = len(parts) == 1
        return found

    def by_byte(self, text: str) -> list[int]:
        """Counts at the end of each byte of one piece, after a zero; inside a character they hold no sense."""
        raw = text if text.isascii() else text.encode().decode("latin-1")
        size = len(raw) + 1
        count, last, at, fits = [0] * size, [b""] * size, -1, self.fits
        for end, (t, n) in self.ends.iter(raw):  # at each end the longest comes first
            if end != at:
                before = end + 1 - n
                if fits(last[before], t):
                    at = end
                    end += 1
                    last[end] = t
                    count[end] = count[before] + 1
        return count

    def piece(self, text: str) -> list[int]:
        """Counts at the end of each character of one piece."""
        count = self.by_byte(text)
        if len(count) == len(text) + 1:
            return count[1:]
        found, at = [], 0
        for c in text:
            at += len(c.encode())
            found.append(count[at])
        return found

    def last(self, text: str) -> int:
        """The count of one unit, its pieces' last counts together."""
        if m := PLAIN.fullmatch(text):
            word, marks = m.groups()
            n = self.by_byte(word)[-1]
            if marks:
                k = self.marks.get(marks)
                if k is None:
                    k = self.by_byte(marks)[-1]
                    self.marks.put(marks, k)
                n += k
        else:
            n = sum([self.by_byte(text[start:end])[-1] for _, (start, end) in self.split.pre_tokenize_str(text)])
        self.totals.put(text, n)
        return n

    def unit(self, text: str) -> list[int]:
        """Counts at the end of each character of one unit, each prefix cut into its own pieces."""
        found = self.units.get(text)
        if found is not None:
            return found
        if m := PLAIN.fullmatch(text):
            found = self.piece(m[1])
            if m[2]:
                base = found[-1]
                found = found + [base + k for k in self.piece(m[2])]
            self.units.put(text, found)
            return found
        found, base, spaces = [], 0, LEAD.match(text).end()
        if spaces:  # until a word begins, the white space is one piece
            found += self.piece(text[:spaces])
        for _, (start, end) in self.split.pre_tokenize_str(text):
            part = text[start:end]
            own = self.piece(part)
            if end > spaces:
                if part in CONTRACTIONS:  # its prefixes are a mark and a letter, two pieces
                    mark = self.piece("'")[-1]
                    found += [base + mark, base + mark + self.piece(part[1])[-1], base + own[-1]]
                else:
                    found += [base + k for k in own[max(0, spaces - start):]]
            base += own[-1]
        self.units.put(text, found)
        return found

    def by_unit(self, units: list[str]) -> list[int]:
        """The count of each unit."""
        totals = self.totals
        old = totals.get
        return [totals.young.get(u) or old(u) or self.last(u) for u in units]

    def plain(self, text: str) -> int:
        """The count of a text without special strings."""
        return sum(self.by_unit(UNITS.findall(text)))

    def total(self, text: str) -> int:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return sum(1 if p in self.special else self.plain(p) for p in self.cut.split(text) if p)

    def counts(self, text: str) -> np.ndarray:
        """The exact count of every prefix: entry i is for the first i + 1 characters."""
        out, base = [], 0
        parts = [p for p in (self.cut.split(text) if self.cut else [text]) if p]
        tail = ""
        for p in parts:
            if p in self.special:
                # Until its last character a special string is ordinary text after the tail.
                own = self.counts_plain(tail + p)[len(tail):].copy() + (base - self.plain(tail))
                own[-1] = base + 1
                base, tail = base + 1, ""
            else:
                own = self.counts_plain(p) + base
                base, tail = int(own[-1]), UNITS.findall(p)[-1]
            out.append(own)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def counts_plain(self, text: str) -> np.ndarray:
        out, base = [], 0
        for u in UNITS.findall(text):
            own = self.unit(u)
            out.append(np.array(own, np.int32) + base)
            base += own[-1]
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """The count of a text, and the characters of its longest prefix with at most ``budget`` tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            units = UNITS.findall(text)
            counts = self.by_unit(units)
            n = sum(counts)
            if n <= budget:
                return n, len(text)
            # Every unit adds a token at least: beyond the first that goes over, no prefix fits.
            over, base = 0, 0
            while base + counts[over] <= budget:
                base += counts[over]
                over += 1
            inside = max((i for i, c in enumerate(self.unit(units[over]), 1) if base + c <= budget), default=0)
            return n, sum(map(len, units[:over])) + inside
        n = self.total(text)
        if n <= budget:
            return n, len(text)
        fits = np.flatnonzero(self.counts(text) <= budget)
        return n, int(fits[-1]) + 1 if len(fits) else 0

    def longest(self, text: str, budget: int) -> int:
        return self.measure(text, budget)[1]


@lru_cache(4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, budget: int = 1024, vocabulary: str = "byte_bpe_50k.json",
                 id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut_chars`` and, if ``prefixes``, ``counts``.

    ``cut_chars`` is the longest prefix, in characters, with at most ``budget`` tokens: the
    truncation point, read from the prefix counts.  ``counts`` holds the count of every prefix.
    Special strings inside texts are special tokens, as the library's default has it.  Null texts
    are empty and have no tokens; every row gives a row, repeated ones too; a null id stays null.
    """
    path = file_of(vocabulary)

    def rows(batch: pa.RecordBatch) -> dict:
        own = counter(path)
        held = batch.column("text").to_pylist()
        n, cut = zip(*[own.measure(t, budget) for t in held]) if held else ((), ())
        out = {"doc_id": longs(batch, "doc_id"), "n_bytes": pa.array([len(t.encode()) for t in held], pa.int64()),
               "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([k > budget for k in n], pa.bool_()),
               "cut_chars": pa.array(cut, pa.int64())}
        if prefixes:
            out["counts"] = pa.array([own.counts(t) for t in held], pa.list_(pa.int32()))
        return out
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"
    out = map_rows(texts(docs, id_col, text_col), rows, schema + (", counts array<int>" if prefixes else ""))
    return out.select(public_id(), *out.columns[1:])
