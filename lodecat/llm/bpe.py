"""BPE encoding and decoding with forced boundaries (3).

Two bytes that never stand side by side inside any token of the vocabulary can never be joined by
a merge.  Every such place is a certain cut: the fragments between cuts are encoded alone and
their ids put one after the other.  Fragments are short and repeat, so each is merged once per
worker and kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodecat.llm.common import longs, map_rows, public_id, texts
from lodecat.llm.vocabulary import PLAIN, WHITE, Recent, byte_letters, file_of

# White space as the Unicode property has it; str.split would also cut at U+001C to U+001F.
SPACES = regex.compile(f"[{WHITE}]+")
ODD = regex.compile("[\x1c-\x1f]")
_KEPT = 120_000
_SHORT = 96


class ForcedBoundaryBPE:
    """Encoder and decoder for a BPE file whose words carry an end suffix.

    Only the file's normaliser and word splitter are the library's; merging, cutting and decoding
    are done here.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.named = {str(i): t for i, t in self.names.items()}
        self.joined = set()
        for token in self.ids:
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.joined.update(zip(body, body[1:]))
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letter = {b: c for c, b in byte_letters().items()}
        self.inner, self.final, self.chunks = Recent(_KEPT // 2), Recent(_KEPT // 2), Recent(_KEPT)

    def merge(self, symbols: list[str]) -> list[str]:
        """The merges of least rank first, the leftmost of equals; long ones over a linked list."""
        n, rank, none = len(symbols), self.rank, 1 << 60
        if n <= _SHORT:
            ranks = list(map(rank.get, zip(symbols, symbols[1:]), repeat(none)))
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                symbols[i] += symbols.pop(i + 1)
                ranks.pop(i)
                if i:
                    ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), none)
                if i < len(ranks):
                    ranks[i] = rank.get((symbols[i], symbols[i + 1]), none)
            return symbols
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        live: list[str | None] = list(symbols)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if live[i] is None or j >= n or self.rank.get((live[i], live[j])) != r:
                continue
            live[i] += live[j]
            live[j] = None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (k := self.rank.get((live[i], live[nxt[i]]))) is not None:
                    heapq.heappush(heap, (k, i))
            if prv[i] >= 0 and (k := self.rank.get((live[prv[i]], live[i]))) is not None:
                heapq.heappush(heap, (k, prv[i]))
        return [s for s in live if s is not None]

    def fragment(self, text: str, final: bool) -> list[int]:
        kept = self.final if final else self.inner
        found = kept.get(text)
        if found is None:
            symbols = list(text)
            if final:
                symbols[-1] += self.suffix
            found = [self.ids[s] for s in self.merge(symbols)]
            kept.put(text, found)
        return found

    def word(self, word: str) -> list[int]:
        """Ids of one word in byte letters, fragment by fragment."""
        out, start, joined = [], 0, self.joined
        if joined.issuperset(zip(word, word[1:])):  # no cut
            return self.fragment(word, True)
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in joined:
                out += self.fragment(word[start:i], False)
                start = i
        return out + self.fragment(word[start:], True)

    def chunk(self, text: str) -> str:
        """Of a text without white space: the ids in decimal, with one space between."""
        found = self.chunks.get(text)
        if found is None:
            if m := PLAIN.fullmatch(text):
                letter = self.letter
                words = [m[1].lower() if text.isascii() else "".join([letter[b] for b in m[1].lower().encode()]), m[2]]
            else:
                plain = self.normal.normalize_str(text) if self.normal else text
                words = [w for w, _ in self.split.pre_tokenize_str(plain)]
            found = " ".join([str(i) for w in words if w for i in self.word(w)])
            self.chunks.put(text, found)
        return found

    def line(self, text: str) -> str:
        """The ids of a whole text in decimal; special strings are special tokens."""
        out, chunk = [], self.chunk
        pieces = [text]
        if self.cut is not None and any(s in text for s in self.special):
            pieces = self.cut.split(text)
        for piece in pieces:
            if piece in self.special:
                out.append(str(self.special[piece]))
                continue
            words = SPACES.split(piece) if ODD.search(piece) else piece.split()
            recent = self.chunks.young
            out += [recent.get(w) or chunk(w) for w in words if w]
        return " ".join([p for p in out if p])

    def forget(self) -> None:
        """Lets the kept words go."""
        for kept in (self.inner, self.final, self.chunks):
            kept.clear()

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.line(text).split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens with one space between, as a file without a decoder is read."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def text_of(self, ids: list[int]) -> str:
        """A readable text: bytes put together, word ends turned into spaces."""
        letters, out = byte_letters(), []
        for i in ids:
            name = self.names.get(i, "")
            if name in self.special:
                out.append(name.encode())
                continue
            end = bool(self.suffix) and name.endswith(self.suffix)
            body = name.removesuffix(self.suffix) if end else name
            out.append(bytes(letters[c] for c in body) + (b" " if end else b""))
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id",
           text_col: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``ids``, the ``ids`` themselves.

    ``decoded_sha256`` is of the text decoded from the ids.  A null or empty text has no ids; every
    row gives a row, repeated ones too; a null id stays null.  Very long texts and words take
    time in proportion (a heap keeps the merges), and nothing is cut off.
    """
    path = file_of(vocabulary)

    def rows(batch: pa.RecordBatch) -> dict:
        own = codec(path)
        n, coded, decoded, lists = [], [], [], []
        for text in batch.column("text").to_pylist():
            line = own.line(text)
            told = line.split()
            n.append(len(told))
            coded.append(hashlib.sha256(line.encode()).hexdigest())
            decoded.append(hashlib.sha256(" ".join(map(own.named.__getitem__, told)).encode()).hexdigest())
            if ids:
                lists.append(np.fromstring(line, np.int32, sep=" ") if line else np.zeros(0, np.int32))
        out = {"doc_id": longs(batch, "doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(coded, pa.string()),
               "decoded_sha256": pa.array(decoded, pa.string())}
        if ids:
            out["ids"] = pa.array(lists, pa.list_(pa.int32()))
        return out
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    out = map_rows(texts(docs, id_col, text_col), rows, schema, lambda: codec(path).forget())
    return out.select(public_id(), *out.columns[1:])
