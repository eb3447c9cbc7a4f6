"""Public vocabulary files and the printable form of their bytes."""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: White space as the Unicode property has it, as the inside of a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: A word of plain Western letters and the plain marks after it: one piece of letters, one of marks,
#: with nothing for Unicode normalisation to change.
PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?%$&*#|]*)")


class Recent:
    """A map that keeps at least the last ``size`` entries in use, and at most twice as many."""

    def __init__(self, size: int, longest: int = 64):
        self.size, self.longest = size, longest
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(key) > self.longest:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def clear(self) -> None:
        self.young, self.old = {}, {}


def file_of(name: str) -> str:
    """A path as given, or the place of a public vocabulary file by its name."""
    if os.sep in name:
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, by rule: printable bytes stand
    for themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def bytes_of(token: str) -> bytes:
    letters = byte_letters()
    return bytes(letters[c] for c in token)
