"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re

import numpy as np
import xxhash


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def repeats(docs, length=50):
    """(id, text) pairs to id, n_removed, n_spans, digest of what is kept."""
    docs = sorted(docs, key=lambda d: d[0])
    first, out = {}, []
    raws = [(i, t.encode()) for i, t in docs]
    for i, raw in raws:
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p:p + length], i)
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p:p + length]] < i:
                gone[p:p + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, int(gone.sum()), runs, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def simhash(text, words=4):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    own = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not own:
        return 0
    shingles = [" ".join(own[i:i + words]) for i in range(len(own) - words + 1)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, words=5):
    """The set of runs of words, A-Z lowered; a shorter text is one run."""
    own = text.lower().split()
    return {tuple(own[i:i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def alike(a, b, likeness=0.8):
    return a == b or len(a & b) >= likeness * len(a | b)


def groups(ids, linked):
    """Smallest id reachable, of each id."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
