"""Values that must equal published ones for results to agree."""

from __future__ import annotations

from functools import cache
from pathlib import Path


@cache
def table(name: str) -> dict[str, str]:
    """A two-column text table as an ordered mapping (a repeated key keeps its last value)."""
    pairs: dict[str, str] = {}
    for line in (Path(__file__).parent / f"{name}.tsv").read_text("utf-8").splitlines():
        if line and not line.startswith("#"):
            key, value = line.split("\t")
            pairs[key] = value
    return pairs
