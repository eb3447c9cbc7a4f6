"""Chat formatting by incremental black-box rendering (1).

The template is a black box, a function from turns to a string.  Successive prefixes of a
conversation are rendered and consecutive outputs compared: what a turn adds is its span.  Two
probes that differ from the first character of the turn's text on show where the text starts and
ends inside the span.  A template that changes what it wrote for earlier turns is detected there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Strings that steer a model or the template; fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_TURN = re.compile(r"\[INST\]((?:[^\\\n]|\\.)*?)\n(.*?)\[/INST\]|\[OUT\](.*?)</s>", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of a control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def inst_template(turns: Sequence[Turn]) -> str:
    """Marks every turn; control strings inside roles and texts are escaped."""
    out = ["<s>"]
    for role, text in turns:
        if role == "assistant":
            out.append(f"[OUT]{escape(text)}</s>")
        else:
            out.append(f"[INST]{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}[/INST]")
    return "".join(out)


def last_system_template(turns: Sequence[Turn]) -> str:
    """A template of the kind that rewrites history: the system text moves to the last user turn."""
    system = "".join(t for r, t in turns if r == "system")
    spoken = [(r, t) for r, t in turns if r != "system"]
    users = [i for i, (r, _) in enumerate(spoken) if r == "user"]
    if users:
        i = users[-1]
        spoken[i] = ("user", f"{system}\n{spoken[i][1]}")
    return inst_template(spoken)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of ``inst_template``."""
    out = []
    for m in _TURN.finditer(formatted):
        if m[3] is not None:
            out.append(("assistant", unescape(m[3])))
        else:
            out.append((unescape(m[1]), unescape(m[2])))
    return out


def _common(a: str, b: str) -> int:
    """Characters that both begin with, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass(frozen=True)
class Rendering:
    """``spans``: per turn its start and end, and the start and end of its text; ``rewrites``: the
    first turn at which earlier output changed, or -1."""
    formatted: str
    spans: list[tuple[int, int, int, int]]
    rewrites: int


def _text_place(template, earlier: Sequence[Turn], role: str, now: str) -> tuple[int, int]:
    """Where the last turn's text starts and ends in ``now``.

    "0" and "1" occur in no control string, so the probes part exactly where the text begins."""
    zero, one = (template([*earlier, (role, p)]) for p in "01")
    first = _common(zero, one)
    if first == len(zero):
        return len(now), len(now)
    return first, len(now) - _common(zero[:first:-1], one[:first:-1])


def _windowed(turns: Sequence[Turn], template, window: int) -> Rendering | None:
    """What each turn adds, rendered behind the last ``window`` to twice as many turns.

    Valid if the parts make up the whole rendering, and its prefixes of doubling length; else None.
    """
    parts, spans, check = [template([])], [], window
    at = len(parts[0])
    for begin in range(0, len(turns), window):
        low = max(0, begin - window)
        before = template(turns[low:begin])
        for k in range(begin, min(begin + window, len(turns))):
            now = template(turns[low:k + 1])
            if not now.startswith(before):
                return None
            first, last = _text_place(template, turns[low:k], turns[k][0], now)
            shift = at - len(before)
            if first < len(before):
                return None
            spans.append((at, len(now) + shift, first + shift, last + shift))
            parts.append(now[len(before):])
            at, before = len(now) + shift, now
        done = min(begin + window, len(turns))
        if done >= check or done == len(turns):
            check *= 2
            if template(turns[:done]) != "".join(parts):
                return None
    return Rendering("".join(parts), spans, -1)


def render(turns: Sequence[Turn], template: Callable[[Sequence[Turn]], str] = inst_template, window: int = 16,
           stable: bool | None = None) -> Rendering:
    """Renders successive prefixes and compares them, which costs the square of the turns.

    ``stable`` declares that the template only appends, and that what a turn adds depends on no
    turn before it; by default this holds for ``inst_template`` alone.  Only then a long conversation
    is rendered over windows; the result stands if it makes up the whole rendering.
    """
    stable = template is inst_template if stable is None else stable
    if stable and len(turns) > 2 * window and (found := _windowed(turns, template, window)):
        return found
    before, spans, rewrites = template([]), [], -1
    for k, (role, text) in enumerate(turns):
        now = template(turns[:k + 1])
        same = len(before) if now.startswith(before) else _common(before, now)
        if same < len(before) and rewrites < 0:
            rewrites = k
        spans.append((same, len(now), *_text_place(template, turns[:k], role, now)))
        before = now
    return Rendering(before, spans, rewrites)


_COLUMNS = ("conv_id", "role", "text")


def _by_conversation(batches: Iterator[pa.RecordBatch]):
    """(id, turns) of sorted rows; one conversation is held at a time."""
    own, turns, begun = None, [], False
    for batch in batches:
        for i, role, text in zip(*(batch.column(c).to_pylist() for c in _COLUMNS)):
            if begun and i != own:
                yield own, turns
                turns = []
            own, begun = i, True
            turns.append((role, text))
    if begun:
        yield own, turns


def format_conversations(conversations: DataFrame, template: Callable[[Sequence[Turn]], str] = inst_template,
                         conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         stable: bool | None = None) -> DataFrame:
    """``conv_id, n_turns, formatted, spans, rewrites_at`` per conversation.

    Each span has the turn's role, start and end, and the text's own start and end
    (``text_start``, ``text_end``), in code points of ``formatted``.  ``rewrites_at`` is the first
    turn at which the template changed earlier output, -1 if none did; then spans hold for the
    prefix that ends with their turn.  Rows are ordered by turn, equal turns by role and text,
    null turns first; null roles and texts are empty; rows with a null id form one conversation;
    repeated rows are turns of their own.  ``stable`` is as in ``render``.  A conversation is one record: rows reach its task
    sorted and in small batches.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(*_COLUMNS)
    span = "struct<role:string,start:int,end:int,text_start:int,text_end:int>"
    kind = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            ids, turns, done = zip(*held)
            spans = [[{"role": r, "start": s[0], "end": s[1], "text_start": s[2], "text_end": s[3]}
                      for (r, _), s in zip(t, d.spans)] for t, d in zip(turns, done)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in turns], pa.int64()), pa.array([d.formatted for d in done], pa.string()),
                 pa.array(spans, kind), pa.array([d.rewrites for d in done], pa.int32())],
                ["conv_id", "n_turns", "formatted", "spans", "rewrites_at"])
        size = 0
        for own, turns in _by_conversation(batches):
            held.append((own, turns, render(turns, template, stable=stable)))
            size += len(held[-1][2].formatted)
            if len(held) >= 2000 or size > 1 << 24:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()
    return rows.mapInArrow(run, f"conv_id long, n_turns long, formatted string, spans array<{span}>, rewrites_at int")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says when read back: turns, the text under the loss mask, and lengths."""
    @F.pandas_udf("struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string>")
    def read(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd
        out = []
        for t, s in zip(text, spans):
            turns = read_back(t)
            told = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
            loss = "".join(unescape(t[x["text_start"]:x["text_end"]]) for x in s if x["role"] == "assistant")
            out.append((len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])
    own: Column = read("formatted", "spans").alias("own")
    return formatted.select("conv_id", own, F.length("formatted").cast("long").alias("formatted_chars"), "rewrites_at").select(
        "conv_id", "own.*", "formatted_chars", "rewrites_at")
