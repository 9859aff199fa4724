"""Chat formatting in budgeted windows.

A conversation's turns become windows of at most `budget` tokens. Prefix sums of turn tokens choose each window's span, always of
whole turns: the span from turn i holds every turn up to j with sum(j) - sum(i) within what the budget leaves. A leading system
turn is retained in every later window that has room for it beside the span's first turn, and up to `history` turns
before the span are repeated as far as they fit. The loss mask covers the assistant texts of the span only, so repeated turns
are never targets twice. Turns are marked by `<s>[role]` and `</s>`; in roles and texts `\\`, `<`, `[` and `]` are written as
`\\\\`, `\\l`, `\\b` and `\\d`, so no control string can occur in them and all is read back as it was.

Defined results: null text and null roles count as empty; rows without a conv_id are one conversation without an id; turns are
ordered by turn (null first), then role and text, so ties and repeated rows have a fixed order and each counts; a window is above
the budget only if it is one turn that is; an empty table gives no rows; other columns, whatever their names, are not read. Rows
stream through the task in order: memory holds one window, not the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[", "</s>"
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\d"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_TABLE = str.maketrans(_ESCAPES)
_TURN = re.compile(r"<s>\[([^\]]*)\]([^<]*)</s>")
SCHEMA = "conv_id long, window long, n_repeated long, n_tokens long, formatted string, loss_start array<long>, loss_end array<long>"

Turn = tuple[str, str]


def escape(text: str) -> str:
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def tokens(text: str) -> int:
    """The default token count of a turn: its words and the two marks."""
    return len(text.split()) + 2


def format_window(turns: list[Turn], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and its loss spans (code points); the first `repeated` turns are no targets."""
    out, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{escape(role)}]", escape(text)
        start = at + len(head)
        if i >= repeated and role == "assistant" and body:
            loss.append((start, start + len(body)))
        out += [head, body, CLOSE]
        at = start + len(body) + len(CLOSE)
    return "".join(out), loss


def parse_window(formatted: str) -> list[Turn]:
    """The turns of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def windows(turns: Iterator[Turn], budget: int, history: int, count: Callable[[str], int] = tokens) -> Iterator[tuple[list[Turn], int, int]]:
    """(turns, how many of them are repeated, tokens) of each window of one conversation."""
    system: tuple[Turn, int, int] | None = None
    lead: list[tuple[Turn, int, int]] = []
    span: list[tuple[Turn, int, int]] = []
    total = kept = 0  # tokens of all turns so far; tokens of the lead

    def window():
        return [t for t, _, _ in lead + span], len(lead), kept + total - span[0][2]

    def start(n: int) -> tuple[list[tuple[Turn, int, int]], int]:
        """What a span whose first turn has n tokens repeats: the system turn, then the last turns, by their sums."""
        past = [p for p in lead + span if p is not system]
        first = [system] if system and system[1] + n <= budget else []
        used = n + sum(k for _, k, _ in first)
        tail: list[tuple[Turn, int, int]] = []
        for old in reversed(past[-history:] if history else []):
            if used + old[1] > budget:
                break
            tail.insert(0, old)
            used += old[1]
        return first + tail, used - n

    for turn in turns:
        n = count(turn[1])
        if span and kept + total + n - span[0][2] > budget:
            yield window()
            lead, kept = start(n)
            span = []
        item = (turn, n, total)
        if not total and not span and turn[0] == "system" and system is None:
            system = item
        total += n
        span.append(item)
    if span:
        yield window()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Consecutive rows of a conversation, streamed: each inner iterator is read to its end before the next one starts."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def turns(conv=conv) -> Iterator[Turn]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                now, ahead = ahead, next(rows, None)
                yield now[1], now[2]

        yield conv, turns()


def _format(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv, turns in _conversations(batches):
            for k, (part, repeated, used) in enumerate(windows(turns, budget, history)):
                text, loss = format_window(part, repeated)
                out.append((conv, k, repeated, used, text, [a for a, _ in loss], [b for _, b in loss]))
                size += len(text)
                if size > 4 << 20:
                    yield _table(out, SCHEMA)
                    out, size = [], 0
        if out:
            yield _table(out, SCHEMA)

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def format_conversations(turns: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """One row per window: (conv_id, window, n_repeated, n_tokens, formatted, loss_start, loss_end)."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return t.mapInArrow(_format(budget, history), SCHEMA)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows, in order, back to digests of their conversations: reads only what was formatted."""
    out: list[tuple] = []
    conv, state = None, None

    def close() -> None:
        if state:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for c, repeated, text, starts, ends in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse_window(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for a, b in zip(starts, ends, strict=True):
                said = unescape(text[a:b])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if len(out) > 10_000:
            yield _table(out, _READ)
            out = []
    close()
    if out:
        yield _table(out, _READ)


def read_back(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the windows alone.

    dealt: `formatted` is the plan of format_conversations itself, whose partitions hold whole conversations in order.
    """
    f = formatted if dealt else formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window")
    return f.select("conv_id", "n_repeated", "formatted", "loss_start", "loss_end").mapInArrow(_digest, _READ)
