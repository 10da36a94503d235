"""Chat formatting with loss masks, by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. Each prefix of a
conversation is rendered; where an output extends the one before, the new end is the span of
the new turn; where it does not, the template rewrites history, which is reported. Where the
text lies within a span is found by rendering the same prefix with probe texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
PROBE = "\ue000"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|n)")


def escape(text: str) -> str:
    """A backslash before each backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def turn_template(turns: Turns) -> str:
    """``### role``, the text and ``</turn>``, with control strings in texts escaped."""
    return "".join(f"### {escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}</turn>\n" for role, text in turns)


def read_turns(formatted: str) -> Turns:
    """The turns of ``turn_template``'s output, from that output alone."""
    out = []
    for m in re.finditer(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n", formatted, re.S):
        out.append((unescape(m[1]), unescape(m[2])))
    return out


def spans(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """The output, (start, text start, text end, end) of each turn, and the first turn that rewrites what came before (-1: none)."""
    before, found, rewritten = template([]), [], -1
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if now.startswith(before):
            start = len(before)
        else:
            rewritten = k if rewritten < 0 else rewritten
            start = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
        probe = template([*turns[:k], (role, PROBE)])
        blank = template([*turns[:k], (role, "")])
        lo = next((i for i, (a, b) in enumerate(zip(probe[start:], blank[start:])) if a != b), len(blank) - start) + start
        found.append((start, lo, len(now) - (len(blank) - lo), len(now)))
        before = now
    return before, found, rewritten


def _formatted(template: Callable[[Turns], str], loss_role: str):
    def run(batches):
        for batch in batches:
            rows = []
            for turns in batch.column("turns").to_pylist():
                turns = [(t["role"] or "", t["text"] or "") for t in turns]
                rows.append((*spans(turns, template), [r == loss_role for r, _ in turns]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([[s[1:3] for s, loss in zip(r[1], r[3]) if loss] for r in rows], pa.list_(pa.list_(pa.int64()))), pa.array([r[2] for r in rows], pa.int64())],
                ["conv_id", "formatted", "loss", "rewritten_at"],
            )

    return run


def format_chats(conversations: DataFrame, template: Callable[[Turns], str] = turn_template, loss_role: str = "assistant") -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> ``(conv_id, formatted, loss, rewritten_at)``.

    A row for each conv_id, null included. Turns are taken by turn (null first), ties by role and
    text; repeated rows are turns of their own; null roles and texts count as empty. ``loss`` lists
    the [start, end) code points of each text of ``loss_role``; ``rewritten_at`` is the first turn
    at which the template changed earlier output, or -1. A conversation is one training example
    and so is rendered by one task; other columns are ignored.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.mapInArrow(_formatted(template, loss_role), "conv_id long, formatted string, loss array<array<long>>, rewritten_at long")


def _read_back(batches):
    for batch in batches:
        rows = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = read_turns(text)
            under = unescape("".join(text[a:b] for a, b in loss))
            rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), _sha(under), len(text)))
        c = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(x, pa.string() if k in (1, 3) else pa.int64()) for k, x in enumerate(c))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from the output."""
    return format_chats(conversations).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts hold the template's control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = conversations.sparkSession.createDataFrame([Row(conv_id=-7, turn=k, role=r, text=text) for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(extra)
