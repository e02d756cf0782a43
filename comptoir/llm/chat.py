"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered as a whole, encoded once, and every token gets its byte offsets. The sorted spans of the assistant's texts are
intersected with the sorted token spans by binary search; a token counts for the loss if it meets one, and the loss spans are the
intersections, so a token that crosses the edge of a text brings nothing from outside it.

Template of a turn: ``### role: text</turn>`` and a line break. A backslash goes before every backslash, ``#`` and ``<`` of a text, and
before the colons of a role too, so no text can hold a marker, and taking the backslashes off gives it back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.llm.tokenizer import read_ranks

_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str, marks: str = r"[\\#<]") -> str:
    return re.sub(f"({marks})", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans, in UTF-8 bytes, of the texts of the ``trained`` role."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, r'[\\#<:]')}: ", escape(text)
        start = at + len(head.encode())
        at = start + len(body.encode())
        if role == trained:
            spans.append((start, at))
        at += len("</turn>\n")
        parts.append(f"{head}{body}</turn>\n")
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; an error if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def meet(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask of the tokens that meet a span, and the intersections; ``tokens`` are the ends of tokens that follow each other from 0."""
    mask = np.zeros(len(tokens), dtype=bool)
    shared = []
    for start, end in spans:
        if start < end:
            first, last = int(np.searchsorted(tokens, start, side="right")), int(np.searchsorted(tokens, end, side="left"))
            mask[first : last + 1] = True
            low = np.maximum(np.concatenate([[0], tokens])[first : last + 1], start)
            high = np.minimum(tokens[first : last + 1], end)
            shared += list(zip(low.tolist(), high.tolist(), strict=True))
    return mask, shared


_encoders: dict[str, tuple] = {}


def _encoder(vocabulary: str, pattern: str) -> tuple:
    if vocabulary not in _encoders:
        import tiktoken

        ranks = read_ranks(vocabulary)
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[vocabulary] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[vocabulary]


def format_conversations(df: DataFrame, *, vocabulary: str, pattern: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row for each conversation: its id, ``formatted``, ``ids``, ``loss_mask`` (one flag a token) and ``loss_spans`` (in bytes).

    Turns stand in the order of ``turn``, nulls first, ties by role and text. Null roles and texts count as empty; a null id is a
    conversation of its own. Other columns are left out. A conversation is one row and has to fit into a task.
    """
    turns = df.select(F.col(f"`{conversation}`").alias(conversation), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy(conversation).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = whole.schema[conversation].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(vocabulary, pattern)
        for batch in (whole.slice(at, 250) for whole in batches for at in range(0, whole.num_rows, 250)):
            out: list[list] = [[], [], [], []]
            for turns in batch.column(1).to_pylist():
                formatted, spans = render([(t["role"], t["text"]) for t in turns], trained)
                ids = np.array(encoder.encode_ordinary(formatted), dtype=np.int32)
                mask, shared = meet(np.cumsum(lengths[ids]), spans)
                for column, value in zip(out, (formatted, ids, mask, [{"start": a, "end": b} for a, b in shared]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.bool_())), pa.array(out[3], span)], names=[conversation, "formatted", "ids", "loss_mask", "loss_spans"])

    return whole.mapInArrow(run, f"{conversation} {kind}, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start: int, end: int>>")


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Rows (id, formatted, turns, loss): the turns parsed from the formatted text, and the unescaped text under the loss spans."""
    kind = formatted.schema[conversation].dataType.simpleString()
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 250) for whole in batches for at in range(0, whole.num_rows, 250)):
            turns, loss = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                turns.append([{"role": r, "text": t} for r, t in read_turns(text)])
                loss.append(unescape(b"".join(raw[s["start"] : s["end"]] for s in spans).decode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, turn), pa.array(loss, pa.string())], names=[conversation, "formatted", "turns", "loss"])

    return formatted.select(conversation, "formatted", "loss_spans").mapInArrow(run, f"{conversation} {kind}, formatted string, turns array<struct<role: string, text: string>>, loss string")
